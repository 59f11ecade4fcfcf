"""Texts that hold most of the words of an item, without a join on common words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.lineage import settle


def words(text: Column) -> Column:
    """Distinct runs of ASCII letters and digits, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""))


def containment(docs: DataFrame, items: DataFrame, share: float = 0.6) -> DataFrame:
    """(doc_id, item_id, overlap): items of which a text holds at least ``share`` of the distinct words.

    ``docs``: doc_id, text; ``items``: item_id, text.  An item of n words of
    which k must be there cannot miss all of its n - k + 1 rarest ones, so that
    candidates come from those alone; then whole word lists are compared.
    Texts are cut into words once, and words travel as 64-bit hashes.  Of a
    text only words of items go on, so that what is counted, joined and
    compared grows with what texts and items share.  Items without words match
    nothing.
    """
    need = lambda n: F.ceil(n * share - 1e-9)
    i = settle(items.select("item_id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("iw")).where(F.size("iw") > 0))
    listed = i.select("item_id", F.size("iw").alias("n"), F.explode("iw").alias("w"))
    spread = docs.select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("_word")).select("doc_id", F.xxhash64("_word").alias("w"))
    known = settle(spread.join(listed.select("w").distinct(), "w", "left_semi").distinct())
    seen = known.groupBy("w").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("item_id").orderBy(F.coalesce("df", F.lit(0)), "w")
    prefix = listed.join(seen, "w", "left").withColumn("k", F.row_number().over(rarest)).where(F.col("k") <= F.col("n") - need(F.col("n")) + 1)
    candidates = settle(known.join(prefix.select("item_id", "w"), "w").select("doc_id", "item_id").distinct())
    own = known.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_set("w").alias("dw"))
    both = candidates.join(own, "doc_id").join(i, "item_id")
    shared = F.size(F.array_intersect("dw", "iw"))
    return both.where(shared >= need(F.size("iw"))).select("doc_id", "item_id", (shared / F.size("iw")).alias("overlap"))
