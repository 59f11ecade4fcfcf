"""Idempotent writes as plans: what is there stays, new keys are appended, first come first kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.lineage import settle
from tidemark.schemas import KEYS


def _same(a: str, b: str, keys: list[str]):
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def insert_new(target: DataFrame, rows: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """Rows of ``rows`` whose key ``target`` lacks, the first of each key by ``arrival``, with ids from the largest on.

    ``rows`` has the columns of ``target`` but id, and those of ``arrival``.
    """
    first = Window.partitionBy(*keys).orderBy(*arrival)
    fresh = rows.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    fresh = fresh.alias("n").join(target.select(*keys).alias("t"), _same("n", "t", keys), "left_anti")
    top = target.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    return number(fresh, arrival, top).select(target.columns)


def number(rows: DataFrame, order: list[str], after: int = 0) -> DataFrame:
    """``rows`` with ids after ``after`` in the given order, without gathering them in one task.

    A range partitioning sorts; partition counts, one row each, give the
    offsets.  The placed rows are checkpointed, so that a lost executor cannot
    place them anew.
    """
    placed = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    sizes = {r["_p"]: r["n"] for r in placed.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    offsets, total = {}, after
    for p in sorted(sizes):
        offsets[p], total = total, total + sizes[p]
    if not offsets:
        return placed.withColumn("id", F.lit(None).cast("long")).drop("_p")
    table = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])
    own = Window.partitionBy("_p").orderBy(*order)
    return placed.withColumn("id", (F.row_number().over(own) + table[F.col("_p")]).cast("long")).drop("_p")


def merge_entities(target: DataFrame, rows: DataFrame) -> DataFrame:
    """The new state of entities: attributes of ``rows`` win, seeded if either is."""
    keys = KEYS["entities"]
    old, new = target.alias("o"), rows.alias("n")
    kept = F.map_filter(
        F.coalesce("o.attributes", F.create_map().cast("map<string,string>")),
        lambda k, v: ~F.array_contains(F.coalesce(F.map_keys("n.attributes"), F.array().cast("array<string>")), k),
    )
    both = F.map_concat(kept, F.coalesce("n.attributes", F.create_map().cast("map<string,string>")))
    joined = old.join(new, _same("o", "n", keys), "full_outer")
    state = joined.select(
        "o.id", *[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys], both.alias("attributes"),
        (F.coalesce("o.seeded", F.lit(False)) | F.coalesce("n.seeded", F.lit(False))).alias("seeded"),
    )
    there = state.where("id IS NOT NULL")
    top = target.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    return there.unionByName(number(state.where("id IS NULL").drop("id"), keys, top).select(state.columns))


def insert_contradictions(target: DataFrame, rows: DataFrame, arrival: list[str]) -> DataFrame:
    """New contradictions of ``rows`` with ids: pairs of claims, or of links, in either order, that ``target`` lacks.

    A pair of claims and a pair of links are told apart by which of them is known.
    """
    sides = [(f"{k}_a_id", f"{k}_b_id") for k in ("claim", "link")]
    turned = {c: f(a, b) for a, b in sides for c, f in ((a, F.least), (b, F.greatest))}
    return insert_new(target, rows.withColumns(turned), [c for pair in sides for c in pair], arrival)
