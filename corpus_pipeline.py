"""A corpus pipeline of five stages, each of which hands its documents on to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import lines, mixing, packing, queries, simhash, toxicity
from tidemark.llm.common import row_key, settle, table


def whole(docs: DataFrame) -> Column:
    """A row of ``docs`` as one struct, so that no stage's own columns can clash with its columns."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the threshold; the model learns from labelled rows of ``docs``."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out()).select("doc_id", "toxic")
    rows = docs.select(whole(docs), row_key("doc_id", "text").alias("self"), "text")
    scored = toxicity.score_documents(rows, toxicity.train(docs, labels), id_col="self")
    bad = scored.where(F.col("score") >= queries.TOXIC_AT).select("self").distinct()
    return rows.join(bad, "self", "left_anti").select("doc.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten or more documents share, and n_chars to match."""
    done = lines.dedup_lines(docs.select(whole(docs), "doc_id", "text"))
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return done.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rounded rate says."""
    mixed = mixing.mix(docs, queries.domain_labels(docs, table(spark, sf_dir, "labels")), whole=True)
    copies = mixed.where(F.col("copies") > 0).select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copies.select("_doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and offset."""
    return packing.pack_documents(docs, queries.vocabulary_path(), digest_only=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing", mix_domains),
    ("packing", pack),
]

#: SQL cannot express the trained stages; the pipeline is tested stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is settled before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
