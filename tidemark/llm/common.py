"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.lineage import settle

__all__ = ["BLANKS", "BLANK_RUN", "NOT_BLANK", "arrow_batches", "ascii_lower", "let", "row_key", "settle", "split_join", "table", "words"]

#: White space of the word contracts: blank and the five ASCII controls.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
NOT_BLANK = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def row_key(id_col: str, text: str) -> Column:
    """Struct that tells rows apart which share an id but not a text; rows without an id come last in its order."""
    return F.struct(
        F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash")
    )


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; the fast path serves strings that are pure ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def words(text: Column) -> Column:
    """The maximal runs of non-blank characters; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def split_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join with ``right``, which has each key once and in ``weight`` how many of the ``total`` rows of ``left`` have it.

    With P shuffle partitions fewer than P keys can hold over a P-th of all
    rows each: those are broadcast.  The other keys are shuffled, each of them
    a P-th of the rows at most.  Both tables are read twice: settle them first.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.coalesce(F.col(weight) * parts > total, F.lit(False))
    few, many = F.broadcast(right.where(hot).drop(weight)), right.where(~hot).drop(weight)
    rest = left.join(F.broadcast(right.where(hot).select(*keys)), keys, "left_anti")
    return left.join(few, keys).unionByName(rest.join(many, keys))


def arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches small, so that a batch of long texts fits a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
