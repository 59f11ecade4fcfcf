"""Exact line dedup with per-document keep bitmaps (DataFrame functions only).

Hashes of line keys are range-partitioned by (hash, document) and sorted there
by document and position, so that a pass over the sorted rows streams the first
occurrence of each key in each document.  Because the document belongs to the
range key, a line that a third of all documents share is spread over many
partitions.  Counts of first occurrences, combined before their shuffle, tell
the common keys; the lines to drop come back as a sparse bitmap per document
(one 64-line word per entry), never as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, let, settle, split_join


def text_lines(text: Column) -> Column:
    """The lines of a text; a null or empty one is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _row_key(id_col: str, text: str) -> Column:
    """Tells rows apart that share an id but not a text."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text), F.lit("")))


def keyed_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line whose key is not empty: _id, _row, pos, h1, h2 (128 bits of hash)."""
    keys = F.transform(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))
    return (
        docs.select(F.col(id_col).alias("_id"), _row_key(id_col, text).alias("_row"), F.posexplode(keys).alias("pos", "key"))
        .where(F.col("key") != "")
        .select("_id", "_row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )


def first_occurrences(lines: DataFrame, parts: int) -> DataFrame:
    """The first row of each key in each document, with ``times``, how often the document has it.

    The range partitioning serves the window, which sorts by document and
    position and streams: there is no further shuffle.
    """
    group = Window.partitionBy("h1", "h2", "_id", "_row").orderBy("pos")
    placed = lines.repartitionByRange(parts, "h1", "h2", "_id", "_row")
    every = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return placed.withColumns({"k": F.row_number().over(group), "times": F.count("*").over(every)}).where("k = 1").drop("k")


def line_bitmaps(
    docs: DataFrame, min_documents: int = 10, keep_first: bool = False, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Sparse bitmaps of the lines to drop: _id, _row, bits map<int, bigint> (word -> 64 lines).

    A key is dropped if at least ``min_documents`` documents have it.  With
    ``keep_first`` its first occurrence in (document, position) order stays.
    Documents that lose no line have no row.  Rows that repeat an id and its
    text are one document.
    """
    lines = settle(keyed_lines(docs, id_col, text))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    common = settle(
        first_occurrences(lines, parts)
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.sum("times").alias("times"), F.min(F.struct("_id", "_row", "pos")).alias("first"))
        .where(F.col("n") >= min_documents)
        .drop("n")
    )
    dropped = split_join(lines, common if keep_first else common.drop("first"), ["h1", "h2"], "times", lines.count())
    if keep_first:
        dropped = dropped.where(~F.struct("_id", "_row", "pos").eqNullSafe(F.col("first")))
    return (
        dropped.groupBy("_id", "_row", F.expr("pos div 64").cast("int").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits"))
        .groupBy("_id", "_row")
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bits"))
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_lines, n_dropped (long) and kept_text, the lines not in the bitmap joined by newlines.

    Columns of ``docs`` with these names are replaced; whatever other names it
    has stay, as its rows travel as one struct.
    """

    def dense(bits: Column) -> Column:
        words = F.sequence(F.lit(0), F.array_max(F.map_keys(bits)))
        return F.transform(words, lambda w: F.coalesce(F.try_element_at(bits, w), F.lit(0).cast("long")))

    def stays(b: Column, i: Column) -> Column:
        word = F.coalesce(F.get(b, F.floor(i / 64).cast("int")), F.lit(0).cast("long"))
        return F.call_function("getbit", word, i % 64) == 0

    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"), _row_key(id_col, text).alias("row")
    )
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row"))
    joined = own.join(bitmaps, same, "left").select("doc", "bits", text_lines(F.col(f"doc.`{text}`")).alias("lines"))
    kept = F.when(F.col("bits").isNull(), F.col("lines")).otherwise(
        let(dense(F.col("bits")), lambda b: F.filter(F.col("lines"), lambda x, i: stays(b, i)))
    )
    made = joined.select("doc", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    added = {"n_lines": F.col("n_lines"), "n_dropped": F.col("n_lines") - F.size("kept"), "kept_text": F.array_join("kept", "\n")}
    return made.select(
        *[F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c.lower() not in added], *[e.alias(c) for c, e in added.items()]
    )


def dedup_lines(docs: DataFrame, min_documents: int = 10, keep_first: bool = False, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text; see :func:`line_bitmaps` and :func:`apply_bitmaps`.

    Null and empty texts are one empty line, which has no key and stays.  An
    empty table gives no rows.
    """
    return apply_bitmaps(docs, line_bitmaps(docs, min_documents, keep_first, id_col, text), id_col, text)
