"""SimHash fingerprints and exact search for near ones by hashing balls.

Two fingerprints within ``radius`` bits: cut the 64 bits into blocks, and by
the pigeonhole principle some pair of three blocks holds at most two of four
differing bits.  On each such projection both sides emit every variant within
half of that remaining radius (one bit), so that the two balls meet in the
middle; variants are shuffled, a pair is taken at the one variant that both
sides reach in a fixed order, and its full distance is verified.  That is
3 x 43 variants a fingerprint where balls of radius two over all 64 bits have
2,081, with 42-bit keys that stay sparse for billions of fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, row_key, settle, split_join
from .components import connected_components

BITS = 64
CUTS = (0, 21, 42, 64)
SEED = 42


def fingerprint(text: str | None, width: int = 4) -> int:
    """Signed 64-bit SimHash of the ``width``-word shingles, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(body, np.uint8) == 32)
    n = max(1, len(words) - width + 1)
    starts = np.concatenate(([0], gaps + 1))[:n].tolist()
    ends = np.concatenate((gaps, [len(body)]))[len(words) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        stop = at + (1 << 16)
        h = np.array([digest(body[s:e], SEED) for s, e in zip(starts[at:stop], ends[at:stop])], np.uint64)
        ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        counts += (np.ones(len(h), np.float32) @ ones).astype(np.int64)  # exact: at most 2**16 of each
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp bigint) of every row, by whole text; null and blank texts have 0."""
    arrow_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], [id_col, "fp"])

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


def _projections() -> list[tuple[int, list[int]]]:
    """(mask, its bits) for each pair of blocks."""
    blocks = [list(range(CUTS[i], CUTS[i + 1])) for i in range(3)]
    return [(sum(1 << b for b in bits), bits) for bits in (blocks[0] + blocks[1], blocks[0] + blocks[2], blocks[1] + blocks[2])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_pairs(prints: DataFrame, radius: int = 4, fp: str = "fp") -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints of ``prints`` that differ in 1 to ``radius`` bits.

    ``radius`` is at most 4: five bits may leave three on each pair of blocks,
    where balls of one bit do not meet.
    Each projection yields a pair once; pairs found on several are made distinct.
    Prints that are all within four bits of each other are 2,081 at most (as
    many as a ball of radius two holds), however many texts there are, so that
    pairs grow with the number of prints and not with its square.  That bound
    is for prints that link: prints that agree on two blocks and differ widely
    on the third share a key of 42 bits and are compared all with all.
    """
    if not 0 <= radius <= 4:
        raise ValueError("radius: 0 to 4")
    distinct = prints.select(F.col(fp).alias("fp")).where(F.col(fp).isNotNull()).distinct()

    def ball(p: int, mask: int, bits: list[int]) -> Column:
        flips = F.array(*[F.lit(x).cast("long") for x in (0, *(_signed(1 << b) for b in bits))])
        seen = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        variant = lambda flip, i: F.struct(
            F.lit(p).cast("byte").alias("p"), i.cast("byte").alias("flip"), seen.bitwiseXOR(flip).alias("key")
        )
        return F.transform(flips, variant)

    variants = [ball(p, mask, bits) for p, (mask, bits) in enumerate(_projections())]
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # few bytes become many rows: spread them before, not after
    balls = settle(distinct.repartition(parts, "fp")).select("fp", F.inline(F.concat(*variants)))
    x = balls.select("p", "key", F.col("fp").alias("a"), F.col("flip").alias("fa"))
    y = balls.select("p", "key", F.col("fp").alias("b"), F.col("flip").alias("fb"))
    # Of the variants two balls share, the one where the lower bit is flipped in one and the higher in the other.
    once = (F.col("fa") < F.col("fb")) | ((F.col("fa") == 0) & (F.col("fb") == 0) & (F.col("a") < F.col("b")))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return (
        x.join(y, ["p", "key"])
        .where((F.col("a") != F.col("b")) & once & near)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def near_groups(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fp, component_id, the least id reachable over links of ``radius`` bits.

    Texts without words share fingerprint 0 and link like any others.  Equal
    fingerprints are one node, so copies are never expanded into pairs.  An
    empty table gives no rows; rows that repeat an id stay repeated.
    """
    prints = settle(with_fingerprints(docs, id_col, text))
    nodes = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    groups = connected_components(near_pairs(prints, radius))
    named = nodes.join(groups, nodes["fp"] == groups["node"], "left").select(
        nodes["fp"].alias("_fp"), "least", F.coalesce("component", "fp").alias("component")
    )
    named = settle(named)
    least = settle(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    members = split_join(named, least, ["component"], "n", named.count()).select("_fp", "component_id")
    return prints.join(members, F.col("fp") == F.col("_fp")).select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, that of the least id.

    Rows are told apart by id and text, so different texts under one id, or
    under none, are documents of their own; a row without an id is kept only
    where no near copy has one.  Rows that repeat both are one document.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row_key(id_col, text).alias("self"), F.col(text).alias("body")
    )
    first = near_groups(rows, radius, "self", "body").where(F.col("self") == F.col("component_id"))
    kept = rows.join(first.select("self").distinct(), "self", "left_semi").dropDuplicates(["self"])
    return kept.select("doc.*")
