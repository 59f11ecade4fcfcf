"""Phrase collocations counted over a prefix-free parse.

Texts are cut where their content says so: a word whose key is divisible by
``TRIGGER`` begins a chunk, as does the first word of a piece, and a chunk
reaches ``longest - 1`` words into what follows it in its piece.  Equal
passages are thus cut alike wherever they stand, and the distinct chunks with
their frequencies form a dictionary.  Phrases are counted inside the distinct
chunks, weighted by frequency; one that begins in the overlap belongs to the
next chunk, so that each occurrence counts once.

Rare phrases are pruned level by level: words, pairs of frequent words, longer
phrases all of whose pairs are frequent, and words of such pairs.  What is frequent is told by filters
of a fixed size, which never lose a frequent phrase; what passes them is then
counted by its text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import Words, bucket_bits, buckets_of, byte_kinds, count_keys, mixed, split_words, summed, unpack_sorted, unplaned
from .common import arrow_batches, settle

KINDS = byte_kinds(" \t", ".,;:!?\n\x0b\x0c\r")
TRIGGER = 16
#: Bits of a filter: 16 MB, whatever the number of frequent phrases.  With very many of them a filter prunes less.
FILTER_BITS = 27
HOLD_TEXTS = 200_000
#: Languages whose totals are broadcast; with more of them they are joined by shuffle.
FEW_LANGUAGES = 10_000
_COUNTED = pa.struct([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("f", pa.int64())])
_JOIN, _ALONE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA5A5_0F0F_3C3C_5A5A)


def parse(docs: DataFrame, longest: int = 5, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, chunk, own, n): the distinct chunks of each language, how many of a chunk's words are its own, and its frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = split_words(batch.column(1), KINDS)
            many = len(words.keys)
            piece_starts = np.concatenate(([True], words.pieces[1:] != words.pieces[:-1])) if many else np.zeros(0, bool)
            heads = np.flatnonzero(piece_starts | (words.keys % np.uint64(TRIGGER) == 0))
            nexts = np.append(heads[1:], many)[: len(heads)]
            piece_ends = np.append(np.flatnonzero(piece_starts)[1:], many)
            reach = np.minimum(nexts + longest - 1, piece_ends[np.searchsorted(piece_ends, heads, "right")]) if many else heads
            body = words.body.tobytes()
            cut = zip(words.starts[heads].tolist(), words.ends[reach - 1].tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(words.rows[heads])), pa.array([body[s:e] for s, e in cut], pa.binary()), pa.array(nexts - heads, pa.int32())],
                ["lang", "chunk", "own"],
            )

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "lang string, chunk binary, own int").groupBy("lang", "chunk", "own").agg(F.count("*").alias("n"))


class _Chunks:
    """Words of a batch of dictionary rows, keyed by language."""

    def __init__(self, batch: pa.RecordBatch):
        self.langs = batch.column(0).to_pylist()
        self.words: Words = split_words(batch.column(1), KINDS)
        rows = self.words.rows
        salts = {x: xxhash.xxh64_intdigest(x.encode()) for x in set(self.langs)}
        salt = np.array([salts[x] for x in self.langs], np.uint64)
        self.keys = mixed(self.words.keys ^ salt[rows]) if len(rows) else self.words.keys
        own, n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        first = np.searchsorted(rows, np.arange(len(own)))
        self.owned = np.arange(len(rows)) - first[rows] < own[rows]
        self.weights = n[rows].astype(np.uint64)
        self.rows = rows

    def grams(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, first words, keys) of the phrases of each length that are a chunk's own."""
        at, keys = np.flatnonzero(self.owned), self.keys[self.owned]
        yield 1, at, keys
        for n in range(2, longest + 1):
            fits = at + n - 1 < len(self.rows)
            at, keys = at[fits], keys[fits]
            fits = self.rows[at] == self.rows[at + n - 1]
            at, keys = at[fits], keys[fits]
            keys = mixed(keys * _JOIN + self.keys[at + n - 1])
            yield n, at, keys

    def pair_keys(self) -> np.ndarray:
        """Key of each word with its successor; of the last word of a chunk it means nothing."""
        return mixed(self.keys * _JOIN + np.append(self.keys[1:], np.uint64(0))[: len(self.keys)])


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _filter_of(counted: DataFrame, at_least: int) -> np.ndarray:
    """Bits of the keys that count ``at_least``; the driver gathers as many places as the filter has at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for keys, counts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = unpack_sorted(keys)[unplaned(counts) >= at_least]
                out.append(np.unique(found >> np.uint64(64 - FILTER_BITS)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["places"])

    bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    for row in counted.mapInArrow(run, "places binary").where(F.length("places") > 0).collect():
        places = np.frombuffer(row["places"], "<u4")
        np.bitwise_or.at(bits, places >> 3, np.left_shift(1, places & 7).astype(np.uint8))
    return bits


def phrase_counts(docs: DataFrame, longest: int = 5, at_least: int = 100, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 2 to ``longest`` words found ``at_least`` times and of the words in them, and (lang, n) with all word occurrences."""
    spark = docs.sparkSession
    arrow_batches(spark)
    chunks = settle(parse(docs, longest, lang, text))
    arrow_batches(spark, 20_000)
    totals = settle(chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("n")).alias("n")))
    tokens = totals.agg(F.sum("n")).first()[0] or 0
    bits = min(bucket_bits(tokens, int(spark.conf.get("spark.sql.shuffle.partitions"))), FILTER_BITS)

    def level(draw: Callable[[_Chunks], Iterator[tuple[np.ndarray, np.ndarray]]]):
        def of_batch(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            chunks = _Chunks(batch)
            for at, keys, *weights in draw(chunks):
                yield keys, weights[0] if weights else chunks.weights[at]

        return spark.sparkContext.broadcast(_filter_of(count_keys(chunks, of_batch, bits), at_least))

    def words(c: _Chunks):
        at = np.flatnonzero(c.owned)
        yield at, c.keys[at]

    frequent_words = level(words)

    def pairs(c: _Chunks):
        good = _passes(frequent_words.value, c.keys)
        for n, at, keys in c.grams(2):
            if n == 2:
                both = good[at] & good[at + 1]
                yield at[both], keys[both]

    frequent_pairs = level(pairs)

    def longer(c: _Chunks):
        good = _passes(frequent_pairs.value, c.pair_keys())
        inside = good.copy()
        inside[1:] |= good[:-1]
        at = np.flatnonzero(inside)  # own or not: a word that begins a chunk may have its pair in the chunk before
        kept, first = np.unique(c.keys[at], return_index=True)
        yield at[first], mixed(kept ^ _ALONE), np.full(len(kept), at_least, np.uint64)
        for n, at, keys in c.grams(longest):
            if n > 2:
                all_good = np.logical_and.reduce([good[at + k] for k in range(n - 1)])
                yield at[all_good], keys[all_good]

    frequent_longer = level(longer)

    def count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def told() -> pa.RecordBatch:
            order = sorted(held)
            cut = list(buckets_of(np.array(order, np.uint64), bits))
            columns = zip(*[held[k] for k in order])
            rows = pa.StructArray.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, _COUNTED)], fields=list(_COUNTED))
            places = pa.array([0, *[own.stop for _, own in cut]], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in cut], pa.int32()), pa.ListArray.from_arrays(places, rows)], ["bucket", "found"])

        for batch in batches:
            c = _Chunks(batch)
            body = c.words.body.tobytes()
            for n, at, keys in c.grams(longest):
                passed = _passes(frequent_pairs.value, keys) if n == 2 else _passes(frequent_longer.value, mixed(keys ^ _ALONE) if n == 1 else keys)
                at, keys = at[passed], keys[passed]
                distinct, first = np.unique(keys, return_index=True)
                _, sums = summed(keys, c.weights[at])
                for key, i, f in zip(distinct.tolist(), at[first].tolist(), sums.tolist()):
                    if (row := held.get(key)) is not None:
                        row[3] += f
                    else:
                        phrase = b" ".join([body[c.words.starts[j] : c.words.ends[j]] for j in range(i, i + n)])
                        held[key] = [c.langs[c.rows[i]], phrase.decode("utf-8", "replace"), n, f]
            if len(held) >= HOLD_TEXTS:
                yield told()
                held = {}
        if held:
            yield told()

    def add(table: pa.Table) -> pa.Table:
        rows = pc.list_flatten(table.column("found").combine_chunks()).flatten()
        sums = pa.table(rows, ["lang", "phrase", "words", "f"]).group_by(["lang", "phrase", "words"], use_threads=False).aggregate([("f", "sum")])
        return sums.filter(pc.greater_equal(sums["f_sum"], at_least)).rename_columns(["lang", "phrase", "words", "f"])

    kind = "lang string, phrase string, words int, f bigint"
    found = chunks.mapInArrow(count_texts, f"bucket int, found array<struct<{kind.replace(' ', ':').replace(',:', ',')}>>")
    found = settle(found.groupBy("bucket").applyInArrow(add, kind))
    return found, totals


def collocations(docs: DataFrame, longest: int = 5, at_least: int = 100, top: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of each language that hold together best.

    A phrase of 2 to ``longest`` words found ``at_least`` times is cut in two
    where floor(1000 * a * n / (l * r)) is least (a, l and r: occurrences of
    the phrase and of its two parts, n: words of the language), at the first
    such place.  Phrases that stand inside a longer one as frequent are left
    out; of the others the ``top`` by score, then a, then phrase are returned,
    which is the report this gives.  Words are runs without blanks or tabs;
    null texts have none, a null language is ``und``; rows that repeat count
    each time.  An empty table gives no rows.  Phrases count as equal by a
    64-bit key within a batch, by their text between batches.
    """
    counts, totals = phrase_counts(docs, longest, at_least, lang, text)
    candidates = counts.where(F.col("words") >= 2).select("lang", "phrase", "words", F.col("f").alias("a"))
    cuts = candidates.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", F.expr("substring_index(phrase, ' ', k)").alias("left_part"), F.expr("substring_index(phrase, ' ', k - words)").alias("right_part"))
    left = counts.select("lang", F.col("phrase").alias("left_part"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right_part"), F.col("f").alias("r"))
    exact = {x: F.col(x).cast("decimal(18,0)") for x in ("a", "n", "l", "r")}
    thousand = F.lit(1000).cast("decimal(4,0)")
    scored = (
        cuts.join(left, ["lang", "left_part"])
        .join(right, ["lang", "right_part"])
        .join(F.broadcast(totals) if totals.count() <= FEW_LANGUAGES else totals, "lang")
        .select("*", (thousand * (exact["a"] * exact["n"])).alias("_over"), (exact["l"] * exact["r"]).alias("_under"))
        .withColumn("score", F.expr("_over div _under"))
    )
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("best"))
    word = F.split("phrase", " ")
    inner = [
        F.when(F.col("words") >= i + n, F.array_join(F.slice(word, i + 1, n), " ")) for n in range(2, longest) for i in range(longest - n + 1)
    ]
    whole = candidates.where(F.col("words") > 2).select("lang", F.col("phrase").alias("_whole"), "a", F.explode(F.array_compact(F.array(*inner))).alias("phrase"))
    within = whole.where(F.col("phrase") != F.col("_whole")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(within, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") < F.col("best.a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("best.a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "best.a", "best.l", "best.r", "best.n", "best.score")
