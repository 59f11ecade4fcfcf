"""Packing token sequences by shortest-pack-first over the length histogram.

Documents are tokenized once, in tasks, and cut into pieces of at most the
capacity.  Only the histogram of piece lengths (at most ``capacity`` rows)
reaches the driver, where lengths are placed longest first into the emptiest
pattern that takes them, a whole count at a time.  The pieces, ranked within
their length by a distributed sort, then find their pattern, sequence and
offset by that rank.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, settle

CAPACITY = 4096
END_ID = 2
CACHE_ENTRIES = 150_000
#: Text that is encoded at once, so that a word is looked up once for all its places there.
BATCH_BYTES = 16 << 20
#: What the tokenizer takes for one word, on lower-cased text of the first 256 code points.
_LETTER, _NUMBER, _SPACE = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_RUN = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


def _latin(text: str) -> bool:
    """Only code points under 256, where normalization is lower case alone, one letter for one."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordEncoder:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes, with a bounded cache by blank-separated chunk.

    The tokenizer drops white space, lower-cases, and none of its tokens
    crosses the border of a word, so the ids of a text are those of its chunks
    in a row, and those of a chunk are those of its words.  A full cache
    becomes the elder one, from which entries in use come back.
    """

    def __init__(self, spec: str, cache_entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer, self.cache, self.elder, self.most = Tokenizer.from_str(spec), {}, {}, cache_entries
        vocabulary = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _each(self, texts: list[str]) -> None:
        for c, e in zip(texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            self.cache[c] = np.array(e.ids, "<u4").tobytes()

    def _words(self, words: list[str]) -> None:
        """Words of Latin chunks, many in one string: each ends with one token that ends a word."""
        cache = self.cache
        groups = [words[at : at + 100] for at in range(0, len(words), 100)]
        for some, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(x) for x in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            stops = np.flatnonzero(self.word_end[ids]) + 1
            if len(stops) != len(some):
                self._each(some)
                continue
            body, from_ = ids.tobytes(), 0
            for w, to in zip(some, (4 * stops).tolist()):
                cache[w] = body[from_:to]
                from_ = to

    def _fresh(self, chunks: list[str]) -> None:
        cache, elder = self.cache, self.elder
        made, words, others = {}, {}, []
        for c in chunks:
            if c in elder:
                cache[c] = elder[c]
            elif c.isascii() and c.isalpha():
                words[c] = None
            elif not _latin(c):
                others.append(c)
            else:
                own = made[c] = _RUN.findall(c)
                for w in own:
                    if w not in cache and w not in words:
                        if w in elder:
                            cache[w] = elder[w]
                        else:
                            words[w] = None
        self._words(list(words))
        self._each(others)
        for c, own in made.items():
            if len(own) != 1 or own[0] != c:
                cache[c] = b"".join([cache[w] for w in own])

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; a null one has none."""
        chunks = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = chunks.flatten().dictionary_encode()
        names = pc.if_else(pc.string_is_ascii(coded.dictionary), pc.ascii_lower(coded.dictionary), coded.dictionary).to_numpy(False).tolist()
        for k in pc.indices_nonzero(pc.invert(pc.string_is_ascii(coded.dictionary))).to_pylist():
            if _latin(names[k]):
                names[k] = names[k].lower()
        if len(self.cache) > self.most:
            self.elder, self.cache = self.cache, {}
        cache = self.cache
        self._fresh([c for c in dict.fromkeys(names) if c not in cache])
        parts = list(map(cache.__getitem__, names))
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        start, ids = np.cumsum(size) - size, np.frombuffer(b"".join(parts), "<u4")
        which = coded.indices.to_numpy()
        size, start = size[which], start[which]
        ends = np.cumsum(size)
        every = ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)]
        cuts = np.concatenate(([0], ends))[chunks.offsets.to_numpy()]
        return [every[a:b].tobytes() for a, b in zip(cuts.tolist(), cuts[1:].tolist())]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text: str = "text", digest_only: bool = False) -> DataFrame:
    """Pieces of every document: id, start, length, doc_tokens, ids_crc32 (long) and ids (binary, 4 bytes an id).

    ``digest_only`` leaves the ids in the task that made them.

    A document is the ids of its whole text and ``end_id``; a null or empty
    text is ``end_id`` alone.  Each piece but the last has ``capacity`` ids.
    Rows that repeat an id are packed one by one.
    """
    spec = Path(tokenizer_path).read_text(encoding="utf-8")  # a vocabulary file of fixed size
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    arrow_batches(docs.sparkSession, 500)
    kind, step, end = docs.schema[id_col].dataType.simpleString(), 4 * capacity, end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.disable()  # nothing here has cycles, and walking the cache takes a fifth of the time
        encoder = worker_encoder(shared.value)
        for table in gathered(batches, BATCH_BYTES):
            rows, start, total, ids, crc = [], [], [], [], []
            for k, body in enumerate(encoder.encode(table.column(1).combine_chunks())):
                body += end
                for at in range(0, len(body), step):
                    rows.append(k)
                    start.append(at // 4)
                    total.append(len(body) // 4)
                    ids.append(body[at : at + step])
                    crc.append(zlib.crc32(ids[-1]))
            numbers = (start, [len(x) // 4 for x in ids], total, crc)
            out = [table.column(0).take(pa.array(rows, pa.int64())).combine_chunks(), *[pa.array(x, pa.int64()) for x in numbers]]
            yield pa.RecordBatch.from_arrays(out if digest_only else [*out, pa.array(ids, pa.binary())], names)

    names = [id_col, "start", "length", "doc_tokens", "ids_crc32", *([] if digest_only else ["ids"])]
    schema = f"`{id_col}` {kind}, start bigint, length bigint, doc_tokens bigint, ids_crc32 bigint" + ("" if digest_only else ", ids binary")
    return docs.select(id_col, text).mapInArrow(run, schema)


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Batches put together until they have ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.nbytes for x in held) >= size:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


_ENCODERS: dict[int, WordEncoder] = {}


def worker_encoder(spec: str) -> WordEncoder:
    """One encoder for each Python worker, kept between tasks."""
    key = hash(spec)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(spec)
    return _ENCODERS[key]


Pattern = tuple[tuple[int, int], ...]


def _stacked(pattern: Pattern, length: int, k: int) -> Pattern:
    """``pattern``, a run-length list of (length, how many), with ``k`` more pieces of ``length``."""
    if pattern and pattern[-1][0] == length:
        return (*pattern[:-1], (length, pattern[-1][1] + k))
    return (*pattern, (length, k))


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) patterns that hold each length as often as ``histogram`` says; see :func:`pack_runs`."""
    return [(count, tuple(length for length, k in runs for _ in range(k))) for count, runs in pack_runs(histogram, capacity)]


def pack_runs(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, Pattern]]:
    """(count, runs of (length, how many)) patterns that hold each length as often as ``histogram`` says.

    Lengths go longest first into the pattern with the most room, while it has
    room; else they open a pattern, on which the same length is stacked until
    it is full.  Each length splits a pattern a few times at most, so there
    are some three patterns a distinct length at most, however many pieces.
    """
    open_packs: dict[int, list[tuple[int, Pattern]]] = defaultdict(list)
    fills: list[int] = []
    done: list[tuple[int, Pattern]] = []

    def put(count: int, pattern: Pattern, fill: int) -> None:
        if fill == capacity:
            done.append((count, pattern))
            return
        if not open_packs[fill]:
            heapq.heappush(fills, fill)
        open_packs[fill].append((count, pattern))

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not within 1 and {capacity}")
        need = histogram[length]
        room = sum((capacity - fill) // length * count for fill in fills for count, _ in open_packs[fill])
        while need:
            if not fills or fills[0] + length > capacity:
                most = capacity // length
                for count, k in ((need // most, most), (1, need % most)):
                    if count and k:
                        put(count, ((length, k),), k * length)
                break
            fill = fills[0]
            count, pattern = open_packs[fill].pop()
            if not open_packs[fill]:
                heapq.heappop(fills)
            k = (capacity - fill) // length
            if need < room and fills:  # not all are filled: stack until another one has more room
                k = min(k, max(1, -((fill - fills[0]) // length)))
            k = max(1, min(k, need // count))
            used = min(count, need)
            if used < count:
                put(count - used, pattern, fill)
            put(used, _stacked(pattern, length, k), fill + k * length)
            need -= used * k
            room -= used * k
    return done + [x for packs in open_packs.values() for x in packs]


def slot_table(patterns: list[tuple[int, Pattern]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces a sequence, first sequence, offset): which ranks of a length sit where."""
    slots, taken, sequence = [], defaultdict(int), 0
    for count, pattern in sorted(patterns, key=lambda x: (x[1], x[0]), reverse=True):
        offset = 0
        for length, k in pattern:
            slots.append((length, taken[length], taken[length] + k * count, k, sequence, offset))
            taken[length] += k * count
            offset += k * length
        sequence += count
    return slots


def ranked(pieces: DataFrame, order: list[str]) -> DataFrame:
    """``pieces`` with ``rank``, from 0 within each length in the given order, without one task for a common length.

    A range partitioning by (length, order) cuts common lengths; ranks within
    a partition are added to the counts of the partitions before it.
    """
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = settle(pieces.repartitionByRange(parts, "length", *order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_part").orderBy(*order)
    return (
        placed.withColumn("_k", F.row_number().over(within) - 1)
        .join(offsets, ["length", "_part"])
        .withColumn("rank", F.col("_before") + F.col("_k"))
        .drop("_part", "_k", "_before")
    )


def place(pieces: DataFrame, capacity: int = CAPACITY, order: list[str] | None = None) -> DataFrame:
    """``pieces`` (with a ``length``, 1 to ``capacity``) and their sequence_id and offset, gapless from 0.

    ``pieces`` is read twice: settle it first if it is costly.  No pieces give
    no rows.
    """
    spark = pieces.sparkSession
    order = order or [c for c in pieces.columns if c != "length"]
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = slot_table(pack_runs(histogram, capacity))
    schema = "length bigint, _from bigint, _to bigint, _each bigint, _sequence bigint, _offset bigint"
    # Some three patterns a length, each of distinct lengths that sum up to the capacity: a bound of the capacity alone.
    table = F.broadcast(spark.createDataFrame(slots, schema))
    inside = (F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_to"))
    r = ranked(pieces, order).alias("r")
    ahead = F.col("rank") - F.col("_from")
    return (
        r.join(table.alias("s"), (F.col("r.length") == F.col("s.length")) & inside)
        .select(
            "r.*",
            (F.col("_sequence") + F.floor(ahead / F.col("_each"))).alias("sequence_id"),
            (F.col("_offset") + ahead % F.col("_each") * F.col("r.length")).alias("offset"),
        )
        .drop("rank")
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text: str = "text", digest_only: bool = False) -> DataFrame:
    """Tokenize and pack: id, start, length, doc_tokens, ids (binary), ids_crc32, sequence_id, offset, one row per piece.

    ``digest_only`` leaves the ids out, which then never reach a shuffle.
    """
    pieces = settle(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text, digest_only))
    return place(pieces, capacity, order=[id_col, "start", "ids_crc32"])
