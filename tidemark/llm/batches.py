"""Words of Arrow batches as arrays of 64-bit keys, and weighted keys counted in packed buckets.

Millions of keys travel as a few rows: a task sorts its keys, deals them into
buckets by their highest bits and writes each bucket as differences, cut into
byte planes that compress well.  Spark shuffles and groups the buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

PACKED = "bucket int, keys binary, counts binary"
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_STEP, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
WORD, BLANK, BREAK = 0, 1, 2


def byte_kinds(blanks: str, breaks: str = "") -> np.ndarray:
    """For each byte whether it is of a word, blank, or ends a piece of text."""
    kinds = np.zeros(256, np.uint8)
    kinds[list(blanks.encode())] = BLANK
    kinds[list(breaks.encode())] = BREAK
    return kinds


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one map of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Words:
    """Words of some texts in order: 64-bit keys, first byte and byte after the last in ``body``, their text, and their piece."""

    body: np.ndarray
    keys: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    pieces: np.ndarray


def split_words(texts: pa.Array, kinds: np.ndarray) -> Words:
    """Words of ``texts`` with A-Z lower-cased; null texts have none.  A piece ends at a break byte and with its text."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(texts) else np.zeros(0, np.uint8)
    at = ends - ends[0] if len(texts) else np.zeros(1, np.int64)
    body = _LOWER[body]
    kind = kinds[body]
    inside = np.zeros(len(body) + 2, bool)
    inside[1:-1] = kind == WORD
    begins = inside[1:-1] & ~inside[:-2]
    edges = at[:-1][at[:-1] < len(body)]
    begins[edges] = inside[1:-1][edges]  # a text that starts with a word after one that ends with a word
    starts = np.flatnonzero(begins)
    stops = ~inside[2:]
    stops[edges[edges > 0] - 1] = True
    last = np.flatnonzero(inside[1:-1] & stops) + 1
    rows = np.searchsorted(at, starts, "right") - 1
    pieces = np.cumsum(kind == BREAK, dtype=np.int64)[starts] + rows if BREAK in kinds else rows
    return Words(body, _word_keys(body, starts, last), starts, last, rows, pieces)


def _word_keys(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word, eight bytes at a step."""
    keys = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return keys
    padded = np.concatenate((body, np.zeros(8, np.uint8)))
    eights = np.ndarray((len(body) + 1,), "<u8", padded, strides=(1,))
    at, left, own = starts, ends - starts, slice(None)
    while len(at):
        part = eights[at] & _MASKS[np.minimum(left, 8)]
        keys[own] = mixed(keys[own] * _STEP + part + left.astype(np.uint64) * _LENGTH)
        more = np.flatnonzero(left > 8)
        own = more if isinstance(own, slice) else own[more]
        at, left = at[more] + 8, left[more] - 8
    return keys


def planes(x: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers by byte planes, empty high planes left out."""
    wide = int(x.max()).bit_length() + 7 >> 3 if len(x) else 0
    return bytes([wide]) + len(x).to_bytes(4, "little") + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes()


def unplaned(data: bytes) -> np.ndarray:
    wide, n = data[0], int.from_bytes(data[1:5], "little")
    full = np.zeros((n, 8), np.uint8)
    full[:, :wide] = np.frombuffer(data, np.uint8, wide * n, 5).reshape(wide, n).T
    return full.reshape(-1).view("<u8").astype(np.uint64, copy=False)


def pack_sorted(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unplaned(data), dtype=np.uint64)


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    if counts is None:
        found, n = np.unique(keys, return_counts=True)
        return found, n.astype(np.uint64)
    order = np.argsort(keys)
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(counts[order], heads) if len(heads) else np.zeros(0, np.uint64)


def merged(sorted_keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of several sorted lists, the sums of their counts, and the places of each list's keys among them."""
    keys = np.sort(np.concatenate(sorted_keys))
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
    sums, places = np.zeros(len(keys), np.uint64), []
    for own, n in zip(sorted_keys, counts):
        places.append(np.searchsorted(keys, own))
        sums[places[-1]] += n
    return keys, sums, places


def bucket_bits(tokens: int, partitions: int, each: int = 1 << 16) -> int:
    """Bits for buckets of about ``each`` keys, but four for a shuffle partition at most: a task's keys shall fill them."""
    return min(max(tokens // each, 1).bit_length(), (4 * partitions - 1).bit_length())


def buckets_of(keys: np.ndarray, bits: int, wide: int = 64) -> Iterator[tuple[int, slice]]:
    """(bucket, its place) of sorted keys of ``wide`` bits dealt by their highest ``bits``."""
    owner = (keys >> np.uint64(wide - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(keys) else []
    for head, stop in zip(heads, [*heads[1:], len(keys)]):
        yield int(owner[head]), slice(int(head), int(stop))


def packed_batch(keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted keys and their counts as one row a bucket."""
    cut = list(buckets_of(keys, bits))
    return pa.RecordBatch.from_arrays(
        [pa.array([b for b, _ in cut], pa.int32()), pa.array([pack_sorted(keys[s]) for _, s in cut], pa.binary()), pa.array([planes(counts[s]) for _, s in cut], pa.binary())],
        ["bucket", "keys", "counts"],
    )


def count_keys(rows: DataFrame, of_batch: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray | None]]], bits: int, hold: int = 1 << 20) -> DataFrame:
    """(bucket, keys, counts), one row a bucket: the keys that ``of_batch`` draws from ``rows``, with the sums of their weights (none: one each).

    A task adds up ``hold`` keys before it hands them on, so that a key that is
    everywhere costs it a few entries.
    """

    def told(kept: list[tuple[np.ndarray, np.ndarray | None]]) -> pa.RecordBatch:
        keys = np.concatenate([k for k, _ in kept])
        weights = None if kept[0][1] is None else np.concatenate([n for _, n in kept])
        return packed_batch(*summed(keys, weights), bits)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            for drawn in of_batch(batch):
                kept.append(drawn)
                size += len(drawn[0])
                if size >= hold:
                    yield told(kept)
                    kept, size = [], 0
        if size:
            yield told(kept)

    def merge(table: pa.Table) -> pa.Table:
        keys, counts, _ = merged([unpack_sorted(x) for x in table.column("keys").to_pylist()], [unplaned(x) for x in table.column("counts").to_pylist()])
        return pa.table({"bucket": table.column("bucket").combine_chunks()[:1], "keys": pa.array([pack_sorted(keys)], pa.binary()), "counts": pa.array([planes(counts)], pa.binary())})

    return rows.mapInArrow(parts, PACKED).groupBy("bucket").applyInArrow(merge, PACKED)
