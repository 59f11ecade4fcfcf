"""Token counts by linear longest match.

The vocabulary's pieces form a trie over bytes.  Each node has a failure link
and the number of pieces popped on following it, both computed once; a word is
then counted in one pass over its bytes, without backing up and without
building a piece.  The file format is that of a tokenizers JSON file whose
pieces mark a word's end with ``</w>``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_batches

WORD = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
END, SHIFT = 256, 9
CACHE_ENTRIES = 300_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, then from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Counts the pieces of greedy longest match."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        step: dict[int, int] = {}
        whole = [False]
        parent: list[tuple[int, int]] = [(0, 0)]
        for piece in pieces:
            node = 0
            for c in piece:
                key = node << SHIFT | c
                if key not in step:
                    step[key] = len(whole)
                    whole.append(False)
                    parent.append((node, c))
                node = step[key]
            whole[node] = bool(piece)
        alone = END not in step  # no piece is the end mark by itself: left alone, it then counts nothing
        if alone:
            step[END] = len(whole)
            whole.append(True)
            parent.append((0, END))
        depth = [0] * len(whole)
        for v in range(1, len(whole)):
            depth[v] = depth[parent[v][0]] + 1
        fail, pops = [-1] * len(whole), [0] * len(whole)
        for v in sorted(range(1, len(whole)), key=depth.__getitem__):
            if whole[v]:
                fail[v], pops[v] = 0, int(not (alone and v == step[END]))
                continue
            u, c = parent[v]
            z, popped = fail[u], pops[u]
            while z >= 0 and (z << SHIFT | c) not in step:
                popped += pops[z]
                z = fail[z]
            if z >= 0:
                fail[v], pops[v] = step[z << SHIFT | c], popped
        self.step, self.fail, self.pops = step, fail, pops

    def count(self, word: bytes) -> int:
        """Pieces of a word, or -1 where longest match gets stuck."""
        step, fail, pops, node, n = self.step, self.fail, self.pops, 0, 0
        for c in (*word, END):
            while (to := step.get(node << SHIFT | c, -1)) < 0:
                if fail[node] < 0:
                    return -1
                n += pops[node]
                node = fail[node]
            node = to
        while node:
            if fail[node] < 0:
                return -1
            n += pops[node]
            node = fail[node]
        return n


def load_pieces(path: str) -> list[tuple[int, ...]]:
    """Pieces as byte tuples, with 256 for the end of a word; special tokens are left out."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    special, letters = {t["content"] for t in spec.get("added_tokens", [])}, byte_letters()
    out = []
    for token in spec["model"]["vocab"]:
        if token not in special:
            stem = token.removesuffix("</w>")
            out.append((*[letters[c] for c in stem], *([END] if stem != token else [])))
    return out


_COUNTERS: dict[str, tuple[Automaton, dict[str, int]]] = {}


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_words, n_tokens, n_unknown (long) of every row, by whole text.

    Words are those of lower-cased text: contractions, letter runs, single
    digits, runs of other signs.  Where the rest of a word is its end mark and
    no piece is that, the mark counts nothing; a word that cannot be matched is
    one unknown token.  Null and empty texts count zero; repeated rows are counted one by
    one; other columns are not read.
    """
    spark = docs.sparkSession
    pieces = spark.sparkContext.broadcast(load_pieces(vocabulary_path))  # a vocabulary of fixed size
    arrow_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary_path not in _COUNTERS:
            _COUNTERS[vocabulary_path] = (Automaton(pieces.value), {})
        automaton, known = _COUNTERS[vocabulary_path]
        for batch in batches:
            figures = [[], [], []]
            for t in batch.column(1).to_pylist():
                words = WORD.findall((t or "").lower())
                new = [w for w in dict.fromkeys(words) if w not in known]
                if new and len(known) > CACHE_ENTRIES:
                    known.clear()
                    new = list(dict.fromkeys(words))
                for w in new:
                    known[w] = automaton.count(w.encode("utf-8", "surrogatepass"))
                counts = list(map(known.__getitem__, words))
                unknown = counts.count(-1)
                for x, y in zip(figures, (len(words), sum(counts) + 2 * unknown, unknown)):
                    x.append(y)
            data = [batch.column(0), *[pa.array(x, pa.int64()) for x in figures]]
            yield pa.RecordBatch.from_arrays(data, [id_col, "n_words", "n_tokens", "n_unknown"])

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_tokens bigint, n_unknown bigint")
