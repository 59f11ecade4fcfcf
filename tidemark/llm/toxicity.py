"""Toxicity by multiple-instance learning.

Only documents have labels.  A logistic model scores each sentence, noisy-or
combines them (a document is toxic unless none of its sentences is), and the
model is fitted through that combination from document labels.  A sentence
without features offends nobody, and sentences of the same features count
once, so that a text is not suspect for its length.  It is then
able to say which sentences offend.

Features are lower-case words and their beginnings of 4 to 8 letters.  The fit
uses a bounded sample of labelled rows; feature counts of the sample are taken
in Spark, and only the selected features' places reach the driver.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, settle

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = range(4, 9)
CACHE_ENTRIES = 100_000


def lowered(text: str) -> tuple[str, np.ndarray | None]:
    """The lower-cased text and, where letters became several, the place in ``text`` of each of its characters and its end."""
    low = text.lower()
    if len(low) == len(text):
        return low, None
    parts = [c.lower() for c in text]
    return "".join(parts), np.append(np.repeat(np.arange(len(text)), [len(p) for p in parts]), len(text))


def features(word: str) -> list[str]:
    """The word and its beginnings, which have a ``-`` at the end."""
    return [word, *[word[:n] + "-" for n in PREFIXES if len(word) > n]]


@dataclass(frozen=True)
class Model:
    """Weights by feature and the bias of a sentence that has any."""

    weights: dict[str, float]
    bias: float

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    """Scores texts; keeps a bounded cache of the features of words."""

    def __init__(self, model: Model):
        self.weights, self.bias, self.known = model.weights, model.bias, {}

    def _of(self, word: str) -> tuple[str, ...]:
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        found = self.known[word] = tuple(f for f in features(word) if f in self.weights)
        return found

    def score(self, text: str | None) -> tuple[float, int, int, int, int]:
        """(score, offending sentences, start and length of the worst one in the text itself, its number from 0).

        A text without words scores 0 and has no worst sentence (start -1).
        Of sentences that score alike the first is the worst.
        """
        low, at_ = lowered(text or "")
        known, total, n = self.known, 0.0, 0
        words = WORD.findall(low)
        if not words:
            return 0.0, 0, -1, 0, -1
        if not any([known[w] if w in known else self._of(w) for w in words]):
            return 0.0, 0, -1, 0, -1
        worst, at, offending, seen = -math.inf, (-1, 0, -1), 0, set()
        for m in SENTENCE.finditer(low):
            own = WORD.findall(m[0])
            if not own:
                continue
            found = frozenset(f for w in own for f in (known[w] if w in known else self._of(w)))
            if found:
                z = self.bias + sum(self.weights[f] for f in sorted(found))
                if found not in seen:
                    seen.add(found)
                    total += z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))
                offending += z > 0
                if z > worst:
                    worst, at = z, (m.start(), m.end() - m.start(), n)
            n += 1
        if not offending:
            at = (-1, 0, -1)
        elif at_ is not None:
            at = (int(at_[at[0]]), int(at_[at[0] + at[1]] - at_[at[0]]), at[2])
        return -math.expm1(-total), offending, *at


def sample_labelled(labelled: DataFrame, bound: int, id_col: str, label: str) -> DataFrame:
    """(id, label, weight): at most ``bound`` rows, a third of them of label 1, in an order by hash of the id.

    weight makes up for the unequal shares that are drawn of the two labels.
    """
    ids = labelled.select(F.col(id_col), F.col(label).cast("int").alias("label")).where(
        F.col(id_col).isNotNull() & F.col("label").isNotNull()
    )
    ids = ids.groupBy(id_col).agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count("*").alias("n")).collect()}
    parts = []
    for value, most in ((1, bound // 3), (0, bound - bound // 3)):
        weight = max(counts.get(value, 0) / most, 1.0)
        drawn = ids.where(F.col("label") == value).orderBy(F.xxhash64(id_col), id_col).limit(most)
        parts.append(drawn.withColumn("weight", F.lit(float(weight))))
    return parts[0].unionByName(parts[1])


def train(docs: DataFrame, labelled: DataFrame, label: str = "toxic", bound: int = 6000, vocabulary: int = 2000, id_col: str = "doc_id", text: str = "text") -> Model:
    """Fit the model from (id, label) rows, of which at most ``bound`` are used (``vocabulary`` features).

    A feature is one that stands in at least 3 of the toxic texts and a 200th
    of them, and is over four times likelier there than in the others.

    Labels other than 0 and 1 count as missing, rows without a text as empty
    texts, and an id with several labels as its largest.  Without labelled rows of
    both kinds the model is a bias alone and scores every text near 0.
    """
    arrow_batches(docs.sparkSession, 500)
    drawn = F.broadcast(sample_labelled(labelled.where(F.col(label).isin(0, 1)), bound, id_col, label))  # at most bound rows
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text).alias("text")).join(drawn, id_col)
    rows = settle(rows.select("text", "label", "weight").dropDuplicates(["text", "label"]))  # read three times

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally = (Counter(), Counter())
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tally[y].update({f for w in set(WORD.findall((t or "").lower())) for f in features(w)})
            names = list(tally[0].keys() | tally[1].keys())
            data = [pa.array(names, pa.string()), *[pa.array([c[f] for f in names], pa.int64()) for c in tally]]
            yield pa.RecordBatch.from_arrays(data, ["feature", "neg", "pos"])

    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        return Model({}, -12.0)
    counts = rows.mapInArrow(count, "feature string, neg bigint, pos bigint").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    p, q = (F.col("pos") + 0.5) / (n_pos + 1.0), (F.col("neg") + 0.5) / (n_neg + 1.0)
    chosen = (
        counts.where((F.col("pos") >= max(3, n_pos // 200)) & (p > 4 * q))
        .orderBy((F.col("pos") * F.log(p / q)).desc(), "feature")
        .limit(vocabulary)
    )
    names = [r["feature"] for r in chosen.select("feature").collect()]
    index = {f: i for i, f in enumerate(names)}

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, which = [], []
            for t in batch.column(0).to_pylist():
                bags = {tuple(sorted({index[f] for w in WORD.findall(s) for f in features(w) if f in index})) for s in SENTENCE.findall((t or "").lower())}
                bags = sorted(bags - {()})
                at.append([k for k, found in enumerate(bags) for _ in found])
                which.append([f for found in bags for f in found])
            ints = pa.list_(pa.int32())
            data = [pa.array(at, ints), pa.array(which, ints), batch.column(1), batch.column(2)]
            yield pa.RecordBatch.from_arrays(data, ["at", "which", "label", "weight"])

    schema = "at array<int>, which array<int>, label int, weight double"
    return fit(rows.mapInArrow(places, schema).collect(), names)  # at most bound rows of feature places


@dataclass(frozen=True)
class Bags:
    """Labelled documents as bags of sentences: features of the i-th place are those of sentence[i], of document owner[sentence[i]]."""

    y: np.ndarray
    weight: np.ndarray
    owner: np.ndarray
    sentence: np.ndarray
    which: np.ndarray

    def loss(self, theta: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
        """Weighted negative log likelihood of the noisy-or with a ridge on the weights, and its gradient."""
        w, b, docs = theta[:-1], theta[-1], len(self.y)
        soft = lambda z: np.logaddexp(0, z)
        z = b + np.bincount(self.sentence, w[self.which], len(self.owner))
        none = np.bincount(self.owner, soft(z), docs)  # -log of "no sentence offends"
        any_ = np.maximum(-np.expm1(-none), 1e-12)
        value = (self.weight * np.where(self.y == 1, -np.log(any_), none)).sum() + ridge / 2 * (w * w).sum()
        slope = self.weight * np.where(self.y == 1, -np.exp(-none) / any_, 1.0)  # by ``none``
        own = slope[self.owner] / (1 + np.exp(-z))
        by_weight = np.bincount(self.which, own[self.sentence], len(w)) + ridge * w
        return float(value), np.append(by_weight, own.sum())


def fit(rows: list, names: list[str], steps: int = 400, ridge: float = 2e-4) -> Model:
    """Maximize the noisy-or likelihood by Adam, from rows of (at, which, label, weight).

    The bias stays at -5 or below: a feature alone, of no weight, shall not
    make a sentence suspect.
    """
    rows = sorted(rows, key=lambda r: (r["label"], r["which"], r["at"]))
    y = np.array([r["label"] for r in rows], float)
    weight = np.array([r["weight"] for r in rows], float)
    weight /= weight.sum()
    sizes = [1 + max(r["at"], default=-1) for r in rows]
    owner = np.repeat(np.arange(len(rows)), sizes)
    first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    sentence = np.concatenate([np.array(r["at"], int) + f for r, f in zip(rows, first)]) if rows else np.zeros(0, int)
    which = np.concatenate([np.array(r["which"], int) for r in rows]) if rows else np.zeros(0, int)
    theta = np.concatenate((np.zeros(len(names)), [-6.0]))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    bag = Bags(y, weight, owner, sentence, which)
    for step in range(1, steps + 1):
        g = bag.loss(theta, ridge)[1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        theta[-1] = min(theta[-1], -5.0)
    return Model({f: float(x) for f, x in zip(names, theta) if abs(x) > 1e-3}, float(theta[-1]))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, score, n_offending, worst_start, worst_length, worst_sentence of every row, by whole text.

    Starts and lengths count characters of the text.  Null, empty and wordless
    texts score 0.  No other column is read.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # at most ``vocabulary`` weights
    kind = docs.schema[id_col].dataType.simpleString()
    columns = [id_col, "score", "n_offending", "worst_start", "worst_length", "worst_sentence"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            found = list(zip(*map(scorer.score, batch.column(1).to_pylist()))) or [()] * 5
            data = [batch.column(0), pa.array(found[0], pa.float64()), *[pa.array(x, pa.int64()) for x in found[1:]]]
            yield pa.RecordBatch.from_arrays(data, columns)

    schema = f"`{id_col}` {kind}, score double, n_offending bigint, worst_start bigint, worst_length bigint, worst_sentence bigint"
    return docs.select(id_col, text).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
