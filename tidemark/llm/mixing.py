"""Mixing by soft domain membership (DataFrame functions only).

A naive Bayes classifier over hashed words, fitted on a bounded sample of a
labelled table, gives every document a posterior over domains.  A distributed
projected-gradient least-squares fit then finds non-negative document rates
whose expected token totals by domain match the targets.  The driver sees the
classifier's table (buckets x domains), and a few totals in each step.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, words

BUCKETS = 4096
SAMPLE = 20_000
#: The domains of the standard tables (language and quality label) and the weights to reach.
TARGETS = {
    "en-high": 0.50, "en-low": 0.05,
    "de-high": 0.14, "de-low": 0.02,
    "fr-high": 0.14, "fr-low": 0.02,
    "es-high": 0.11, "es-low": 0.02,
}


def _tokens(docs: DataFrame, keep: list[Column], text: str, buckets: int) -> DataFrame:
    """A row for each word: ``keep`` and the word's bucket.

    What ``keep`` works out is settled before the words are spread, or it
    would be worked out again, and the whole text carried, for each word.
    """
    whole = docs.select(*keep, words(F.col(text)).alias("_words"))
    split = whole.select(*whole.columns[:-1], F.explode("_words").alias("_w"))
    return split.withColumn("_b", F.pmod(F.xxhash64("_w"), F.lit(buckets)).cast("int")).drop("_w")


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = SAMPLE, buckets: int = BUCKETS, id_col: str = "doc_id", text: str = "text") -> tuple[list[float], list[list[float]]]:
    """(log prior by domain, for each domain the log odds of each bucket), from at most about ``sample`` labelled rows.

    ``labelled`` has the id and ``domain``; rows of other domains are passed
    over.  Word odds are against all domains together, and a bucket that no
    labelled row uses says nothing.
    """
    rows = labelled.where(F.col("domain").isin(domains))
    sizes = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    share = min(1.0, sample / total) if total else 1.0
    drawn = rows.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(share * 1_000_000)).select(
        F.col(id_col).alias("_id"), F.col("domain").alias("_domain")
    )
    own = docs.select(F.col(id_col), F.col(text)).join(drawn, F.col(id_col) == F.col("_id"))
    counts = _tokens(own, [F.col("_domain")], text, buckets).groupBy("_domain", "_b").agg(F.count("*").alias("n")).collect()
    table = [[0.0] * buckets for _ in domains]
    index = {d: k for k, d in enumerate(domains)}
    for r in counts:  # at most buckets x domains
        table[index[r["_domain"]]][r["_b"]] = float(r["n"])
    sums = [sum(x) for x in table]
    every = [sum(x) for x in zip(*table)]
    all_words = sum(every)
    odds = []
    for k in range(len(domains)):
        background = [e / all_words if all_words else 0.0 for e in every]
        strength = 100.0
        odds.append(
            [
                math.log((table[k][b] + strength * background[b]) / (sums[k] + strength) / background[b]) if background[b] else 0.0
                for b in range(buckets)
            ]
        )
    prior = [math.log((sizes.get(d, 0) + 0.5) / (total + 0.5 * len(domains))) for d in domains]
    return prior, odds


def posteriors(docs: DataFrame, model: tuple[list[float], list[list[float]]], id_col: str = "doc_id", text: str = "text", tempering: float = 0.5) -> DataFrame:
    """_row (hash of id and text), id, n_tokens (words), p0, p1, ...: one row per distinct (id, text).

    Sums of word odds are divided by the square root of the word count
    (``tempering`` its power), as words of a text are not independent.  A text
    without words has the prior.
    """
    prior, odds = model
    keys = [F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), F.coalesce(F.col(text), F.lit(""))).alias("_row")]
    spark, k = docs.sparkSession, range(len(odds))
    rows = [(b, *[own[b] for own in odds]) for b in range(len(odds[0]))]
    table = spark.createDataFrame(rows, "_b int, " + ", ".join(f"_o{i} double" for i in k))
    table = F.broadcast(table)  # buckets rows, a parameter
    scored = _tokens(docs, keys, text, len(odds[0])).join(table, "_b")
    found = scored.groupBy("_id", "_row").agg(F.count("*").alias("n_tokens"), *[F.sum(f"_o{i}").alias(f"_s{i}") for i in k])
    return _soft(found, prior, tempering)


def _soft(found: DataFrame, prior: list[float], tempering: float) -> DataFrame:
    scale = F.greatest(F.col("n_tokens"), F.lit(1)) ** F.lit(tempering)
    logits = found.select("_id", "_row", "n_tokens", *[(F.col(f"_s{k}") / scale + p).alias(f"_z{k}") for k, p in enumerate(prior)])
    top = F.greatest(*[F.col(f"_z{k}") for k in range(len(prior))]) if len(prior) > 1 else F.col("_z0")
    weights = logits.select("_id", "_row", "n_tokens", *[F.exp(F.col(f"_z{k}") - top).alias(f"_e{k}") for k in range(len(prior))])
    total = reduce(lambda a, b: a + b, [F.col(f"_e{k}") for k in range(len(prior))])
    return weights.select("_id", "_row", "n_tokens", *[(F.col(f"_e{k}") / total).alias(f"p{k}") for k in range(len(prior))])


def _top_eigenvalue(h: list[list[float]], rounds: int = 100) -> float:
    v = [1.0] * len(h)
    size = 0.0
    for _ in range(rounds):
        w = [sum(a * b for a, b in zip(row, v)) for row in h]
        size = math.sqrt(sum(x * x for x in w))
        if not size:
            return 0.0
        v = [x / size for x in w]
    return size


def fit_rates(members: DataFrame, targets: list[float], steps: int = 40, tolerance: float = 1e-3, settle_every: int = 10) -> DataFrame:
    """``members`` (n_tokens, p0, p1, ...) with ``rate``: min sum_k w_k (sum_d rate_d n_d p_dk - target_k)^2, rate >= 0.

    Starts at 1 and steps in the metric of the token counts, so that long and
    short documents of like content get like rates; w_k is one over domain k's
    part of the curvature.  Each step is one aggregate of K sums.  It ends
    after ``steps``, or once each total that some document can move is within
    ``tolerance`` of all tokens; target_gap, the largest distance from a target
    as a share of all tokens, tells how near it came.
    """
    k = range(len(targets))
    p = [F.col(f"p{i}") for i in k]
    n = F.col("n_tokens").cast("double")
    row = members.agg(F.sum(n).alias("n"), *[F.sum(n * p[i] * p[j]).alias(f"h{i}_{j}") for i in k for j in k if j >= i]).first()
    state, gap = members.withColumn("rate", F.lit(1.0)), None
    if not row["n"]:
        return state.withColumn("target_gap", F.lit(None).cast("double"))
    h = [[row[f"h{min(i, j)}_{max(i, j)}"] for j in k] for i in k]
    w = [1 / h[i][i] if h[i][i] > 1e-9 * row["n"] else 0.0 for i in k]
    top = _top_eigenvalue([[math.sqrt(w[i] * w[j]) * h[i][j] for j in k] for i in k])
    for step in range(1, steps + 2):
        now = state.agg(*[F.sum(F.col("rate") * n * p[i]).alias(f"s{i}") for i in k]).first()
        off = [now[i] - targets[i] for i in k]
        gap = max(abs(x) for x in off) / row["n"]
        if not top or step > steps or max(abs(x) for x, own in zip(off, w) if own) <= tolerance * row["n"]:
            break
        move = reduce(lambda a, b: a + b, [p[i] * (w[i] * off[i] / top) for i in k])
        state = state.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") - move))
        if step % settle_every == 0:
            state = settle(state)
    return state.withColumn("target_gap", F.lit(gap).cast("double"))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, budget: float = 1.0, id_col: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """id, n_tokens, rate, copies, target_gap, domain (the likeliest) and p0.. of every row of ``docs``.

    The totals aimed at are ``targets`` (scaled to sum 1) times ``budget``
    times all tokens.  copies is the rate rounded up or down by a hash of the
    id, so that its expectation is the rate.  A text without words has no
    tokens, the prior as posterior, and rate 1.  Rows that repeat an id and a
    text share their rate and count once in the fit; an empty table gives no
    rows, and without labelled rows all posteriors are alike and stay so.
    With ``whole``, _doc is the row of ``docs`` itself, as a struct.
    """
    names = list(targets)
    model = fit_classifier(docs, labelled, names, id_col=id_col, text=text)
    rows = settle(posteriors(docs, model, id_col, text))
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    scale = budget * total / sum(targets.values())
    fitted = settle(fit_rates(rows, [targets[d] * scale for d in names]))
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")] if whole else []
    key = docs.select(F.col(id_col), F.xxhash64(F.col(id_col), F.coalesce(F.col(text), F.lit(""))).alias("_key"), *carried)
    joined = key.join(fitted.withColumnRenamed("_id", "_fid"), (F.col("_key") == F.col("_row")) & F.col(id_col).eqNullSafe(F.col("_fid")), "left")
    prior = [math.exp(x) for x in model[0]]
    p = [F.coalesce(F.col(f"p{k}"), F.lit(x / sum(prior))).alias(f"p{k}") for k, x in enumerate(prior)]
    out = joined.select(id_col, F.coalesce("n_tokens", F.lit(0).cast("long")).alias("n_tokens"), F.coalesce("rate", F.lit(1.0)).alias("rate"), "target_gap", *p, *(["_doc"] if whole else []))
    chance = F.pmod(F.xxhash64(F.lit(11), id_col), F.lit(1_000_000)) / 1_000_000
    best = F.greatest(*[F.col(f"p{k}") for k in range(len(names))]) if len(names) > 1 else F.col("p0")
    domain = F.coalesce(*[F.when(F.col(f"p{k}") == best, F.lit(d)) for k, d in enumerate(names)])
    whole = F.floor("rate")
    return out.withColumn("copies", (whole + (chance < F.col("rate") - whole).cast("int")).cast("long")).withColumn("domain", domain)
