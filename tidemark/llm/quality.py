"""Quality rules with host-level verdicts (DataFrame functions only).

Every document gets its base figures in one projection, without a shuffle.
The failures of each rule are then counted by host, the failure rates are
shrunk with a beta prior of the rule, fitted to all hosts by moments, and hosts
of which a shrunk rate is above a limit lose all their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_BLANK, let, settle, words

SYMBOLS = "[#*$%&|<>]"
#: The rules that are counted by host: too few words, and too many of them in windows that repeat.
RULES = {"short": "n_words < 10", "repetitive": "100 * n_repeat_words > 20 * n_words"}


def repeated_words(tokens: Column, width: int = 5) -> Column:
    """Words inside ``width``-word windows that occur at least twice in ``tokens``.

    Windows are compared by a chained 64-bit hash of their words.  Only texts
    that have a repeated window pay for sorting windows with their positions.
    """

    def windows(h: Column) -> Column:
        return F.when(
            F.size(h) >= width,
            F.transform(
                F.slice(h, F.lit(1), F.size(h) - (width - 1)),
                lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, width)]),
            ),
        ).otherwise(F.array().cast("array<bigint>"))

    def places(sorted_windows: Column) -> Column:
        twice = F.filter(
            sorted_windows,
            lambda e, j: (F.get(sorted_windows, j - 1)["w"] == e["w"])
            | (F.get(sorted_windows, j + 1)["w"] == e["w"]),
        )
        return F.sort_array(F.transform(twice, lambda e: e["at"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - x, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def count(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("w"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(
            let(ordered, lambda s: let(places(s), covered))
        )

    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: let(windows(h), count))


def base_figures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """``keep`` and, per document, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (all long) and base_failed.

    A null or empty text has no words, all its figures are zero and it fails.
    Repeated rows are judged one by one.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(NOT_BLANK))
    split = docs.select(*keep, body.alias("_body"), words(F.col(text)).alias("_words"), lines.alias("_lines"))
    figures = split.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_body", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
    )
    return figures.withColumn("base_failed", F.expr(" OR ".join(RULES.values())))


def beta_prior(hosts: DataFrame, failed: str = "failed") -> tuple[float, float]:
    """(alpha, beta) by moments from a table of hosts (n and a count of failures); one row reaches the driver.

    Without hosts, or where their rates do not differ, the prior is as strong
    as one average host, at the overall rate.
    """
    rate = F.col(failed) / F.col("n")
    row = hosts.agg(
        F.sum(failed).alias("failed"), F.sum("n").alias("n"), F.count("*").alias("hosts"), F.var_pop(rate).alias("var")
    ).first()
    if not row["n"]:
        return 1.0, 1.0
    mean = min(max(row["failed"] / row["n"], 1e-6), 1 - 1e-6)
    average = row["n"] / row["hosts"]
    strength = mean * (1 - mean) / row["var"] - 1 if row["var"] and row["var"] > 0 else average
    strength = min(max(strength, 1.0), max(average, 1.0))
    return mean * strength, (1 - mean) * strength


def judge_hosts(docs: DataFrame, host: str = "source", text: str = "text", id_col: str = "doc_id", factor: float = 3.0) -> DataFrame:
    """Base figures of every document with its host's shrunk failure rates and the verdict ``kept``.

    host_<rule> is the host's shrunk rate of each rule, host_rate the greatest
    of them.  Hosts are judged against the others: one is bad if by some rule
    its shrunk rate, less two standard deviations of its posterior, is over
    ``factor`` times the rate of the corpus, or over a half.  A document is
    kept if it passes the base rules and its host is not bad.  Documents without a host share one.  An empty table
    gives an empty result.  Hosts are aggregated with map-side partial counts,
    so a host with a third of all rows is one small row per task.
    """
    figures = settle(base_figures(docs, text, (id_col, host)))
    failures = [F.count_if(F.expr(failed)).alias(rule) for rule, failed in RULES.items()]
    hosts = settle(figures.groupBy(host).agg(F.count("*").alias("n"), *failures))
    rates = hosts.select(F.col(host).alias("_host"), "n", *RULES)
    bad = F.lit(False)
    for rule in RULES:
        alpha, beta = beta_prior(hosts, rule)
        rates = rates.withColumn(f"host_{rule}", (F.col(rule) + alpha) / (F.col("n") + alpha + beta))
        rate = F.col(f"host_{rule}")
        least = rate - 2 * F.sqrt(rate * (1 - rate) / (F.col("n") + alpha + beta + 1))
        bad = bad | (least > min(factor * alpha / (alpha + beta), 0.5))
    rates = rates.select("_host", *[f"host_{r}" for r in RULES], F.greatest(*[f"host_{r}" for r in RULES]).alias("host_rate"), bad.alias("host_bad"))
    return (
        figures.join(rates, F.col(host).eqNullSafe(F.col("_host")), "left")
        .drop("_host")
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_bad"))
    )
