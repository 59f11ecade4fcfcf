"""Consensus within tolerance, against groups found by sorting all values of a group."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import answering, ranks, temporal

CLAIM = "id bigint, predicate string, object_value string, as_of date"


def near(a, b):
    return abs(a - b) <= max(1e-9, 1e-9 * max(abs(a), abs(b)))


def expected(rows):
    """Counts of each side, by predicate: runs of sorted numbers, other values by themselves."""
    numbers, others = defaultdict(list), defaultdict(lambda: defaultdict(list))
    for i, p, v in rows:
        try:
            numbers[p].append((float(v), i))
        except (TypeError, ValueError):
            others[p][v or ""].append(i)
    found = defaultdict(list)
    for p, own in numbers.items():
        last = None
        for x, i in sorted(own):
            if last is None or not near(last, x):
                found[p].append([])
            found[p][-1].append(i)
            last = x
    for p, own in others.items():
        found[p] += own.values()
    return {(p, min(ids), len(ids)) for p, all_ in found.items() for ids in all_ if sum(map(len, all_)) > 1}


def test_numbers_within_tolerance_are_one_side(spark):
    rng, rows = random.Random(3), []
    values = ["1.000000000005", "1.0000000000049", "1", "1.00000001", "-7", "-7.000000001", "250000000", "250000000.1", "250000001", "0", "0.0000000005", "plan b", "plan c", None]
    for i in range(400):
        rows.append((i, rng.choice(["p", "q", None]), rng.choice(values)))
    rows += [(1000, "alone", "5"), (1001, "pair", "2"), (1002, "pair", "2.0")]
    df = spark.createDataFrame([(*r, None) for r in rows], CLAIM)
    got = {(r["predicate"], r["least_id"], r["n"]) for r in temporal.consensus(df).collect()}
    assert got == expected(rows)
    keyed = temporal.value_keys(df, ["predicate"]).groupBy("predicate", "value_key").agg(F.min("id").alias("least_id"), F.count("*").alias("n"))
    assert got == {(r["predicate"], r["least_id"], r["n"]) for r in keyed.collect() if r["predicate"] != "alone"}
    assert temporal.consensus(df.limit(0)).count() == 0


def test_runs_go_on_across_pieces(spark):
    """One group over all partitions, in which runs cross their borders."""
    rng = random.Random(8)
    xs, x = [], 0
    for _ in range(3000):
        x += 1 if rng.random() < 0.995 else 5
        xs.append(x)
    df = spark.createDataFrame([("g", x) for x in rng.sample(xs, len(xs))], "k string, x bigint").repartition(7)
    got = {r["x"]: r["run"] for r in ranks.runs_within(df, ["k"], "x", lambda a, b: b - a <= 1).collect()}
    run, want = 0, {}
    for at, x in enumerate(xs):
        run += at == 0 or x - xs[at - 1] > 1
        want[x] = run
    assert got == want and run > 5


@pytest.fixture
def pieces(spark):
    """Small partitions stay apart, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def apart(spark):
    rows = [(i, "p", str(1000 + i)) for i in range(400)]
    return rows, spark.createDataFrame([(*r, None) for r in rows], CLAIM).repartition(7)


def test_sides_stay_apart_at_borders_of_pieces(spark, pieces):
    """One group over all partitions: nothing stands before the first number of a piece, which does not make it one with anything."""
    rows, df = apart(spark)
    assert {(r["predicate"], r["least_id"], r["n"]) for r in temporal.consensus(df).collect()} == expected(rows)


def test_keys_stay_apart_at_borders_of_pieces(spark, pieces):
    rows, df = apart(spark)
    assert temporal.value_keys(df, ["predicate"]).select("value_key").distinct().count() == len(rows)


def test_lines_tell_every_value_at_borders_of_pieces(spark, pieces):
    """The keys of sides and those of their claims are made apart: each value has its own place and marker in the line."""
    rows, df = apart(spark)
    own = df.withColumn("question_id", F.lit(1))
    group = ["question_id", "predicate"]
    members = temporal.value_keys(own, group).select(*group, "value_key", "id")
    facts = own.select("question_id", F.lit("claim").alias("kind"), F.col("id").alias("ref_id"), F.concat(F.lit("C"), "id").alias("marker"), F.struct(F.col("id").alias("k")).alias("pos"))
    (line,) = answering.consensus_lines(temporal.consensus(own, group), members, facts).collect()
    dissent = "".join(f"; dissent: {v} [C{i}]" for i, _, v in rows[1:])
    assert line["line"] == f"- p: {rows[0][2]} — 1 source(s) agree [C0]{dissent}"
