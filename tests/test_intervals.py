"""First conflicts by shared periods and supersession, against comparing all pairs."""

import datetime
import random
import time
from functools import partial

import pytest
from pyspark.sql import functions as F

from tidemark.operators import contradictions, intervals, temporal

CLAIM = "id bigint, subject_entity_id bigint, predicate string, object_value string, as_of date, valid_from date, valid_to date, superseded_by bigint, document_id bigint"


def claims(spark, n, seed, values=("1", "2", "1.0", "SGD 3", "3", "plan b", None, "1.0000000000001"), whole=False):
    rng, day = random.Random(seed), lambda: datetime.date(2024, 1, 1) + datetime.timedelta(rng.randrange(40))
    rows = []
    for i in rng.sample(range(10 * n), n):
        lo, hi = sorted((day(), day()))
        as_of = day() if rng.random() < 0.8 else None
        lo, hi = (lo if rng.random() < 0.5 else None), (hi if rng.random() < 0.5 else None)
        if (lo or as_of) and (hi or as_of) and (lo or as_of) > (hi or as_of):
            lo = hi = None
        rows.append((i, rng.randrange(4), rng.choice(["p", "q", "ga_target"]), rng.choice(values), as_of, lo, hi, None if rng.random() < 0.95 else 7, rng.randrange(3)))
    return spark.createDataFrame(rows, CLAIM)


@pytest.mark.parametrize("seed", range(3))
def test_first_conflicts(spark, seed):
    df = claims(spark, 150, seed)
    best = {}
    for r in contradictions.detect(df, with_texts=True).collect():
        key = r["subject_entity_id"], r["predicate"], *sorted((r["value_a"], r["value_b"]))
        best[key] = min(best.get(key, (r["claim_a_id"], r["claim_b_id"], r["kind"])), (r["claim_a_id"], r["claim_b_id"], r["kind"]))
    got = contradictions.first_of_each_conflict(df, with_texts=True).collect()
    assert {(r["subject_entity_id"], r["predicate"], *sorted((r["value_a"], r["value_b"]))): (r["claim_a_id"], r["claim_b_id"], r["kind"]) for r in got} == best
    assert len(got) == len(best) > 20


@pytest.mark.parametrize("crowd", (0, 8, 12))
def test_first_conflicts_of_crowds(spark, monkeypatch, crowd):
    """All groups by nodes, or some by nodes and the others side by side."""
    monkeypatch.setattr(intervals, "first_overlaps", partial(intervals.first_overlaps, crowd=crowd))
    test_first_conflicts(spark, 4)


def test_small_groups_have_no_nodes(spark):
    """What is shuffled of a small group is its rows, not the nodes of their periods."""
    plan = contradictions.first_of_each_conflict(claims(spark, 150, 0))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan


def test_first_link_conflicts(spark):
    rng, rows = random.Random(1), []
    for i in range(120):
        lo = datetime.date(2024, 1, 1) + datetime.timedelta(rng.randrange(60))
        rows.append((i, rng.randrange(5), rng.randrange(4), rng.choice(["reports_to", "reports_to", "dotted_line_to"]), lo if rng.random() < 0.7 else None,
                     lo + datetime.timedelta(rng.randrange(30)) if rng.random() < 0.7 else None, rng.randrange(2)))
    df = spark.createDataFrame(rows, "id bigint, from_entity_id bigint, to_entity_id bigint, link_type string, as_of date, valid_to date, document_id bigint")
    target, best = {r[0]: r[2] for r in rows}, {}
    for r in contradictions.detect_links(df).collect():
        key = r["subject_entity_id"], *sorted((target[r["link_a_id"]], target[r["link_b_id"]]))
        best[key] = min(best.get(key, (r["link_a_id"], r["link_b_id"], r["kind"])), (r["link_a_id"], r["link_b_id"], r["kind"]))
    got = contradictions.link_conflicts_once(df).collect()
    assert {(r["subject_entity_id"], *sorted((target[r["link_a_id"]], target[r["link_b_id"]]))): (r["link_a_id"], r["link_b_id"], r["kind"]) for r in got} == best and best


def test_nodes_cover_exactly(spark):
    rng = random.Random(5)
    spans = [sorted((rng.randrange(1 << 22), rng.randrange(1 << 22))) for _ in range(60)] + [[0, (1 << 22) - 1], [5, 5], [7, 8], [9, 3]]
    df = spark.createDataFrame([tuple(s) for s in spans], "lo bigint, hi bigint").select("lo", "hi", intervals.covering(F.col("lo"), F.col("hi"), 22).alias("c"))
    for r in df.collect():
        own = sorted(((n["node"] - (1 << 22 - n["level"])) << n["level"], 1 << n["level"]) for n in r["c"])
        at = r["lo"]
        for start, size in own:
            assert start == at
            at += size
        assert at == max(r["hi"] + 1, r["lo"]) and len(own) <= 44


def test_a_crowd_that_agrees(spark):
    """One subject with 100,000 equal claims and two that say otherwise."""
    same = spark.range(100_000).selectExpr("id", "1L AS subject_entity_id", "'p' AS predicate", "'5' AS object_value", "date'2024-01-01' AS as_of")
    other = spark.createDataFrame([(200_000, 1, "p", "6"), (300_000, 1, "p", "7")], "id bigint, subject_entity_id bigint, predicate string, object_value string")
    df = same.unionByName(other.withColumn("as_of", F.lit("2024-01-01").cast("date")))
    for c, kind in (("valid_from", "date"), ("valid_to", "date"), ("superseded_by", "bigint")):
        df = df.withColumn(c, F.lit(None).cast(kind))
    df = df.withColumn("document_id", F.lit(1).cast("bigint"))
    began = time.time()
    got = sorted((r["claim_a_id"], r["claim_b_id"]) for r in contradictions.first_of_each_conflict(df).collect())
    assert got == [(0, 200_000), (0, 300_000), (200_000, 300_000)] and time.time() - began < 60
    assert temporal.supersede(df).where("superseded_by IS NOT NULL").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_supersession(spark, seed):
    df = claims(spark, 200, seed, values=("1", "2", "1.0", "SGD 2", "plan b", None))
    rows = [r.asDict() for r in contradictions.with_values(df).collect()]

    def differ(a, b):
        if a["value_number"] is not None and b["value_number"] is not None:
            return abs(a["value_number"] - b["value_number"]) > 1e-9 * max(1, abs(a["value_number"]), abs(b["value_number"]))
        return a["value_text"] != b["value_text"]

    want = {}
    for a in rows:
        later = [
            (b["as_of"], b["id"]) for b in rows
            if all(a[c] == b[c] for c in ("subject_entity_id", "predicate", "document_id")) and a["as_of"] and b["as_of"] and a["as_of"] < b["as_of"]
            and a["object_value"] is not None and b["object_value"] is not None and differ(a, b)
        ]
        want[a["id"]] = (a["superseded_by"], a["valid_to"]) if a["superseded_by"] is not None or not later else (min(later)[1], min(later)[0])
    got = temporal.supersede(df)
    assert {r["id"]: (r["superseded_by"], r["valid_to"]) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") <= 1  # values with their days; no claims with claims


def test_nothing_conflicts_with_nothing(spark):
    df = claims(spark, 1, 0).limit(0)
    assert contradictions.first_of_each_conflict(df).count() == 0 and temporal.supersede(df).count() == 0
