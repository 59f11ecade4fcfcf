"""Value and text expressions on the edge cases they are meant for."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import audit, resolve, upsert
from tidemark.sources import files


def value(spark, written):
    df = spark.createDataFrame([(written,)], "v string").select(text.value_text(F.col("v")).alias("t"))
    return tuple(df.select("t", text.value_number(F.col("t")).alias("n")).first())


@pytest.mark.parametrize(
    ("written", "number"),
    [
        ("SGD 14.2M", 14.2e6), ("14.2 million", 14.2e6), ("~18", 18.0), ("−11%", -11.0), ("-SGD 2.1M", -2.1e6), ("SGD -2.1M", -2.1e6),
        ("14,200,000", 14.2e6), ("(840.00)", None), ("18 months", None), ("Q1 2026", None), ("5 (per app)", 5.0), (None, None), ("", None),
    ],
)
def test_value_number(spark, written, number):
    found = value(spark, written)[1]
    assert found == (pytest.approx(number) if number is not None else None)


def test_value_text(spark):
    assert value(spark, "eighteen  months")[0] == value(spark, "18 months")[0]
    assert value(spark, "twenty-one days")[0] == "21 days"
    assert value(spark, "twenty one two")[0] == "21 2"
    assert value(spark, "est. 2015")[0] == "est. 2015"


def test_as_of(spark):
    given = ["Q1 2026", "2026 q4", "2026", "2026-03-05", "Q1 Q2 2026", "soon", "", None, "2026-13-01"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string")
    found = [str(r[0]) for r in df.orderBy("i").select(text.coerce_as_of(F.col("x"))).collect()]
    assert found == ["2026-03-31", "2026-12-31", "2026-12-31", "2026-03-05", "None", "None", "None", "None", "None"]


def test_resolution(spark):
    entities = spark.createDataFrame(
        [(1, "Ana Lim", {"department": "Sales"}, False), (2, "Ana Tan", {"department": "Legal"}, False), (3, "Acme", None, True), (4, "acme", None, False)],
        "id bigint, canonical_name string, attributes map<string,string>, seeded boolean",
    )
    aliases = spark.createDataFrame([(1, "Ana"), (2, "ana")], "entity_id bigint, alias string")
    mentions = spark.createDataFrame(
        [(1, "ANA", {"department": "sales"}), (2, "ana", None), (3, "Acme", None), (4, "nobody", None)],
        "mention_id bigint, name string, context map<string,string>",
    )
    found = {r["mention_id"]: r["entity_id"] for r in resolve.resolve(mentions, entities, aliases).collect()}
    assert found == {1: 1, 2: None, 3: 3, 4: None}


def test_insert_is_idempotent(spark):
    target = spark.createDataFrame([(5, "a", 1)], "id bigint, key string, v int")
    rows = spark.createDataFrame([("a", 2, 1), ("b", 3, 2), ("b", 4, 3), (None, 5, 4), (None, 6, 5)], "key string, v int, seq int")
    new = upsert.insert_new(target, rows, ["key"], ["seq"])
    assert [tuple(r) for r in new.orderBy("id").collect()] == [(6, "b", 3), (7, None, 5)]
    assert upsert.insert_new(target.unionByName(new), rows, ["key"], ["seq"]).count() == 0


def test_entities_merge(spark):
    schema = "id bigint, canonical_name string, entity_type string, attributes map<string,string>, seeded boolean"
    old = spark.createDataFrame([(1, "A", "team", {"x": "1", "y": "2"}, False)], schema)
    new = spark.createDataFrame([(None, "A", "team", {"y": "3"}, True), (None, "B", "team", None, False)], schema)
    found = [tuple(r) for r in upsert.merge_entities(old, new).orderBy("id").collect()]
    assert found == [(1, "A", "team", {"x": "1", "y": "3"}, True), (2, "B", "team", {}, False)]


def test_files(spark, tmp_path):
    (tmp_path / "chat").mkdir()
    (tmp_path / "chat/floor.md").write_text("# Floor\n\n**Mon Apr 13 08:30 — ana**\nhello\n\nthere\n**Mon Apr 13 08:31 — bo**\nbye\n")
    (tmp_path / "plan.md").write_text("# Plan 2026-04-01\n**Author:** Ana\n\ntext one\n\n| a | b |\n| 1 | 2 |\n")
    (tmp_path / "dashboards").mkdir()
    (tmp_path / "dashboards/k.html").write_text("<p>As of 2026-04-15</p><div class='card'><b>ARR</b><i>5M</i></div>")
    docs = files.documents(files.discover(spark, f"file:{tmp_path}"))
    by = {r["source_uri"]: r for r in files.segments(docs).collect()}
    assert [s["atomic"] for s in by["chat/floor.md"]["segments"]] == [False, True, True]
    assert by["plan.md"]["segments"][-1]["text"] == "| a | b |\n| 1 | 2 |" and by["plan.md"]["author"] == "Ana"
    assert str(by["plan.md"]["as_of"]) == "2026-04-01"
    assert by["dashboards/k.html"]["segments"][0]["text"] == "ARR — 5M (as of 2026-04-15)"
    assert files.pack(files.segments(docs)).where("source_uri = 'chat/floor.md'").count() == 1


def test_wilson_without_trials(spark):
    low, high = audit.wilson(F.col("h"), F.col("n"))
    row = spark.createDataFrame([(0, 0), (35, 41)], "h int, n int").select(low, high).collect()
    assert tuple(row[0]) == (0.0, 0.0) and row[1][0] == pytest.approx(0.7156, abs=1e-3)
