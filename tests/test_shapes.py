"""Operators on shapes that the standard tables do not have."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import contradictions, graph, overlap, ranks, store


def walk(edges, root):
    """id -> (depth, path) by breadth first search, the least path first."""
    seen, level = {root: (0, f"/{root}/")}, [root]
    depth = 0
    while level:
        depth += 1
        best = {}
        for child, parent in edges:
            if parent in level and child not in seen:
                path = f"{seen[parent][1]}{child}/"
                best[child] = min(best.get(child, path), path)
        seen |= {c: (depth, p) for c, p in best.items()}
        level = list(best)
    return seen


def test_subtree_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(150)], "child bigint, parent bigint")
    found = {r["id"]: r["depth"] for r in graph.subtree(edges, levels_at_once=16).collect()}
    assert found == {i: i for i in range(151)}


def test_subtree_with_diamonds_and_cycles(spark):
    rng = random.Random(2)
    diamonds = [e for k in range(25) for e in ((3 * k + 1, 3 * k), (3 * k + 2, 3 * k), (3 * k + 3, 3 * k + 1), (3 * k + 3, 3 * k + 2))]
    odd = [(rng.randrange(1, 76), rng.randrange(0, 76)) for _ in range(40)]
    edges = [(c, p) for c, p in diamonds + odd if c != p]
    df = spark.createDataFrame(edges, "child bigint, parent bigint")
    found = {r["id"]: (r["depth"], r["path"]) for r in graph.subtree(df, 0).collect()}
    assert found == walk(edges, 0)
    assert graph.subtree(df.limit(0)).count() == 0


def test_ranks_of_a_hot_group(spark):
    rows = [(None if i % 7 == 0 else i % 3 // 2, i * 37 % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "g int, v int").repartition(8)
    got = {(r["g"], r["v"]): r["rank"] for r in ranks.rank_within(df, ["g"], [F.col("v").desc()]).collect()}
    for g in (None, 0, 1):
        own = sorted((v for x, v in rows if x == g), reverse=True)
        assert [got[g, v] for v in own] == list(range(1, len(own) + 1))


def test_containment(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)] + ["the", "of"] * 5
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 30)))) for i in range(60)] + [(99, None)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 8)))) for i in range(30)]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = {(a, b) for a, x in docs for b, y in items if y and len(set(y.split()) & set((x or "").split())) / len(set(y.split())) >= 0.6}
    assert {(r["doc_id"], r["item_id"]) for r in overlap.containment(d, i).collect()} == want


def test_values_are_normalized_once(spark):
    """Each pattern stands once in the plan of a side, whatever uses the forms."""
    claims = spark.createDataFrame(
        [], "id bigint, subject_entity_id bigint, predicate string, object_value string, as_of date, valid_from date, valid_to date, superseded_by bigint, document_id bigint"
    )
    plan = contradictions.detect(claims)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("approx") <= 2 and plan.count("sgd") <= 2


@pytest.mark.parametrize(
    "value, form, number",
    [("12", "12", 12.0), ("-3.50", "-3.50", -3.5), ("12\n", "12", 12.0), ("SGD 4.8M", "sgd 4.8m", 4.8e6), ("~$1,200 (net of tax)", "$1200 (net of tax)", 1200.0),
     ("twenty-one million", "21 million", 21e6), ("−5 %", "-5 %", -5.0), ("5 apples", "5 apples", None), ("", "", None), ("2 thousand", "2 thousand", 2000.0), ("k5", "k5", None)],
)
def test_value_forms(spark, value, form, number):
    row = spark.createDataFrame([(value,)], "v string").select(text.value_text(F.col("v")).alias("t")).select("t", text.value_number(F.col("t")).alias("n")).first()
    assert row["t"] == form and (row["n"] is None if number is None else row["n"] == pytest.approx(number))


def test_faults_are_raised(spark):
    chunks = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, float("nan")])], "id bigint, embedding array<double>")
    assert store.checked_vectors(chunks.where("id = 1"), 2).count() == 1
    with pytest.raises(Exception, match="unfit vector of chunk 2"):
        store.checked_vectors(chunks, 2).collect()
    with pytest.raises(Exception, match="not an ISO date"):
        spark.createDataFrame([("soon",)], "d string").select(store.parse_day(F.col("d"))).collect()
    table, gone = store.cleared(chunks)
    assert table.count() == 0 and gone == 2


def test_tables_are_created_once(spark):
    from tidemark import schemas

    assert schemas.create(spark, "ontology_test") == sorted(schemas.TABLES)
    assert schemas.create(spark, "ontology_test") == sorted(schemas.TABLES)
    assert spark.table("ontology_test.claims").count() == 0
