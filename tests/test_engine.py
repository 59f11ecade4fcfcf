"""The surface over a small store: names, aliases, routes, citations."""

import pytest
from pyspark.sql import functions as F

from tidemark.commits import Store
from tidemark.engine import Engine
from tidemark.operators.answering import FALLBACK
from tidemark.schemas import TABLES

DAY = "cast(null AS date)"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("engine") / "store"))
    rows = lambda name, *sql: spark.sql(" UNION ALL ".join(f"SELECT {x}" for x in sql))
    store.commit(replaced={
        "documents": rows("d", "1L id, 'a.md' source_uri, 'markdown' source_type, 'A' title, 'Ann' author, date'2026-05-01' as_of", "2L, 'b.md', 'chat', 'B', null, null"),
        "chunks": rows("c", "10L id, 1L document_id, 0 ordinal, 'Revenue was 5 million in spring' text, array(1f, 0f) embedding", "11L, 2L, 0, 'Revenue was 7 million, said Bo', array(0f, 1f)",
                       "12L, 9L, 0, 'orphan words', null"),
        "entities": rows("e", "1L id, 'Acme' canonical_name, 'customer' entity_type, true seeded, map('x', 'y') attributes", "2L, 'Ann', 'person', true, map('role', 'CEO')", "3L, 'Bo', 'person', false, map()",
                         "4L, 'Twin', 'customer', false, map()", "5L, 'twin', 'product', false, map()"),
        "entity_aliases": rows("a", "1L id, 1L entity_id, 'Acme Corp' alias", "2L, 1L, 'ACM'"),
        "metric_vocab": rows("m", "'revenue' canonical_key, 'Revenue' display_name, array('sales') aliases"),
        "claims": rows("k", "1L id, 1L subject_entity_id, 'revenue' predicate, '5M' object_value, date'2026-03-01' as_of, 10L source_chunk_id, 1L document_id, 'was 5 million' evidence",
                       "2L, 1L, 'Q1 2026 sales', '7M', date'2026-02-01', 11L, 2L, null", "3L, 1L, 'city', 'Rome', null, null, null, null", "4L, 2L, 'revenue', '1M', null, 11L, null, null"),
        "links": rows("l", "1L id, 3L from_entity_id, 2L to_entity_id, 'reports_to' link_type, 1L document_id, 10L source_chunk_id, 'leads' raw_verb", "2L, 1L, 1L, 'mentions', null, null, null"),
        "contradictions": rows("x", "7L id, 1L subject_entity_id, 'revenue' predicate, 1L claim_a_id, 2L claim_b_id, 'source_disagreement' kind, 'spring' note", "8L, 5L, 'city', 3L, 4L, null, null"),
    })
    return store


@pytest.fixture(scope="module")
def engine(kept, tmp_path_factory):
    speak = lambda told: told.select("question_id", F.lit(0).alias("pos"), F.lit("It was so.").alias("text"), F.array(F.lit("C1"), F.lit("S1"), F.lit("Z9")).alias("cites"))
    embed = lambda text: F.when(F.contains(text, F.lit("spring")), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    return Engine.of_store(kept, embed=embed, speak=speak, buckets=4).index(str(tmp_path_factory.mktemp("index")), 2)


def test_names_and_aliases(engine):
    assert engine.entity_id(" acme ") == engine.entity_id("ACM") == 1
    assert engine.entity_id("twin") is None and engine.entity_id("nobody") is None
    assert engine.canonical("Sales") == "revenue" and engine.canonical("depth") == "depth"


def test_entity(engine):
    found = engine.get_entity("acme corp")
    assert [r["canonical_name"] for r in found["entity"].collect()] == ["Acme"]
    assert [r[0] for r in found["aliases"].collect()] == ["ACM", "Acme Corp"]
    assert [r["id"] for r in found["claims"].collect()] == [1, 2, 3] and [r["id"] for r in found["links"].collect()] == [2]
    assert all(x.count() == 0 for x in engine.get_entity("twin").values())


def test_inventory(engine):
    assert [tuple(r) for r in engine.get_sources().collect()][1] == (2, "b.md", "chat", "B", None, None)
    assert [r["canonical_name"] for r in engine.list_entities("person").collect()] == ["Ann", "Bo"] and engine.list_entities("city").count() == 0
    assert engine.list_metrics().first()["aliases"] == ["sales"]


def test_timeline_and_predicates(engine):
    line = engine.get_timeline("Acme", "sales").collect()
    assert [(r["claim_id"], r["predicate"], r["source_uri"], str(r["source_as_of"])) for r in line] == [(2, "revenue", "b.md", "2026-02-01"), (1, "revenue", "a.md", "2026-03-01")]
    assert engine.get_timeline("twin", "sales").count() == 0
    own = engine.get_claims_by_predicate("revenue").collect()
    assert [(r["claim_id"], r["subject_name"]) for r in own] == [(1, "Acme"), (2, "Acme"), (4, "Ann")]


def test_relationships_and_chart(engine):
    rel = engine.get_relationships("ann").collect()
    assert [(r["link_id"], r["direction"], r["from_name"], r["raw_verb"], r["source_uri"]) for r in rel] == [(1, "incoming", "Bo", "leads", "a.md")]
    assert [r["direction"] for r in engine.get_relationships("Acme", "mentions").collect()] == ["outgoing"]
    assert engine.get_relationships("Acme", "owns").count() == 0 and engine.get_relationships("nobody").count() == 0
    assert [(r["name"], r["depth"], r["role"]) for r in engine.get_org_chart().orderBy("depth").collect()] == [("Ann", 0, "CEO"), ("Bo", 1, None)]
    assert engine.get_org_chart(root="nobody").count() == 0


def test_contradictions(engine):
    ids = lambda topic=None: [r["id"] for r in engine.find_contradictions(topic).collect()]
    assert ids() == [7, 8] and ids("Sales") == [7] and ids("ACM") == [7] and ids("city") == [8] and ids("x") == []
    assert [r["label"] for r in engine.find_contradictions().collect()] == ["sources disagree", "values conflict"]


def test_search_and_fetch(engine, spark):
    hits = engine.search("revenue in spring", 5).collect()
    assert [(r["rank"], r["id"], r["title"]) for r in hits] == [(1, "10", "a.md"), (2, "11", "b.md")]
    own = spark.createDataFrame([(1, "x", "orphan", None), (2, "x", "nothing here", [0.0, 2.0])], "question_id bigint, question string, search string, vector array<double>")
    assert [(r["question_id"], r["id"], r["url"]) for r in engine.search(own, 1).collect()] == [(1, "12", ""), (2, "11", "b.md")]
    assert engine.fetch("10").first()["text"].startswith("Revenue") and not engine.fetch("ten").first()["found"]


def test_answers_are_cited_or_fixed(engine, spark):
    asked = spark.createDataFrame([(1, "What was the revenue of Acme in spring"), (2, "who reports to Bo"), (3, "colours of the sea")], "question_id bigint, question string")
    found = engine.ask(asked)
    answers = {r["question_id"]: r for r in found.answers.collect()}
    assert [answers[k]["route"] for k in (1, 2, 3)] == ["both", "structured", "retrieval"]
    assert answers[1]["answer"] == "It was so." and answers[1]["n_citations"] == 2 and answers[1]["cited_claims"] == [1]
    assert answers[2]["answer"] == FALLBACK and answers[2]["confidence"] == 0
    assert answers[3]["n_citations"] == 1
    cited = {(r["question_id"], r["kind"]): r for r in found.citations.collect()}
    assert cited[1, "claim"]["snippet"] == "was 5 million" and cited[1, "chunk"]["source_uri"] == "a.md"
    assert {(r["question_id"], r["id"]) for r in found.contradictions.collect()} == {(1, 7)}
    cover = {r["question_id"]: r for r in found.coverage.collect()}
    assert str(cover[1]["latest"]) == "2026-05-01" and not cover[1]["stale"]


def test_what_is_put_before_the_model(kept):
    seen = {}

    def speak(told):
        seen.update({r["question_id"]: r["grounding"] for r in told.collect()})
        return told.select("question_id", F.lit(0).alias("pos"), F.lit("x").alias("text"), F.array().cast("array<string>").alias("cites"), F.lit(1.0).alias("confidence"))

    found = Engine.of_store(kept, speak=speak).ask("How do sales of Acme Corp differ").answers.first()
    assert found["answer"] == FALLBACK and found["confidence"] == 0
    assert seen[0].split("\n")[:3] == ["[C1] (claim) revenue: 5M (as of 2026-03-01)", "[C2] (claim) Q1 2026 sales: 7M (as of 2026-02-01)", "[C3] (claim) city: Rome"]
    assert "- sources disagree conflict on revenue: [C1] vs [C2] — spring" in seen[0] and "- revenue: 5M — 1 source(s) agree" in seen[0]


def test_an_empty_store(spark, tmp_path):
    engine = Engine.of_store(Store(spark, str(tmp_path / "none")))
    assert engine.ask("What of Acme").answers.first()["answer"] == FALLBACK
    assert engine.get_org_chart().count() == 0 and engine.find_contradictions("x").count() == 0 and engine.get_sources().count() == 0
    with pytest.raises(RuntimeError, match="no indexes"):
        engine.search("x")
    with pytest.raises(ValueError, match="no tables"):
        Engine({})
    assert set(engine.tables) <= set(TABLES)
