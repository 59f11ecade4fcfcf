"""Edge cases of extraction, vocabulary, clusters and evaluation."""

from pyspark.sql import functions as F

from tidemark.operators import audit, contradictions, evaluation, extraction, vocabulary


def test_links_are_coerced(spark):
    verbs = ["manages", " Reports To ", "mentored", "", "   ", None, "functional lead", "dotted-line"]
    rows = spark.createDataFrame([(i, "a", "b", v) for i, v in enumerate(verbs)], "id int, from_entity string, to_entity string, link_type string")
    found = [tuple(r)[1:] for r in extraction.coerce_links(rows).orderBy("id").collect()]
    assert found == [
        ("b", "a", "reports_to", None, None), ("a", "b", "reports_to", None, None), ("a", "b", "mentions", "mentored", None),
        ("a", "b", None, None, "unmappable_enum"), ("a", "b", None, None, "unmappable_enum"), ("a", "b", None, None, "unmappable_enum"),
        ("b", "a", "dotted_line_to", None, None), ("a", "b", "dotted_line_to", None, None),
    ]


def test_grades(spark):
    given = [
        ("revenue was SGD 14.2M", "14.2 million", "In Q1 revenue was SGD 14.2M.", "exact"),
        ("revenue was 14.2M", "14.2 million", "sales came to that", "value_only"),
        ("revenue was SGD 14.2M", "15M", "revenue was SGD 14.2M", "ungrounded"),
        ("in version2 of Q3", "3", "in version2 of Q3", "ungrounded"),
        ("moved to end-of-Q3", "end of Q3", "It moved to end of Q3", "exact"),
        ("it shipped", None, "it shipped", "exact"),
        ("", "x", "x", "ungrounded"), ("  ", None, "x", "ungrounded"), (None, None, None, "ungrounded"), ("a b", "a", None, "value_only"),
        ("cost 1,200 units", "1200", "the cost: 1,200 units", "exact"),
    ]
    rows = spark.createDataFrame([(i, *g) for i, g in enumerate(given)], "id int, evidence string, object_value string, chunk_text string, want string")
    for r in extraction.graded(rows).collect():
        assert r["grade"] == r["want"], r


def test_spans(spark):
    given = [
        ("b c", "a b c d", (2, 5)), ("B  c", "a b\nC d", (2, 5)), ("b", "b b", None), ("x", "a", None), ("", "a", None), (None, "a", None), ("a", None, None),
        ("1.5", "a 1.5", (2, 5)), ("A.b", "a.B axb", (0, 3)), ("é f", "\U0001f600 É  F", (2, 6)), ("Q\\E (1", "q\\e  (1", (0, 7)),
    ]
    rows = spark.createDataFrame([(i, e, b) for i, (e, b, _) in enumerate(given)], "id int, e string, b string")
    found = rows.orderBy("id").select(extraction.locate(F.col("e"), F.col("b")).alias("s")).collect()
    assert [tuple(r["s"]) if r["s"] else None for r in found] == [w for *_, w in given]


def test_predicates(spark):
    vocab = spark.createDataFrame([("revenue", ["Sales", "topline"]), ("arr", None), ("zeta", ["sales"])], "canonical_key string, aliases array<string>")
    given = [" SALES ", "Q1 2026 topline", "ARR", "Q1 revenue vs plan", None, "FY/2025-Revenue", ""]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(given)], "id int, predicate string")
    found = [r[0] for r in vocabulary.canonical(rows, vocab).orderBy("id").select("canonical_predicate").collect()]
    assert found == ["revenue", "revenue", "arr", "Q1 revenue vs plan", None, "revenue", ""]


def test_metric_subjects(spark):
    vocab = spark.createDataFrame([("revenue", ["sales"])], "canonical_key string, aliases array<string>")
    given = [("Q1 2026 Revenue", "metric", "status"), ("sales", "metric", "revenue"), ("sales", "person", "x"), ("growth", "metric", "x"), (None, "metric", "x")]
    rows = spark.createDataFrame([(i, *g) for i, g in enumerate(given)], "id int, subject string, subject_type string, predicate string")
    found = [tuple(r)[1:] for r in extraction.repair_metric_subjects(rows, vocab, "Us").orderBy("id").collect()]
    assert found == [("Us", "other", "Q1 2026 Revenue"), ("Us", "other", "revenue"), *given[2:]]


def test_passes(spark):
    rows = spark.createDataFrame(
        [(1, " A", "p", "1", None), (2, "a", "P", "1", ""), (2, "a", "p", "1", "2026-01-01"), (3, "a", "p", None, None)],
        "pass int, subject string, predicate string, object_value string, as_of string",
    )
    assert sorted(r["pass"] for r in extraction.merge_passes(rows, extraction.claim_key(), ["pass"]).collect()) == [1, 2, 3]


CLAIM = "id bigint, subject_entity_id bigint, predicate string, object_value string, as_of date, superseded_by bigint"
LINK = "from_entity_id bigint, to_entity_id bigint, link_type string, as_of date"


def test_clusters(spark):
    claims = [(i, 1, "p", str(i), None, None) for i in range(41)]
    claims += [(50, 2, "p", "x", None, None), (51, 2, "q", "y", None, None), (52, 3, "p", "x", None, None), (53, 4, "pain_point", "x", None, None),
               (54, 2, "p", "z", None, 50), (55, None, "p", "x", None, None)]
    links = [(3, 9, "reports_to", None), (5, 9, "reports_to", None), (5, 8, "dotted_line_to", None), (5, 7, "owns", None)]
    found = contradictions.clusters(spark.createDataFrame(claims, CLAIM), spark.createDataFrame(links, LINK))
    by = {r["subject_entity_id"]: (r["n_claims"], r["n_links"], r["judged"], r["cluster_key"] is not None) for r in found.collect()}
    assert by == {1: (41, 0, False, False), 2: (2, 0, True, True), 3: (1, 1, False, False), 5: (0, 2, True, True)}


def test_facts(spark):
    facts = spark.createDataFrame(
        [(1, 1, "p", "$14.2 million", "a/X.md", None), (2, 1, "p", "41", "x.md", None), (3, 1, "q", "1", "x.md", None),
         (4, 2, "t", "end of Q3 2026", "y.md", None), (5, 2, "n", "1", "y.md", None), (6, None, "p", "1", "x.md", None)],
        "fact_id bigint, subject_entity_id bigint, predicate string, value string, source_uri string, as_of date",
    )
    claims = spark.createDataFrame(
        [(1, "p", "SGD 14.2M", "b/x.md"), (1, "p", "241", "x.md"), (2, "t", "By end of Q3 2026, at last", "y.md"), (2, "n", None, "y.md"), (2, "t", "no", None)],
        "subject_entity_id bigint, predicate string, object_value string, source_uri string",
    ).withColumns({"as_of": F.lit(None).cast("date"), "source_as_of": F.lit(None).cast("date")})
    found = {r["fact_id"]: r["verdict"] for r in evaluation.claim_facts(facts, claims).collect()}
    assert found == {1: "found", 2: "mismatch", 3: "missing", 4: "found", 5: "mismatch", 6: "missing"}
    card = evaluation.scorecard(evaluation.claim_facts(facts, claims)).first()
    assert (card["total"], card["found"], card["mismatch"], card["precision"]) == (6, 2, 2, 0.5)
    empty = evaluation.scorecard(evaluation.claim_facts(facts.where("false"), claims)).first()
    assert (empty["total"], empty["recall"], empty["precision"], empty["macro_recall"]) == (0, 0.0, 0.0, 0.0)


def test_goal_and_collisions(spark):
    none = spark.createDataFrame([], "gating_passed boolean, asks_contradiction boolean, surfaced boolean")
    card = spark.createDataFrame([(0.8,)], "recall double")
    assert tuple(evaluation.goal(none, card).first()) == (True, False, False)
    probes = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 1), (3, 1), (3, None)], "probe int, entity_id int")
    assert {tuple(r) for r in evaluation.collisions(probes).collect()} == {(1, True), (2, False), (3, False)}


def test_document_embeddings(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (2, [1.0, 1.0])], "document_id bigint, embedding array<float>")
    assert {tuple(r) for r in audit.document_embeddings(docs, vectors).collect()} == {(1, 1, 1, True), (2, 2, 1, False), (3, 0, 0, False)}
