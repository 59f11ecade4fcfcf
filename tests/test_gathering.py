"""Facts that many questions share: rows are kept once, and each question has its own numbers."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import answering, ranks
from tidemark.plans import answers

QUESTIONS, SUBJECTS, MOST = 30, 60, 8


def store(seed):
    """Claims, contradictions (some with sides of another subject, or one side), and who asks for which subject and topic."""
    rng = random.Random(seed)
    claims = [(i, rng.choice([None, *range(SUBJECTS)]), rng.choice(["urgent", "low"]), rng.choice([None, f"v{i}"])) for i in range(500)]
    ids = [c[0] for c in claims]
    found = [(1000 + i, rng.choice([None, *range(SUBJECTS)]), rng.choice(["Urgent", "low", "none"]), rng.choice([None, *ids]), rng.choice([None, *ids])) for i in range(20)]
    for i in range(120):
        a = rng.choice([c for c in claims if c[1] is not None])
        found.append((2000 + i // 2 * 2, a[1], a[2], a[0], rng.choice([c for c in claims if c[1] == a[1]])[0]))  # two rows of each id
    subjects = {(rng.randrange(QUESTIONS), rng.randrange(SUBJECTS)) for _ in range(25)}
    topics = {(q, "URGENT") for q in range(0, QUESTIONS, 2)} | {(3, "low"), (3, "urgent"), (5, "else")}
    return claims, found, subjects, topics


def gathered(claims, found, subjects, topics, q):
    """What a question has, worked out for it alone: contradictions, and its claims in order."""
    about, asked = {e for k, e in subjects if k == q}, {t.lower() for k, t in topics if k == q}
    hits = {x[0] for x in found if x[1] in about or x[2].lower() in asked}
    own = [x for x in found if x[0] in hits]
    about |= {x[1] for x in own if x[1] is not None and (x[3] is not None or x[4] is not None)}
    sides = {s for x in own for s in x[3:] if s is not None}
    rows = [c[0] for c in claims if c[1] in about]
    must = [i for i in rows if i in sides]
    return own, sorted(must + [i for i in rows if i not in sides][: max(0, MOST - len(must))])


@pytest.fixture(scope="module", params=[1, 2])
def made(request, spark):
    claims, found, subjects, topics = data = store(request.param)
    c = spark.createDataFrame(claims, "id bigint, subject_entity_id bigint, predicate string, object_value string").withColumns(
        {"as_of": F.lit(None).cast("date"), "evidence": F.lit(None).cast("string")}
    )
    x = spark.createDataFrame(found, "id bigint, subject_entity_id bigint, predicate string, claim_a_id bigint, claim_b_id bigint").withColumns(
        {"kind": F.lit("temporal"), "note": F.lit("")}
    )
    s, t = spark.createDataFrame(list(subjects), "question_id bigint, entity_id bigint"), spark.createDataFrame(list(topics), "question_id bigint, term string")
    shared = answering.relevant(s, t, x.repartition(5))
    claims = answering.gather_claims(s, shared, c.repartition(5), MOST)
    numbered = answering.numbered_claims(claims)
    return data, shared, claims, numbered


def test_rows_are_shared(made):
    """Neither contradictions nor claims are repeated for each of the questions on a topic."""
    data, shared, claims, _ = made
    hits = {x for q in range(QUESTIONS) for x in gathered(*data, q)[0]}
    assert shared.count() == sum(x in hits for x in data[1])
    assert claims.count() <= len(data[0]) + QUESTIONS * MOST
    assert sum(len(gathered(*data, q)[1]) for q in range(QUESTIONS)) > 2 * claims.count()


def test_each_question_has_its_own(made):
    data, shared, claims, _ = made
    rows = sorted((r["question_id"], r["id"]) for r in answering.each_question(shared).collect())
    assert rows == sorted((q, x[0]) for q in range(QUESTIONS) for x in gathered(*data, q)[0])
    rows = sorted((r["question_id"], r["id"]) for r in answering.each_question(claims).collect())
    assert rows == [(q, i) for q in range(QUESTIONS) for i in gathered(*data, q)[1]]


def test_conflict_lines_of_shared_rows(made):
    data, shared, _, numbered = made
    want = []
    for q in range(QUESTIONS):
        own, ids = gathered(*data, q)
        want += [(q, x[0], f"- C conflict on {x[2]}: [C{ids.index(x[3]) + 1}] vs [C{ids.index(x[4]) + 1}]") for x in own if x[3] in ids and x[4] in ids]
    got = [tuple(r) for r in answering.conflict_lines(shared, {"claim": numbered}, F.lit("C")).collect()]
    assert sorted(got) == sorted(want)


def test_links_that_conflict_are_told(spark):
    columns = "id bigint, predicate string, note string, claim_a_id bigint, claim_b_id bigint, link_a_id bigint, link_b_id bigint, questions array<bigint>"
    found = spark.createDataFrame([(1, "p", "n", None, None, 7, 8, [1, 2]), (2, None, None, 5, None, None, 7, [2]), (3, "p", None, 5, 6, None, None, [1, 2])], columns)
    marks = "id bigint, questions array<bigint>, ranks array<int>"
    claims, links = spark.createDataFrame([(5, [1, 2], [1, 3]), (6, [2], [4]), (6, [1], [9])], marks), spark.createDataFrame([(7, [1, 2], [1, 2]), (8, [2], [1])], marks)
    got = [tuple(r) for r in answering.conflict_lines(found, {"claim": claims, "link": links}, F.lit("x")).collect()]
    assert sorted(got) == [(1, 3, "- x conflict on p: [C1] vs [C9]"), (2, 1, "- x conflict on p: [L2] vs [L1] — n"), (2, 2, "- x conflict: [C3] vs [L2]"), (2, 3, "- x conflict on p: [C3] vs [C4]")]


def test_ranks_in_each(spark):
    rng = random.Random(3)
    rows = [(i, rng.sample("abcdefg", rng.randrange(0, 5))) for i in range(3000)]
    df = spark.createDataFrame(rows, "v int, own array<string>").repartition(7)
    got = {r["v"]: dict(zip(r["own"], r["ranks"], strict=True)) for r in ranks.rank_in_each(df, "own", [F.col("v").desc()]).collect()}
    seen = {}
    for v, own in reversed(rows):
        for m in own:
            seen[m] = seen.get(m, 0) + 1
        assert got[v] == {m: seen[m] for m in own}
    assert ranks.rank_in_each(df.limit(0), "own", [F.col("v")]).count() == 0


def test_lines_in_stretches_make_the_same_text(made):
    """A question's lines come in a few texts, in its own order, whatever the pieces."""
    data, _, _, numbered = made
    told = numbered.withColumn("line", F.when(F.col("id") % 7 > 0, F.col("line")))  # some are unknown
    whole = {r["question_id"]: r["grounding"] for r in answering.grounding_text(answering.claim_facts(told)).collect()}
    stretches = answering.claim_lines(told)
    assert {r["question_id"]: r["grounding"] for r in answering.grounding_text(stretches).collect()} == whole
    assert set(whole) == {q for q in range(QUESTIONS) if gathered(*data, q)[1]} and any("\n" in x for x in whole.values())
    assert stretches.count() < answering.claim_facts(told).count()


def test_stretches_are_bounded(monkeypatch):
    monkeypatch.setattr(answering, "LINES_AT_ONCE", 3)
    batch = pa.RecordBatch.from_pydict(
        {"line": ["a", None, "c", "d"], "questions": [[1, 2], [2], [], [1, 2, 3, 4]], "ranks": [[1, 1], [2], [], [2, 3, 1, 1]]},
        schema=pa.schema([("line", pa.string()), ("questions", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32()))]),
    )
    got = [tuple(r.values()) for part in answering._joined_lines(iter([batch])) for r in part.to_pylist()]
    assert got == [(1, 1, "[C1] (claim) a"), (2, 1, "[C1] (claim) a"), (1, 2, "[C2] (claim) d"), (2, 3, "[C3] (claim) d"), (3, 1, "[C1] (claim) d"), (4, 1, "[C1] (claim) d")]


def test_only_named_facts_are_kept(made, spark):
    """Sentences that hold name a few facts; the others need no citation."""
    data, _, _, numbered = made
    facts = answering.claim_facts(numbered)
    said = [(q, p, " " if p == 2 else "so", cites) for q in range(QUESTIONS) for p, cites in enumerate((["C1", "C9"], ["C1", "X1"], ["C2"], []))]
    sentences = spark.createDataFrame(said, "question_id bigint, pos int, text string, cites array<string>")
    named = answering.named_facts(sentences, facts)
    own = {q: gathered(*data, q)[1] for q in range(QUESTIONS)}
    want = [(q, f"C{k}", own[q][k - 1]) for q in own for k in (1, 9) if k <= len(own[q])]
    assert sorted((r["question_id"], r["marker"], r["ref_id"]) for r in named.collect()) == sorted(want) and named.count() < facts.count()
    cited = facts.select("kind", "ref_id").distinct().selectExpr(
        "kind", "ref_id", "ref_id AS claim_id", "0L AS chunk_id", "0L AS link_id", "'x' AS source_uri", "'y' AS snippet", "cast(null AS date) AS as_of"
    )
    rows = lambda some: sorted(map(str, answering.enforced(sentences, some, cited).collect()))
    assert rows(named) == rows(facts) and rows(named)


def test_answers_rest_on_shared_claims(spark):
    """The queries from question to answer keep a claim of a common topic once."""
    ask = answers.Ask(spark, "/root/testdata/sf0.01")
    told, kept = answering.claim_facts(ask.numbered), ask.numbered
    assert kept.count() < told.count() / 2 and kept.select("id").distinct().count() == told.select("ref_id").distinct().count()
