"""Grading of the store against golden facts, as joins and conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text

VERDICTS = ["missing", "mismatch", "found"]


def loose_text(value: Column) -> Column:
    """Lower case without currencies, hedges, commas and punctuation, scales joined to their numbers."""
    v = F.regexp_replace(F.lower(value), r"sgd|brl|r\$|[$≈~]|approximately|about", " ")
    v = F.replace(F.replace(v, F.lit("million"), F.lit("m")), F.lit(","), F.lit(""))
    v = text.squeeze(F.regexp_replace(v, r"[^\p{L}\p{N}. ]", " "))
    return F.regexp_replace(v, r"(?U)(\d(?:\.\d+)?)\s+([mkb])\b", "$1$2")


def with_forms(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the forms by which a value is matched, once for each row rather than for each pair."""
    own = rows.withColumns({"_text": text.value_text(F.col(column)), "_loose": loose_text(F.col(column))})
    return own.withColumn("_number", text.value_number(F.col("_text")))


def values_match(golden: str, claimed: str) -> Column:
    """Equal values of two aliased sides of :func:`with_forms`; where not both are numbers, also one text within the other.

    Claims without a value match nothing: their loose form is null.
    """
    of = lambda side, name: F.col(f"{side}._{name}")
    g, c = of(golden, "loose"), of(claimed, "loose")
    numbers = of(golden, "number").isNotNull() & of(claimed, "number").isNotNull()
    within = (g != "") & (c != "") & (F.contains(c, g) | F.contains(g, c))
    equal = ~text.values_conflict(of(golden, "text"), of(golden, "number"), of(claimed, "text"), of(claimed, "number"))
    return F.coalesce(c.isNotNull() & (equal | (~numbers & within)), F.lit(False))


def uri_matches(golden: Column, claimed: Column) -> Column:
    """The same file name, or the golden path within the claimed one, in any case."""
    name = lambda x: F.lower(F.substring_index(x, "/", -1))
    return F.coalesce((name(golden) == name(claimed)) | F.contains(F.lower(claimed), F.lower(golden)), F.lit(False))


def claim_facts(facts: DataFrame, claims: DataFrame, tolerance_days: int = 0) -> DataFrame:
    """(fact_id, predicate, verdict): the best verdict over the claims of each fact's subject and predicate.

    ``facts``: fact_id, subject_entity_id, predicate, value, source_uri, as_of.
    ``claims``: subject_entity_id, predicate, object_value, as_of, source_uri,
    source_as_of.  Only the best rank is kept of each fact, so that the
    aggregate is combined before its shuffle.
    """
    f, col = with_forms(facts, "value").alias("f"), F.col
    c = with_forms(claims, "object_value").withColumn("_there", F.lit(True)).alias("c")
    near = lambda d: F.coalesce(F.abs(F.datediff(d, col("f.as_of"))) <= tolerance_days, F.lit(False))
    dated = col("f.as_of").isNull() | near(col("c.as_of")) | near(col("c.source_as_of"))
    good = values_match("f", "c") & uri_matches(col("f.source_uri"), col("c.source_uri")) & dated
    joined = f.join(
        c, (col("f.subject_entity_id") == col("c.subject_entity_id")) & (col("f.predicate") == col("c.predicate")), "left"
    )
    rank = F.when(col("c._there").isNull(), 0).when(good, 2).otherwise(1)
    best = joined.groupBy(col("f.fact_id"), col("f.predicate")).agg(F.max(rank).alias("_rank"))
    return best.select("fact_id", "predicate", _verdict(F.col("_rank")))


def _verdict(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, VERDICTS)), rank + 1).alias("verdict")


def link_facts(facts: DataFrame, links: DataFrame) -> DataFrame:
    """(fact_id, predicate, verdict) of facts (fact_id, link_type, from_entity_id, to_entity_id); a reversed link is a mismatch."""
    ends = links.select("link_type", "from_entity_id", "to_entity_id").distinct()
    keys = ["link_type", "from_entity_id", "to_entity_id"]
    forward = ends.withColumn("_forward", F.lit(True))
    back = ends.select("link_type", F.col("to_entity_id").alias("from_entity_id"), F.col("from_entity_id").alias("to_entity_id"), F.lit(True).alias("_back"))
    graded = facts.join(forward, keys, "left").join(back, keys, "left")
    rank = F.when(F.col("_forward"), 2).when(F.col("_back"), 1).otherwise(0)
    return graded.select("fact_id", F.col("link_type").alias("predicate"), _verdict(rank))


def recall_by_predicate(verdicts: DataFrame) -> DataFrame:
    """(predicate, total, found, mismatch, recall)."""
    is_ = lambda v: F.count_if(F.col("verdict") == v)
    g = verdicts.groupBy("predicate").agg(F.count("*").alias("total"), is_("found").alias("found"), is_("mismatch").alias("mismatch"))
    return g.withColumn("recall", F.col("found") / F.col("total"))


def scorecard(verdicts: DataFrame) -> DataFrame:
    """One row: total, found, mismatch, recall, precision, macro_recall; shares of nothing are 0."""
    s = recall_by_predicate(verdicts).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "found", "mismatch")], F.coalesce(F.avg("recall"), F.lit(0.0)).alias("macro_recall")
    )
    share = lambda n: F.coalesce(F.try_divide(F.col("found"), n), F.lit(0.0))
    return s.withColumns({"recall": share(F.col("total")), "precision": share(F.col("found") + F.col("mismatch"))})


def collisions(probes: DataFrame) -> DataFrame:
    """(probe, passed): all names of a probe (probe, entity_id) resolved, each to an entity of its own."""
    g = probes.groupBy("probe").agg(
        F.count("*").alias("_n"), F.count("entity_id").alias("_known"), F.countDistinct("entity_id").alias("_apart")
    )
    return g.select("probe", ((F.col("_known") == F.col("_n")) & (F.col("_apart") == F.col("_n"))).alias("passed"))


def oracle_caught(oracle: DataFrame, contradictions: DataFrame) -> DataFrame:
    """(item_id, caught) of items (item_id, subject_entity_id, predicate, value_a, value_b) by contradiction rows (…, note).

    With a known subject any row on it and the predicate counts.  Else a row on
    the predicate must name both values.  The items are a list made by hand.
    """
    c = contradictions.select("subject_entity_id", "predicate", F.lower("note").alias("note"))
    known = oracle.where("subject_entity_id IS NOT NULL").join(c.select("subject_entity_id", "predicate").distinct(), ["subject_entity_id", "predicate"], "left_semi")
    loose = oracle.where("subject_entity_id IS NULL").alias("o").join(
        c.alias("c"),
        (F.col("o.predicate") == F.col("c.predicate")) & F.contains("c.note", F.lower("o.value_a")) & F.contains("c.note", F.lower("o.value_b")),
        "left_semi",
    )
    hit = known.select("item_id").unionByName(loose.select("item_id")).withColumn("caught", F.lit(True))
    return oracle.select("item_id").join(hit, "item_id", "left").select("item_id", F.coalesce("caught", F.lit(False)).alias("caught"))


def goal(answers: DataFrame, recall: DataFrame, bar: float = 0.8) -> DataFrame:
    """One row: recall_ok, answers_ok, contradiction_ok of answers (gating_passed, asks_contradiction, surfaced) and a scorecard."""
    no = F.lit(None).cast("boolean")
    a = answers.agg(
        no.alias("recall_ok"), F.coalesce(F.bool_and("gating_passed"), F.lit(False)).alias("answers_ok"),
        F.coalesce(F.bool_or(F.col("asks_contradiction") & F.col("surfaced")), F.lit(False)).alias("contradiction_ok"),
    )
    r = recall.select((F.col("recall") >= bar).alias("recall_ok"), no.alias("answers_ok"), no.alias("contradiction_ok"))
    return a.unionByName(r).agg(*[F.bool_or(c).alias(c) for c in a.columns])


# The checks an answer may have to pass; all but the soft one decide.
CHECKS = [
    "cites_source", "states_as_of", "resolves_hierarchy", "uses_freshest_as_of", "surfaces_contradiction", "attributes_each_side",
    "cross_document_synthesis", "cites_multiple_sources", "entity_resolution", "alias_handling", "no_false_contradiction",
]
SOFT = ["alias_handling"]


def answer_checks(questions: DataFrame, citations: DataFrame, contradictions: DataFrame) -> DataFrame:
    """(question_id, check, passed, gating): the checks of each question (question_id, checks array<string>) on its answer.

    ``citations``: question_id, source_uri, as_of; ``contradictions``:
    question_id.  A question without either fails what asks for them; raises,
    when the row is evaluated, on an unknown check.
    """
    c = citations.groupBy("question_id").agg(
        F.count("*").alias("n"), F.count_if(F.coalesce("source_uri", F.lit("")) != "").alias("sourced"), F.count("as_of").alias("dated"),
        F.countDistinct(F.nullif(F.col("source_uri"), F.lit(""))).alias("sources"),
        F.count_if(F.contains(F.lower("source_uri"), F.lit("org-chart"))).alias("charts"),
    )
    k = contradictions.groupBy("question_id").agg(F.count("*").alias("conflicts"))
    own = questions.select("question_id", F.explode("checks").alias("check")).join(c, "question_id", "left").join(k, "question_id", "left")
    has = lambda name, least=1: F.coalesce(F.col(name), F.lit(0)) >= least
    rules = {
        "cites_source": has("sourced"), "states_as_of": has("dated"), "resolves_hierarchy": has("charts"),
        "uses_freshest_as_of": has("dated"),  # several dates always come with their coverage here
        "surfaces_contradiction": has("conflicts"), "attributes_each_side": has("conflicts") & has("sources", 2),
        "cross_document_synthesis": has("sources", 2), "cites_multiple_sources": has("sources", 2),
        "entity_resolution": has("n"), "alias_handling": has("n"), "no_false_contradiction": ~has("conflicts"),
    }
    passed = F.raise_error(F.concat(F.lit("unknown check: "), "check")).cast("boolean")
    for name, rule in rules.items():
        passed = F.when(F.col("check") == name, rule).otherwise(passed)
    return own.select("question_id", "check", passed.alias("passed"), (~F.col("check").isin(SOFT)).alias("gating"))


def graded_answers(checked: DataFrame) -> DataFrame:
    """(question_id, gating_passed, asks_contradiction, surfaced) of :func:`answer_checks`, as :func:`goal` takes them."""
    asks = F.col("check") == "surfaces_contradiction"
    return checked.groupBy("question_id").agg(
        F.bool_and(F.col("passed") | ~F.col("gating")).alias("gating_passed"), F.bool_or(asks).alias("asks_contradiction"), F.bool_or(asks & F.col("passed")).alias("surfaced")
    )


def as_of_correctness(checked: DataFrame) -> DataFrame:
    """One row: passed and total of the questions that ask for the freshest date and for no contradiction."""
    q = checked.groupBy("question_id").agg(
        F.bool_or(F.col("check") == "uses_freshest_as_of").alias("fresh"), F.bool_or(F.col("check") == "surfaces_contradiction").alias("conflict"),
        F.bool_or((F.col("check") == "uses_freshest_as_of") & F.col("passed")).alias("ok"),
    )
    own = q.where(F.col("fresh") & ~F.col("conflict"))
    return own.agg(F.count_if("ok").alias("passed"), F.count("*").alias("total"))


def contradiction_classes(golden: DataFrame, surfaced: DataFrame) -> DataFrame:
    """(golden_id, class) of planted contradictions (golden_id, question_id, subject_entity_id, predicate) by what their question's answer surfaced.

    ``surfaced``: question_id, subject_entity_id, predicate, claim_a_id,
    claim_b_id.  correct: a row on the predicate, and on the subject if that is
    known, has two claims; partial: a row is there, but one-sided or without a
    subject; incorrect: none, also where there is no answer.
    """
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    g = golden.select("golden_id", "question_id", F.col("subject_entity_id").alias("want"), plain(F.col("predicate")).alias("p"))
    two = F.coalesce(F.col("claim_a_id") != F.col("claim_b_id"), F.lit(False))
    s = surfaced.select("question_id", F.col("subject_entity_id").alias("has"), plain(F.col("predicate")).alias("p"), two.alias("two"), F.lit(True).alias("there"))
    joined = g.join(s, ["question_id", "p"], "left")
    sure = F.col("there") & (F.col("want").isNull() | F.coalesce(F.col("want") == F.col("has"), F.lit(False)))
    unsure = F.col("there") & F.col("want").isNotNull() & F.col("has").isNull()
    rank = F.when(sure & F.col("two"), 2).when(sure | unsure, 1).otherwise(0)
    names = F.array(*map(F.lit, ["incorrect", "partial", "correct"]))
    best = joined.groupBy("golden_id").agg(F.max(rank).alias("_r"))
    return best.select("golden_id", F.element_at(names, F.col("_r") + 1).alias("class"))


def document_verdicts(documents: DataFrame, verdicts: DataFrame, losses: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(source_uri, found, total, verdict, reasons) of documents (source_uri): the worst of what golden facts, losses and vectors say.

    ``verdicts``: source_uri, verdict of each golden fact; ``losses``: the
    ledger's rows; ``embeddings``: source_uri, ok.  FAIL: a fact is not found, a
    call gave nothing or was cut short, a vector is missing or zero.
    INCOMPLETE: items were lost, or the ledger or the vectors are not known.
    """
    v = verdicts.groupBy("source_uri").agg(F.count("*").alias("total"), F.count_if(F.col("verdict") == "found").alias("found"))
    out = documents.select("source_uri").join(v, "source_uri", "left").na.fill(0, ["total", "found"])
    out = out.join(losses.where("source_uri IS NOT NULL"), "source_uri", "left").join(embeddings.select("source_uri", "ok"), "source_uri", "left")
    checks = [
        (2, "golden facts not found", F.col("found") < F.col("total")),
        (1, "losses not known", F.col("chunks").isNull()),
        (2, "a call gave nothing or was cut short", (F.col("empty_extractions") > 0) | (F.col("truncated_calls") > 0)),
        (1, "items were lost", (F.col("lossy_drops") > 0) & (F.col("empty_extractions") == 0) & (F.col("truncated_calls") == 0)),
        (2, "a vector is missing or zero", ~F.col("ok")),
        (1, "vectors not known", F.col("ok").isNull()),
    ]
    found = F.filter(
        F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(rank).alias("rank"), F.lit(why).alias("why"))) for rank, why, bad in checks]),
        lambda x: x.isNotNull(),
    )
    out = out.withColumn("_f", found)
    worst = F.coalesce(F.array_max(F.transform("_f", lambda x: x["rank"])), F.lit(0))
    name = F.element_at(F.array(*map(F.lit, ["PASS", "INCOMPLETE", "FAIL"])), worst + 1)
    return out.select("source_uri", "found", "total", name.alias("verdict"), F.transform("_f", lambda x: x["why"]).alias("reasons"))


def oracle_totals(caught: DataFrame) -> DataFrame:
    """One row: caught, total, recall (0 of nothing), baseline, and held, whether it fell below that, of items (caught, baseline_caught)."""
    s = caught.agg(F.count_if("caught").alias("caught"), F.count("*").alias("total"), F.count_if("baseline_caught").alias("baseline"))
    return s.withColumns({"recall": F.coalesce(F.try_divide("caught", "total"), F.lit(0.0)), "held": F.col("caught") >= F.col("baseline")})


def sound_golden(facts: DataFrame, contradictions: DataFrame) -> DataFrame:
    """(problem, id) of golden data: fact ids that repeat, and sides (claim_a, claim_b) of contradictions that name no fact."""
    repeated = facts.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_fact").alias("problem"), "id")
    sides = contradictions.select(F.explode(F.array("claim_a", "claim_b")).alias("id")).where("id IS NOT NULL").distinct()
    return repeated.unionByName(sides.join(facts.select("id"), "id", "left_anti").select(F.lit("dangling_side").alias("problem"), "id"))
