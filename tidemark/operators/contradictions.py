"""Contradictions as rows: every pair of claims, or the first of each pair of values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, text

from . import intervals

# Predicates with several true values, and those whose targets conflict whatever their period.
SET_VALUED = [
    "attendee", "data_quality_weakness", "desired_feature", "pain_point", "q1_miss_driver",
    "responsibilities", "tool_used_for", "weekly_activity", "weekly_recurring_meeting",
]
TARGETS = ["ga_target", "completion_target"]
SINGLE_VALUED_LINKS = ["reports_to"]


def with_values(claims: DataFrame) -> DataFrame:
    """``claims`` with value_text and value_number, computed once for each row rather than for each pair."""
    return claims.withColumn("value_text", text.value_text(F.col("object_value"))).withColumn(
        "value_number", text.value_number(F.col("value_text"))
    )


def _live(claims: DataFrame, set_valued: list[str]) -> DataFrame:
    """Claims that can conflict, with their values in normal form and their period from lo to hi."""
    live = with_values(
        claims.where(F.col("superseded_by").isNull() & F.col("subject_entity_id").isNotNull() & F.col("object_value").isNotNull())
    )
    if set_valued:
        live = live.where(~F.col("predicate").isin(list(set_valued)))
    return live.select(
        "id", "subject_entity_id", "predicate", "value_text", "value_number", "as_of", "document_id",
        F.coalesce("valid_from", "as_of").alias("lo"), F.coalesce("valid_to", "as_of").alias("hi"),
    )


def detect(
    claims: DataFrame, targets: list[str] = TARGETS, set_valued: list[str] = (), recorded: DataFrame | None = None, with_texts: bool = False
) -> DataFrame:
    """Pairs of live claims of one subject and predicate whose values conflict in a shared period.

    Columns: subject_entity_id, predicate, claim_a_id < claim_b_id, kind, and
    ``with_texts`` value_a and value_b, the compared texts.  ``recorded`` pairs
    (claim_a_id, claim_b_id) are left out.
    """
    live = _live(claims, set_valued)
    a, b = live.alias("a"), live.alias("b")
    col = F.col
    shared = dates.overlap(col("a.lo"), col("a.hi"), col("b.lo"), col("b.hi"))
    if targets:
        shared = shared | col("a.predicate").isin(list(targets))
    conflict = text.values_conflict(col("a.value_text"), col("a.value_number"), col("b.value_text"), col("b.value_number"))
    found = a.join(
        b,
        (col("a.subject_entity_id") == col("b.subject_entity_id"))
        & (col("a.predicate") == col("b.predicate"))
        & (col("a.id") < col("b.id"))
        & shared
        & conflict,
    ).select(
        col("a.subject_entity_id"), col("a.predicate"), col("a.id").alias("claim_a_id"), col("b.id").alias("claim_b_id"),
        kind(col("a.document_id"), col("b.document_id"), col("a.as_of"), col("b.as_of")).alias("kind"),
        *([col("a.value_text").alias("value_a"), col("b.value_text").alias("value_b")] if with_texts else []),
    )
    return found if recorded is None else found.join(recorded, ["claim_a_id", "claim_b_id"], "left_anti")


def kind(document_a, document_b, day_a, day_b):
    """Two sources about one time, one fact at two times, or else plainly two values."""
    near = day_a.isNull() | day_b.isNull() | (day_a == day_b)
    return (
        F.when((document_a != document_b) & near, "source_disagreement")
        .when(day_a.isNotNull() & day_b.isNotNull() & (day_a != day_b), "temporal")
        .otherwise("value_conflict")
    )


def detect_links(links: DataFrame, single_valued: list[str] = SINGLE_VALUED_LINKS) -> DataFrame:
    """Pairs of links that give one entity two targets of a single-valued type in overlapping periods."""
    own = links.where(F.col("link_type").isin(list(single_valued)))
    a, b, col = own.alias("a"), own.alias("b"), F.col
    return a.join(
        b,
        (col("a.from_entity_id") == col("b.from_entity_id"))
        & (col("a.link_type") == col("b.link_type"))
        & (col("a.id") < col("b.id"))
        & (col("a.to_entity_id") != col("b.to_entity_id"))
        & dates.overlap(col("a.as_of"), col("a.valid_to"), col("b.as_of"), col("b.valid_to")),
    ).select(
        col("a.from_entity_id").alias("subject_entity_id"), col("a.link_type").alias("predicate"),
        col("a.id").alias("link_a_id"), col("b.id").alias("link_b_id"),
        kind(col("a.document_id"), col("b.document_id"), col("a.as_of"), col("b.as_of")).alias("kind"),
    )


def first_of_each_conflict(claims: DataFrame, targets: list[str] = TARGETS, set_valued: list[str] = (), with_texts: bool = False) -> DataFrame:
    """One row for each unordered pair of values of a group that :func:`detect` would find in conflict: that of the least claim ids.

    No claims are paired: those of one value and period are one row first, and
    values meet by the periods they share.
    """
    live = _live(claims, set_valued)
    always = F.col("predicate").isin(list(targets))
    rows = live.withColumn("lo", F.when(~always, F.col("lo"))).withColumn("hi", F.when(~always, F.col("hi")))
    conflict = lambda a, b: text.values_conflict(*[F.col(f"{x}.{c}") for x in (a, b) for c in ("value_text", "value_number")])
    kept = ["value_text", "value_number", "document_id", "as_of"]
    first = intervals.first_overlaps(rows.withColumn("_value", F.col("value_text")), ["subject_entity_id", "predicate"], "_value", kept, conflict)
    return first.select(
        "subject_entity_id", "predicate", F.col("a.id").alias("claim_a_id"), F.col("b.id").alias("claim_b_id"),
        kind(F.col("a.document_id"), F.col("b.document_id"), F.col("a.as_of"), F.col("b.as_of")).alias("kind"),
        *([F.col("a.value_text").alias("value_a"), F.col("b.value_text").alias("value_b")] if with_texts else []),
    )


def link_conflicts_once(links: DataFrame, single_valued: list[str] = SINGLE_VALUED_LINKS) -> DataFrame:
    """One row for each unordered pair of targets that :func:`detect_links` would find for an entity and type: that of the least link ids."""
    own = links.where(F.col("link_type").isin(list(single_valued)) & F.col("from_entity_id").isNotNull() & F.col("to_entity_id").isNotNull())
    rows = own.select(
        "id", F.col("from_entity_id").alias("subject_entity_id"), F.col("link_type").alias("predicate"), F.col("to_entity_id").cast("string").alias("_value"),
        "document_id", "as_of", F.col("as_of").alias("lo"), F.col("valid_to").alias("hi"),
    )
    first = intervals.first_overlaps(rows, ["subject_entity_id", "predicate"], "_value", ["document_id", "as_of"], lambda a, b: F.lit(True))
    return first.select(
        "subject_entity_id", "predicate", F.col("a.id").alias("link_a_id"), F.col("b.id").alias("link_b_id"),
        kind(F.col("a.document_id"), F.col("b.document_id"), F.col("a.as_of"), F.col("b.as_of")).alias("kind"),
    )


def sweep(claims: DataFrame, links: DataFrame, set_valued: list[str] = SET_VALUED) -> DataFrame:
    """All contradictions of the store anew: one row for each conflict of claims or links.

    Columns: subject_entity_id, predicate, claim_a_id, claim_b_id, link_a_id,
    link_b_id, kind.  What was recorded before plays no part.
    """
    none = F.lit(None).cast("bigint")
    of_claims = first_of_each_conflict(claims, set_valued=set_valued)
    of_links = link_conflicts_once(links)
    return of_claims.withColumns({"link_a_id": none, "link_b_id": none}).unionByName(
        of_links.withColumns({"claim_a_id": none, "claim_b_id": none})
    ).select("subject_entity_id", "predicate", "claim_a_id", "claim_b_id", "link_a_id", "link_b_id", "kind")


def sweep_counts(claims: DataFrame, links: DataFrame, recorded: DataFrame, set_valued: list[str] = SET_VALUED) -> DataFrame:
    """(figure, n) of a sweep: rows cleared, groups looked at and passed over, pairs found, rows written, pairs dropped as repeats."""
    groups = claim_groups(claims)
    passed = F.col("predicate").isin(list(set_valued))
    pairs = detect(claims, set_valued=set_valued)
    linked = detect_links(links)
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("figure"), "n")
    figures = [
        count(recorded, "cleared"), count(groups.where(~passed), "claim_groups"), count(groups.where(passed), "set_valued_groups"),
        count(link_groups(links), "link_groups"), count(pairs, "claim_pairs"), count(first_of_each_conflict(claims, set_valued=set_valued), "claims_written"),
        count(linked, "link_pairs"), count(link_conflicts_once(links), "links_written"),
    ]
    out = figures[0]
    for more in figures[1:]:
        out = out.unionByName(more)
    return out


def link_groups(links: DataFrame, single_valued: list[str] = SINGLE_VALUED_LINKS) -> DataFrame:
    """(from_entity_id, link_type), distinct, of single-valued links."""
    return links.where(F.col("link_type").isin(list(single_valued))).select("from_entity_id", "link_type").distinct()


def label(kind_col, claim_a):
    """The stored kind's label, the kind itself if unknown; without one, by what conflicts."""
    return (
        F.when(kind_col == "source_disagreement", "sources disagree")
        .when(kind_col == "temporal", "changed over time")
        .when(kind_col == "value_conflict", "values conflict")
        .otherwise(F.coalesce(kind_col, F.when(claim_a.isNull(), "relationship").otherwise("values conflict")))
    )


def claim_groups(claims: DataFrame) -> DataFrame:
    """(subject_entity_id, predicate), distinct, of live claims with a subject."""
    live = claims.where(F.col("superseded_by").isNull() & F.col("subject_entity_id").isNotNull())
    return live.select("subject_entity_id", "predicate").distinct()


def relevant(pairs: DataFrame, subjects: DataFrame, topics: DataFrame) -> DataFrame:
    """Contradictions on a subject (subject_entity_id) or a topic (predicate) of the given tables, each once."""
    s = subjects.select(F.col("subject_entity_id").alias("_s")).distinct()
    t = topics.select(F.col("predicate").alias("_t")).distinct()
    marked = pairs.join(s, F.col("subject_entity_id") == F.col("_s"), "left").join(t, F.col("predicate") == F.col("_t"), "left")
    return marked.where(F.col("_s").isNotNull() | F.col("_t").isNotNull()).drop("_s", "_t")


CLUSTER_LINKS = ["reports_to", "dotted_line_to"]


def clusters(claims: DataFrame, links: DataFrame, most: int = 40, set_valued: list[str] = SET_VALUED) -> DataFrame:
    """(subject_entity_id, n_claims, n_links, judged, cluster_key): what is judged together about a subject.

    Members are live claims of single-valued predicates and functional links.
    Subjects with over ``most`` members, or without two claims or two links, are
    not judged and have no key; they are counted and never gathered.  The key
    hashes the members' sorted signatures, which name no surrogate ids of rows.
    """
    day = F.coalesce(F.col("as_of").cast("string"), F.lit(""))
    subject = lambda c: F.col(c).cast("bigint").alias("subject_entity_id")
    own = claims.where(F.col("superseded_by").isNull() & F.col("subject_entity_id").isNotNull() & ~F.col("predicate").isin(list(set_valued)))
    told = own.select(subject("subject_entity_id"), F.lit("claim").alias("block"),
                      F.concat_ws("|", F.lit("claim"), "subject_entity_id", "predicate", text.value_text(F.col("object_value")), day).alias("signature"))
    linked = links.where(F.col("link_type").isin(CLUSTER_LINKS)).select(
        subject("from_entity_id"), F.lit("link").alias("block"),
        F.concat_ws("|", F.lit("link"), "from_entity_id", "link_type", "to_entity_id", day).alias("signature"),
    )
    members = told.unionByName(linked)
    of = lambda b: F.count_if(F.col("block") == b)
    sizes = members.groupBy("subject_entity_id").agg(of("claim").alias("n_claims"), of("link").alias("n_links"))
    few = (F.col("n_claims") + F.col("n_links") <= most) & ((F.col("n_claims") >= 2) | (F.col("n_links") >= 2))
    sizes = sizes.withColumn("judged", few)
    gathered = members.join(sizes.where("judged").select("subject_entity_id"), "subject_entity_id", "left_semi")
    key = F.sha2(F.array_join(F.array_sort(F.collect_list("signature")), "\n"), 256)
    keys = gathered.groupBy("subject_entity_id").agg(key.alias("cluster_key"))
    return sizes.join(keys, "subject_entity_id", "left")


def adjudicated(swept: DataFrame, clustered: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Contradictions after judgement: those of a verdict where the subject's cluster has one, else what the sweep found.

    ``clustered`` is that of :func:`clusters`; ``verdicts`` has cluster_key and
    rows, an array of the structs (predicate, claim_a_id, claim_b_id,
    link_a_id, link_b_id, kind); an empty one says that nothing conflicts and
    is final.  Adds source: verdict or floor.
    """
    found = clustered.where("cluster_key IS NOT NULL").select("subject_entity_id", "cluster_key").join(verdicts, "cluster_key")
    ruled = found.select("subject_entity_id", F.inline("rows")).withColumn("source", F.lit("verdict"))
    floor = swept.join(found.select("subject_entity_id"), "subject_entity_id", "left_anti").withColumn("source", F.lit("floor"))
    return ruled.select(floor.columns).unionByName(floor)


# Predicates whose values are parts of a whole, and those with one true value.
BREAKDOWN = ["commit_count", "cross_pr_reviews", "gross_revenue", "net_revenue", "refunds"]
FUNCTIONAL = [
    "backlog_status", "board_meeting_date", "completion_target", "ebitda", "ga_target", "launch_date", "location", "nps",
    "revenue", "revenue_vs_plan", "role", "title", "total_paid_merchants",
]


def cardinality(predicate):
    """set_valued, breakdown, functional or unknown; only the first takes a predicate out of the sweep."""
    p = predicate
    return (
        F.when(p.isin(SET_VALUED), "set_valued").when(p.isin(BREAKDOWN), "breakdown").when(p.isin(FUNCTIONAL), "functional").otherwise("unknown")
    )
