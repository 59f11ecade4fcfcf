"""Audit of stored claims, sampling for review, and the arithmetic of evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text


def grounding(evidence: Column, body: Column) -> Column:
    """exact, normalized (but for case and white space) or absent."""
    plain = lambda x: text.squeeze(text.fold(x))
    return F.when(F.contains(body, evidence), "exact").when(F.contains(plain(body), plain(evidence)), "normalized").otherwise("absent")


def _graded(rows: DataFrame) -> DataFrame:
    """``rows`` with _ground, the :func:`grounding` of their evidence, worked out once."""
    return rows.withColumn("_ground", text.once(grounding(F.col("evidence"), F.col("chunk_text")), lambda g: g))


def census(claims: DataFrame, chunks: DataFrame, documents: DataFrame, entities: DataFrame) -> DataFrame:
    """``claims`` with chunk_text, chunk_found, document_found and subject_name: all that a check needs, in one pass."""
    c = chunks.select(F.col("id").alias("_c"), F.col("text").alias("chunk_text"))
    d = documents.select(F.col("id").alias("_d"))
    e = entities.select(F.col("id").alias("_e"), F.col("canonical_name").alias("subject_name"))
    joined = claims.join(c, F.col("source_chunk_id") == F.col("_c"), "left").join(d, F.col("document_id") == F.col("_d"), "left")
    joined = joined.join(e, F.col("subject_entity_id") == F.col("_e"), "left")
    found = {"chunk_found": F.col("_c").isNotNull(), "document_found": F.col("_d").isNotNull()}
    return joined.withColumns(found).drop("_c", "_d", "_e")


def violations(census: DataFrame) -> DataFrame:
    """(id, category, severity) of claims joined with chunk_text, chunk_found and document_found.

    Superseded claims are only checked for their confidence.  One projection
    makes all checks of a row; there is no pass for each.
    """
    c = F.col
    live, has_chunk = c("superseded_by").isNull(), c("source_chunk_id").isNotNull()
    has_evidence = c("evidence").isNotNull() & (c("evidence") != "")
    seen = has_evidence & c("chunk_text").isNotNull()
    spot = F.substr(c("chunk_text"), c("char_start") + 1, c("char_end") - c("char_start"))
    checks = [
        ("no_source_chunk", "warning", live & ~has_chunk),
        ("dangling_chunk_ref", "error", live & has_chunk & ~c("chunk_found")),
        ("no_document_source", "error", live & ~c("document_found")),
        ("unresolved_subject", "warning", live & c("subject_entity_id").isNull()),
        ("confidence_out_of_range", "error", c("confidence").isNotNull() & ~c("confidence").between(0, 1)),
        ("missing_as_of", "warning", live & c("as_of").isNull()),
        ("no_evidence", "warning", live & has_chunk & ~has_evidence),
        ("evidence_not_in_chunk", "error", live & seen & (c("_ground") == "absent")),
        ("evidence_not_verbatim", "warning", live & seen & (c("_ground") == "normalized")),
        ("offsets_mismatch", "error", live & seen & c("char_start").isNotNull() & c("char_end").isNotNull() & (spot != c("evidence"))),
        (
            "value_not_in_evidence", "warning",
            live & has_evidence & c("object_value").isNotNull()
            & ~F.contains(text.value_text(c("evidence")), text.value_text(c("object_value"))),
        ),
    ]
    found = F.filter(
        F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(n).alias("category"), F.lit(s).alias("severity"))) for n, s, bad in checks]),
        lambda x: x.isNotNull(),
    )
    return _graded(census).select("id", F.inline(found))


def suspicious(threshold: float = 0.5) -> Column:
    """Claims worth a look: unresolved, of low confidence, undated, without evidence or with absent evidence."""
    c = F.col
    return c("superseded_by").isNull() & F.coalesce(
        c("subject_entity_id").isNull()
        | F.coalesce(c("confidence") < threshold, F.lit(False))
        | c("as_of").isNull()
        | (c("source_chunk_id").isNotNull() & (F.coalesce(c("evidence"), F.lit("")) == ""))
        | ((c("evidence") != "") & c("chunk_text").isNotNull() & (grounding(c("evidence"), c("chunk_text")) == "absent")),
        F.lit(False),
    )


def stratified_sample(rows: DataFrame, stratum: str, id_col: str, k: int, seed: int = 0) -> DataFrame:
    """``k`` rows, one of each stratum in turn, each stratum in an order by a multiplicative hash of the id and the seed."""
    hashed = F.pmod((F.col(id_col) + seed) * 2654435761, F.lit(4294967296))
    order = Window.partitionBy(stratum).orderBy("_h", id_col)
    own = rows.withColumn("_h", hashed).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)  # a stratum gives no more
    return own.orderBy("_r", stratum).limit(k).drop("_r", "_h")


def review_sample(rows: DataFrame, stratum: str, id_col: str, k: int = 25, seed: int = 1729, share: float = 0.5, threshold: float = 0.5) -> DataFrame:
    """``k`` rows for review with ``part``: half of them (to even) suspicious, where there are so many, the rest from all strata in turn."""
    marked = rows.withColumn("_bad", suspicious(threshold))
    most = round(k * share)
    bad = stratified_sample(marked.where("_bad"), stratum, id_col, most, seed).withColumn("part", F.lit("suspicious"))
    rest = stratified_sample(marked.join(bad.select(id_col), id_col, "left_anti"), stratum, id_col, k, seed).withColumn("part", F.lit("any"))
    order = Window.orderBy(F.col("part").desc(), F.pmod((F.col(id_col) + seed) * 2654435761, F.lit(4294967296)), id_col)  # 2k rows at most
    both = bad.unionByName(rest).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    return both.drop("_bad", "_n")


def by_category(found: DataFrame) -> DataFrame:
    """(category, severity, n) of :func:`violations`."""
    return found.groupBy("category", "severity").agg(F.count("*").alias("n"))


def report(found: DataFrame, traps: DataFrame) -> DataFrame:
    """One row: violations, errors, failed_traps, clean (neither errors nor failed traps) of violations and traps (trap, passed)."""
    none = F.lit(0).cast("long")
    v = found.select(F.lit(1).cast("long").alias("violations"), (F.col("severity") == "error").cast("long").alias("errors"), none.alias("failed_traps"))
    t = traps.select(none.alias("violations"), none.alias("errors"), (~F.col("passed")).cast("long").alias("failed_traps"))
    sums = v.unionByName(t).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("violations", "errors", "failed_traps")])
    return sums.withColumn("clean", (F.col("errors") == 0) & (F.col("failed_traps") == 0))


def trap_pairs_surface(claims: DataFrame, pairs: DataFrame, subject: str, predicate: str) -> DataFrame:
    """(trap, passed): of live claims on a subject of that name and predicate, two with differing values are a recorded contradiction.

    ``claims``: id, subject_name, canonical_predicate, object_value, superseded_by; ``pairs``: claim_a_id, claim_b_id.
    """
    own = claims.where(
        F.contains(F.lower("subject_name"), F.lit(subject.lower())) & (F.col("canonical_predicate") == predicate)
        & F.col("superseded_by").isNull() & F.col("object_value").isNotNull()
    ).withColumn("_text", text.value_text(F.col("object_value")))
    own = own.select("id", "_text", text.value_number(F.col("_text")).alias("_number"))
    a = own.select(F.col("id").alias("claim_a_id"), F.col("_text").alias("ta"), F.col("_number").alias("na"))
    b = own.select(F.col("id").alias("claim_b_id"), F.col("_text").alias("tb"), F.col("_number").alias("nb"))
    hits = pairs.select("claim_a_id", "claim_b_id").join(a, "claim_a_id").join(b, "claim_b_id").where(text.values_conflict(F.col("ta"), F.col("na"), F.col("tb"), F.col("nb")))
    return hits.agg((F.count("*") > 0).alias("passed")).select(F.lit(f"{subject}: {predicate} surfaces").alias("trap"), "passed")


def trap_no_contradiction(pairs: DataFrame, predicate: str) -> DataFrame:
    """(trap, passed): nothing is recorded on a predicate that all sources agree on."""
    return pairs.where(F.col("predicate") == predicate).agg((F.count("*") == 0).alias("passed")).select(
        F.lit(f"{predicate}: no contradiction").alias("trap"), "passed"
    )


def trap_names_apart(entities: DataFrame, entity_type: str, prefix: str, least: int = 2) -> DataFrame:
    """(trap, passed): so many entities of a type have names that begin with the prefix."""
    own = entities.where((F.col("entity_type") == entity_type) & F.startswith(F.lower("canonical_name"), F.lit(prefix.lower())))
    return own.agg((F.countDistinct("id") >= least).alias("passed")).select(F.lit(f"{prefix.strip()}: {least} apart").alias("trap"), "passed")


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The score interval of a share, within 0 and 1; (0, 0) without trials."""
    p = hits / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    edge = lambda x: F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).otherwise(0.0)
    return edge(mid - half), edge(mid + half)


def document_embeddings(documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, n, good, ok) of documents (id) by vectors (document_id, embedding): ok with vectors, none missing or zero."""
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    counted = vectors.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n"), F.count_if(norm > 0).alias("good"))
    every = documents.select("id").join(counted, "id", "left").na.fill(0, ["n", "good"])
    return every.withColumn("ok", (F.col("n") > 0) & (F.col("good") == F.col("n")))
