"""What an extraction run lost, and the strict checks that make items be lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text

from .extraction import SUBJECT_TYPES, VERBS

# Items that were left out on purpose, which is no loss.
INTENDED = ["hypothetical", "ungrounded"]
FIGURES = ["chunks", "empty_extractions", "truncated_calls", "items_emitted", "items_dropped", "lossy_drops"]


def drop_reason(claims: DataFrame) -> DataFrame:
    """``claims`` (subject, subject_type, predicate, as_of text, confidence, hypothetical) in strict form, with drop_reason (null: sound).

    A subject or predicate that is blank, an unknown type or a day that is no
    ISO date makes an item invalid; flagged hypotheticals are dropped on
    purpose.  Names lose blanks at their ends, the confidence is clamped.
    """
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    iso = F.col("as_of").isNull() | F.coalesce(F.col("as_of").rlike(r"\A\d{4}-\d{2}-\d{2}\z") & F.col("as_of").try_cast("date").isNotNull(), F.lit(False))
    typed = F.col("subject_type").isNull() | F.col("subject_type").isin(SUBJECT_TYPES)
    reason = F.when(F.coalesce("hypothetical", F.lit(False)), "hypothetical").when(~(filled("subject") & filled("predicate") & iso & typed), "validation_error")
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.5))))
    return claims.withColumns({"subject": F.trim("subject"), "predicate": F.trim("predicate"), "confidence": clamped, "drop_reason": reason})


def link_drop_reason(relations: DataFrame) -> DataFrame:
    """``relations`` (from_entity, to_entity, link_type, as_of text, confidence) with drop_reason, by the rules of :func:`drop_reason`."""
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    iso = F.col("as_of").isNull() | F.coalesce(F.col("as_of").rlike(r"\A\d{4}-\d{2}-\d{2}\z") & F.col("as_of").try_cast("date").isNotNull(), F.lit(False))
    sound = filled("from_entity") & filled("to_entity") & F.coalesce(F.col("link_type").isin(list(VERBS)), F.lit(False)) & iso
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.5))))
    return relations.withColumns({"confidence": clamped, "drop_reason": F.when(~sound, "validation_error")})


def _lossy(reason: Column) -> Column:
    """Unknown reasons count as losses."""
    return ~F.coalesce(reason.isin(INTENDED), F.lit(False))


def ledger(chunks: DataFrame, drops: DataFrame) -> DataFrame:
    """Figures by source_uri and, where that is null, over all: see FIGURES.

    ``chunks``: source_uri, emitted (items a model gave), truncated (calls cut
    short), one row for each chunk looked at, so that a source that lost
    nothing is there with zeros; ``drops``: source_uri, reason, one row for
    each item dropped.
    """
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    c = chunks.select(
        "source_uri", one.alias("chunks"), (F.coalesce("emitted", none) == 0).cast("long").alias("empty_extractions"),
        F.coalesce(F.col("truncated").cast("long"), none).alias("truncated_calls"), F.coalesce(F.col("emitted").cast("long"), none).alias("items_emitted"),
        none.alias("items_dropped"), none.alias("lossy_drops"),
    )
    d = drops.select("source_uri", *[none.alias(x) for x in FIGURES[:4]], one.alias("items_dropped"), _lossy(F.col("reason")).cast("long").alias("lossy_drops"))
    return c.unionByName(d).rollup("source_uri").agg(*[F.sum(x).alias(x) for x in FIGURES])


def counters(events: DataFrame, column: str) -> DataFrame:
    """(source_uri, column, n) of dropped or changed items, and over all sources where source_uri is null."""
    return events.groupingSets([["source_uri", column], [column]], "source_uri", column).agg(F.count("*").alias("n"))


def ingest_report(documents: DataFrame, chunks: DataFrame, claims: DataFrame, links: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(figure, n) of a run: what each table gained (column added) or already had, and mentions by outcome."""
    parts = []
    for name, table in (("documents", documents), ("chunks", chunks), ("claims", claims), ("links", links)):
        kind = F.when(F.col("added"), f"{name}_added").otherwise(f"{name}_known")
        parts.append(table.groupBy(kind.alias("figure")).agg(F.count("*").alias("n")))
    parts.append(outcomes.select(F.concat(F.lit("mentions_"), "outcome").alias("figure"), "n"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def normalized_value_present(needle: Column, hay: Column) -> Column:
    """One text within the other in any case, or so in their normal forms."""
    n = text.value_text(needle)
    return F.contains(F.lower(hay), F.lower(needle)) | F.coalesce((n != "") & F.contains(text.value_text(hay), n), F.lit(False))
