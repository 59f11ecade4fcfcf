"""Time: timelines, freshness, supersession, coverage, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dates, text
from tidemark.lineage import settle

from .ranks import rank_within, runs_within


def timeline(claims: DataFrame) -> DataFrame:
    """All claims with their ``position`` (from 1) in their subject's timeline, superseded ones too.

    A subject with very many claims is cut into pieces, as :func:`rank_within` does.
    """
    days = {"_a": dates.or_first_day(F.col("as_of")), "_b": dates.or_first_day(F.col("valid_from"))}
    return rank_within(claims.withColumns(days), ["subject_entity_id"], [F.col("_a"), F.col("_b"), F.col("id")]).drop(*days).withColumnRenamed("rank", "position")


def freshest_per_predicate(claims: DataFrame) -> DataFrame:
    """The newest claim of each subject and predicate; the least id breaks ties."""
    order = Window.partitionBy("subject_entity_id", "predicate").orderBy(*dates.newest_first(F.col("as_of"), F.col("id")))
    return claims.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def supersede(claims: DataFrame, source: str = "document_id") -> DataFrame:
    """``claims`` with superseded_by and valid_to set where a later-dated claim of the same source contradicts them.

    By date, not arrival: of the claims of a subject, predicate and source
    that are dated later and differ in value, the first (by date, then id)
    supersedes.  Each day is reduced to its first claim and its first one that
    says otherwise; one pass over the days finds, for a value, the next day
    that says otherwise: the next day, or the one after the run of days that
    all say the same.  A run goes on while a day's value is that of the day
    before, within tolerance.
    """
    group = ["subject_entity_id", "predicate", source]
    known = [F.col(g).isNotNull() for g in group]
    own = claims.where(F.col("as_of").isNotNull() & F.col("object_value").isNotNull() & known[0] & known[1] & known[2])
    said = own.select(*group, "as_of", "id", text.value_text(F.col("object_value")).alias("_text"))
    values = said.groupBy(*group, "as_of", "_text").agg(F.min("id").alias("id")).withColumn("_number", text.value_number(F.col("_text")))
    told = F.struct("id", "_text", "_number")
    first = F.min(told).over(Window.partitionBy(*group, "as_of"))
    differs = lambda a, b: text.values_conflict(*[F.col(f"{x}.{c}") for x in (a, b) for c in ("_text", "_number")])
    marked = values.withColumn("_own", told).withColumn("one", first)
    days = marked.groupBy(*group, "as_of", "one").agg(F.min(F.when(differs("_own", "one"), F.col("_own"))).alias("two"))
    order = Window.partitionBy(*group).orderBy("as_of")
    ahead = order.rowsBetween(1, Window.unboundedFollowing)
    before = days.withColumn("_last", F.lag(F.struct("one", "two")).over(order))
    same_run = F.col("two").isNull() & F.col("_last.two").isNull() & F.col("_last.one").isNotNull() & ~differs("one", "_last.one")
    day = F.struct("as_of", "one", "two")
    runs = before.withColumn("_changed", ~F.coalesce(same_run, F.lit(False)))
    placed = runs.withColumn("next", F.lead(day).over(order)).withColumn("_turn", F.first(F.when(F.col("_changed"), day), ignorenulls=True).over(ahead))
    placed = placed.withColumn("then", F.lead("_turn").over(order)).select(*group, "as_of", "next", "then")

    def other(at: str) -> Column:
        """The claim of that day that says otherwise; null if all of it says the same."""
        by = F.when(differs("_own", f"{at}.one"), F.col(f"{at}.one.id")).when(F.col(f"{at}.two").isNotNull(), F.col(f"{at}.two.id"))
        return F.when(F.col(at).isNotNull() & by.isNotNull(), F.struct(F.col(f"{at}.as_of").alias("day"), by.alias("by")))

    followed = values.join(placed, [*group, "as_of"]).withColumn("_own", told)
    found = followed.select(*group, "as_of", "_text", F.coalesce(other("next"), other("then")).alias("_next")).where("_next IS NOT NULL")
    rows = claims.withColumn("_text", F.when(F.col("object_value").isNotNull(), text.value_text(F.col("object_value"))))
    rows = rows.join(found, [*group, "as_of", "_text"], "left")
    fresh = F.col("superseded_by").isNull()
    return rows.withColumn("valid_to", F.when(fresh, F.coalesce("_next.day", "valid_to")).otherwise(F.col("valid_to"))).withColumn(
        "superseded_by", F.coalesce("superseded_by", "_next.by")
    ).select(claims.columns)


def coverage(claims: DataFrame, roster_as_of: str) -> DataFrame:
    """By predicate: earliest and latest day, and stale if the latest is before ``roster_as_of``."""
    return claims.groupBy("predicate").agg(F.min("as_of").alias("earliest"), F.max("as_of").alias("latest")).withColumn(
        "stale", F.coalesce(F.col("latest") < F.to_date(F.lit(roster_as_of)), F.lit(False))
    )


def source_coverage(cited: DataFrame, group: list[str], roster_as_of: str, source: str = "source_uri") -> DataFrame:
    """By group: earliest and latest day of its evidence, stale, and sources, the freshest day of each of its dated sources.

    Sources are combined first, so that a group's map holds a source once.
    """
    own = cited.groupBy(*group, source).agg(F.min("as_of").alias("first"), F.max("as_of").alias("last"))
    dated = F.filter(F.collect_list(F.struct(F.col(source), F.col("last"))), lambda x: x["last"].isNotNull() & x[source].isNotNull())
    found = own.groupBy(*group).agg(F.min("first").alias("earliest"), F.max("last").alias("latest"), F.map_from_entries(F.array_sort(dated)).alias("sources"))
    return found.withColumn("stale", F.coalesce(F.col("latest") < F.to_date(F.lit(roster_as_of)), F.lit(False)))


def snapshot(rows: DataFrame, day: str | None) -> DataFrame:
    """Rows that hold on ``day``; all of them without one."""
    return rows if day is None else rows.where(dates.valid_at(F.col("as_of"), F.col("valid_to"), day))


def _keyed(rows: DataFrame, group: list[str]) -> DataFrame:
    """``rows``, each number or text of a group once (_number, _text), with ``value_key``.

    Numbers each of which is within tolerance of the next are one side, named
    by the least of them.
    """
    near = lambda a, b: ~text.values_conflict(F.lit(""), a, F.lit(""), b)
    runs = runs_within(rows.where("_number IS NOT NULL"), group, "_number", near)
    least = F.min("_number").over(Window.partitionBy(*group, "run"))
    numbers = runs.withColumn("value_key", F.concat(F.lit("n:"), least.cast("string"))).drop("run")
    return numbers.unionByName(rows.where("_number IS NULL").withColumn("value_key", F.concat(F.lit("t:"), F.col("_text"))))


def _valued(claims: DataFrame) -> DataFrame:
    """``claims`` with _number and, where that is null, _text of their value."""
    shown = claims.withColumn("_text", text.value_text(F.col("object_value"))).withColumn("_number", text.value_number(F.col("_text")))
    return shown.withColumn("_text", F.when(F.col("_number").isNull(), F.col("_text")))


def value_keys(claims: DataFrame, group: list[str]) -> DataFrame:
    """``claims`` with the ``value_key`` of their side in :func:`sides`."""
    own = settle(_valued(claims))
    keys = _keyed(own.select(*group, "_number", "_text").distinct(), group).select(*[F.col(c).alias(f"_k_{c}") for c in (*group, "_number", "_text")], "value_key")
    same = F.lit(True)
    for c in (*group, "_number", "_text"):
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return own.join(keys, same).select(*claims.columns, "value_key")


def sides(claims: DataFrame, group: list[str]) -> DataFrame:
    """Values of groups with two or more claims: group, value_key, value, n, freshest, least_id, total.

    value is that of the least claim with one; claims without a value are a
    side.  Numbers each within tolerance of the next are one side, whatever the
    order of the claims; other values are by their text.  Equal values are
    counted first, so that what is sorted grows with distinct values alone.
    """
    told = F.min(F.when(F.col("object_value").isNotNull(), F.struct(F.col("id"), F.col("object_value").alias("value"))))
    equal = _valued(claims).groupBy(*group, "_number", "_text").agg(
        F.count("*").alias("n"), F.max("as_of").alias("freshest"), F.min("id").alias("least_id"), told.alias("_told")
    )
    found = _keyed(settle(equal), group).groupBy(*group, "value_key").agg(
        F.sum("n").alias("n"), F.max("freshest").alias("freshest"), F.min("least_id").alias("least_id"), F.min("_told")["value"].alias("value")
    )
    total = found.groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg(F.sum("n").alias("total")).where("total >= 2")
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return found.join(total, same).drop(*[f"_{g}" for g in group])


def best_first() -> list:
    """Most claims, then freshest, then least id."""
    return [F.col("n").desc(), dates.or_first_day(F.col("freshest")).desc(), F.col("least_id")]


def consensus(claims: DataFrame, group: list[str] = ["predicate"]) -> DataFrame:  # noqa: B006
    """:func:`sides` with their rank within the group; rank 1 is the consensus, others dissent."""
    return rank_within(sides(claims, group).drop("total"), list(group), best_first())


def verdicts(claims: DataFrame, group: list[str] = ["predicate"]) -> DataFrame:  # noqa: B006
    """By group: the consensus value, n, freshest, least_id, and dissent, how many claims say otherwise.

    One aggregate, combined before its shuffle, whatever the number of values.
    """
    last = F.struct("n", dates.or_first_day(F.col("freshest")).alias("day"), (-F.col("least_id")).alias("before"), "value", "freshest", "least_id")
    top = sides(claims, group).groupBy(*group).agg(F.max(last).alias("s"), F.max("total").alias("total"))
    return top.select(*group, "s.value", "s.n", "s.freshest", "s.least_id", (F.col("total") - F.col("s.n")).alias("dissent"))


def freshest_per_source(cited: DataFrame, source: str = "source_uri") -> DataFrame:
    """(source, freshest) of dated evidence."""
    return cited.where("as_of IS NOT NULL").groupBy(source).agg(F.max("as_of").alias("freshest"))
