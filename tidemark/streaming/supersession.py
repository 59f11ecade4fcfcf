"""Supersession over a stream of claims: per-key state, in event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions import text

_DAY_MS = 86_400_000
_STATE = "day array<bigint>, id array<bigint>, text array<string>, number array<double>"
Claim = tuple[int, int, str, float | None]


def day_time(day: Column) -> Column:
    """Midnight UTC of a date, whatever the session's time zone."""
    return F.timestamp_seconds(F.unix_date(day) * 86_400)


def _differ(a: Claim, b: Claim) -> bool:
    if a[3] is None or b[3] is None:
        return a[2] != b[2]
    return abs(a[3] - b[3]) > max(1e-9, 1e-9 * max(abs(a[3]), abs(b[3])))


def superseding(claims: list[Claim]) -> dict[int, tuple[int, int]]:
    """id: (id, day) of the first claim of a later day, by day and id, that says otherwise, of ``claims`` (day, id, text, number) in order.

    A day is its first claim and its first one that differs from that.  Going
    back from the last day, what differs from a claim is on the next day, or on
    the one after the run of days that all say the same.
    """
    days: list[list[Claim]] = []
    for c in claims:
        if not days or days[-1][0][0] != c[0]:
            days.append([])
        days[-1].append(c)
    found, turn, after = {}, None, None  # ``after``: the next day; ``turn``: the first day after it that differs from the one before
    for own in reversed(days):
        told = [own[0], *[c for c in own if _differ(c, own[0])][:1]]
        for c in own:
            for later in (after, turn):
                by = next((x for x in later or () if _differ(x, c)), None)
                if by:
                    found[c[1]] = (by[1], by[0])
                    break
        if after and (len(told) > 1 or len(after) > 1 or _differ(told[0], after[0])):
            turn = after
        after = told
    return found


def superseded(stream: DataFrame, delay: str, source: str = "document_id") -> DataFrame:
    """(id, superseded_by, valid_to) of a stream of claims, each once, when no earlier answer can arrive any more.

    What ``temporal.supersede`` finds in all claims that arrive within
    ``delay`` of the latest day seen: by date, not arrival, so a claim that
    arrives late supersedes nothing of its own day or later, and is itself
    superseded by what is there.  Claims later than the delay are dropped, as
    Spark does with late rows; claims without a date, value, subject, predicate
    or source are neither superseded nor supersede.  A repeated id counts once.
    A key's state holds its claims that nothing supersedes yet; a timer wakes
    it when the watermark passes its next day.
    """
    group = ["subject_entity_id", "predicate", source]
    known = stream.dropna(subset=[*group, "as_of", "object_value"]).withColumn("_text", text.value_text(F.col("object_value")))
    rows = known.select(
        *group, "id", F.unix_date("as_of").cast("long").alias("day"), "_text", text.value_number(F.col("_text")).alias("_number"), day_time(F.col("as_of")).alias("_at")
    )

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {i: (d, i, t, n) for d, i, t, n in zip(*state.get)} if state.exists else {}
        if not state.hasTimedOut:
            for b in batches:
                for d, i, t, n in zip(b["day"].tolist(), b["id"].tolist(), b["_text"].tolist(), b["_number"].tolist()):
                    held.setdefault(i, (d, i, t, None if n is None or pd.isna(n) else n))
        claims, watermark = sorted(held.values(), key=lambda c: c[:2]), state.getCurrentWatermarkMs()
        final = [c for c in claims if c[0] * _DAY_MS <= watermark]
        found = superseding(final)
        left = [c for c in claims if c[1] not in found]
        if left:
            state.update(tuple(list(x) for x in zip(*left)))
            waits = [c[0] * _DAY_MS for c in left if c[0] * _DAY_MS > watermark]
            if waits:
                state.setTimeoutTimestamp(min(waits))
        elif state.exists:
            state.remove()
        out = [(i, by, pd.Timestamp(day * _DAY_MS, unit="ms").date()) for i, (by, day) in found.items()]
        yield pd.DataFrame(out, columns=["id", "superseded_by", "valid_to"])

    return (
        rows.withWatermark("_at", delay).groupBy(*group)
        .applyInPandasWithState(step, "id bigint, superseded_by bigint, valid_to date", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )
