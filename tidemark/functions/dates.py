"""Validity intervals.  An unknown bound is open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_at(as_of: Column, valid_to: Column, day) -> Column:
    """Known by ``day`` and not ended by then; undated rows always hold."""
    day = F.to_date(F.lit(day))
    return (as_of.isNull() | (as_of <= day)) & (valid_to.isNull() | (valid_to > day))


def overlap(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Closed intervals that share a day."""
    return (a_from.isNull() | b_to.isNull() | (a_from <= b_to)) & (b_from.isNull() | a_to.isNull() | (b_from <= a_to))


def or_first_day(day: Column) -> Column:
    """Unknown days before all others."""
    return F.coalesce(day, F.lit("0001-01-01").cast("date"))


def newest_first(day: Column, id_: Column) -> list[Column]:
    return [day.desc_nulls_last(), id_.asc()]
