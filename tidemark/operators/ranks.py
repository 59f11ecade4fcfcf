"""Ranks and runs that no single task has to work out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from tidemark.lineage import settle


def rank_within(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """``rows`` with ``rank``, from 1 within each group, in an order that leaves no ties.

    A range partitioning by group and order cuts large groups into pieces; a
    row's rank is its place in its piece after the sizes of the pieces before.
    """
    placed = settle(rows.repartitionByRange(*group, *order).withColumn("_p", F.spark_partition_id()))
    sizes = placed.groupBy(*group, "_p").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    same = F.col("_p") == F.col("_q")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    own = F.row_number().over(Window.partitionBy(*group, "_p").orderBy(*order))
    ranked = placed.withColumn("_k", own).join(offsets, same).withColumn("rank", F.col("_before") + F.col("_k"))
    return ranked.select(*rows.columns, "rank")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one piece in order, with their ``ranks``; the first row says how many rows of each member lie in the pieces before."""
    seen: dict | None = None
    for batch in batches:
        if seen is None and len(batch):
            seen = {x["m"]: x["n"] for x in batch.column("_before")[0].as_py() or []}
        lists = batch.column("_members")
        own = pc.list_flatten(lists).dictionary_encode()
        codes, names = own.indices.to_numpy(), own.dictionary.to_pylist()
        before, n = np.array([seen.get(x, 0) for x in names], np.int64), np.bincount(codes, minlength=len(names))
        rank = np.empty(len(codes), np.int64)
        rank[np.argsort(codes, kind="stable")] = np.arange(1, len(codes) + 1) + np.repeat(before - np.cumsum(n) + n, n)
        seen.update(zip(names, (before + n).tolist()))
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int32)
        ranks = pa.ListArray.from_arrays(pa.array(ends), pa.array(rank.astype(np.int32)))
        kept = [c for c in batch.schema.names if c not in ("_before", "_members")]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], ranks], [*kept, "ranks"])


def rank_in_each(rows: DataFrame, members: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``ranks``, an array beside that of ``members`` (distinct, no nulls): the row's rank, from 1, among the rows of each member.

    Rows are not repeated for their members.  They are cut into pieces as in
    :func:`rank_within`; a task counts the members of its piece from what the
    pieces before hold of each.  No two rows of a member tie.
    """
    placed = settle(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = placed.select("_p", F.explode(members).alias("m")).groupBy("_p", "m").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("m").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    told = sizes.select(F.col("_p").alias("_q"), "m", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("n"))
    heads = F.broadcast(settle(told.groupBy("_q").agg(F.collect_list(F.struct("m", "n")).alias("_heads"))))  # pieces times members
    inside = placed.join(heads, F.col("_p") == F.col("_q"), "left").sortWithinPartitions(*order)
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    handed = inside.select(*rows.columns, F.col(members).alias("_members"), F.when(first, F.col("_heads")).alias("_before"))
    return handed.mapInArrow(_counted, StructType(rows.schema.fields).add("ranks", ArrayType(IntegerType())))


def runs_within(rows: DataFrame, group: list[str], value: str, near: Callable[[Column, Column], Column]) -> DataFrame:
    """``rows`` with ``run``, from 1 within each group: sorted by ``value``, a row is of the run of the one before if both are ``near``.

    Groups are cut into pieces as in :func:`rank_within`; a piece goes on with
    the last run of the piece before if the values at their border are near.
    ``value`` has no nulls; null groups are a group.  ``near`` is asked about
    two values only: the first of a piece and the first piece have none before.
    """
    follows = lambda a, b: F.coalesce(a.isNotNull() & near(a, b), F.lit(False))
    placed = settle(rows.repartitionByRange(*group, value).withColumn("_p", F.spark_partition_id()))
    within = Window.partitionBy(*group, "_p").orderBy(value)
    opened = placed.withColumn("_new", F.when(follows(F.lag(value).over(within), F.col(value)), 0).otherwise(1))
    pieces = opened.groupBy(*group, "_p").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("_new").alias("_n"))
    order = Window.partitionBy(*group).orderBy("_p")
    goes_on = F.when(follows(F.lag("_hi").over(order), F.col("_lo")), 1).otherwise(0)
    before = F.coalesce(F.sum(F.col("_n") - F.col("_on")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = pieces.withColumn("_on", goes_on).select(
        *[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], F.col("_p").alias("_q"), (before - F.col("_on")).alias("_before")
    )
    same = F.col("_p") == F.col("_q")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    own = F.sum("_new").over(within.rowsBetween(Window.unboundedPreceding, 0))
    return opened.withColumn("_k", own).join(offsets, same).withColumn("run", F.col("_before") + F.col("_k")).select(*rows.columns, "run")
