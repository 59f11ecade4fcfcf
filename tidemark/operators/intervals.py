"""Pairs of values that hold in a shared period, one for each pair of values, without pairs of rows.

Days are the leaves of a binary tree.  A period is the least number of nodes
that cover it; two periods overlap if and only if a node of one lies on the
way from the other's days to the root, or is one of its nodes.  Rows are
reduced to the least id of each value at each node before anything is joined,
so that a node meets as many rows as there are values, however many rows say
the same.

A period has some forty nodes, which are worth their shuffle in crowded groups
alone: the rows of a small group meet side by side.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.lineage import BROADCAST_ROWS, settle

#: Groups of more rows (of distinct value and period) meet by nodes, others side by side.
CROWD = 256


def covering(lo: Column, hi: Column, levels: int) -> Column:
    """array<struct<level, node>>: the fewest nodes that make up the leaves ``lo`` to ``hi``; none if they end before they begin."""
    nodes = []
    for k in range(levels + 1):
        left, right = F.shiftright(lo + ((1 << k) - 1), k), F.shiftright(hi + 1, k)
        node = lambda i, k=k: F.struct(F.lit(k).alias("level"), (F.lit(1 << (levels - k)).cast("long") + i).alias("node"))
        nodes += [F.when((left < right) & (left % 2 == 1), node(left)), F.when((left < right) & (right % 2 == 1), node(right - 1))]
    return F.array_compact(F.array(*nodes))


def _above(lo: Column, hi: Column, levels: int, wanted: list[int]) -> Column:
    """Nodes of the wanted levels over the first or last leaf that reach beyond the period."""
    nodes = []
    for k in wanted:
        for end in (lo, hi):
            start = F.shiftleft(F.shiftright(end, k), k)
            inside = (start >= lo) & (start + ((1 << k) - 1) <= hi)
            nodes.append(F.when(~inside, F.lit(1 << (levels - k)).cast("long") + F.shiftright(end, k)))
    return F.array_compact(F.array(*nodes))


def first_overlaps(rows: DataFrame, group: list[str], value: str, kept: list[str], conflict: Callable[[str, str], Column], crowd: int = CROWD) -> DataFrame:
    """(group, a, b): for each unordered pair of values of a group that conflict in a shared period, the rows of least ids.

    ``rows``: id, ``group``, ``value`` (a string that tells values apart),
    ``kept``, lo and hi (days; unknown ones are open).  ``conflict`` takes the
    prefixes of two structs.  a and b are structs of id and ``kept``, a with
    the lesser id.  A row that ends before it begins holds at no time.
    """
    ends = rows.agg(F.min(F.least("lo", "hi")).alias("first"), F.max(F.greatest("lo", "hi")).alias("last")).first()
    first, last = ends["first"] or date(2000, 1, 1), ends["last"] or date(2000, 1, 1)
    levels = ((last - first).days + 1).bit_length()
    # what lasts to the last day of all lasts to the end of the tree
    leaf = lambda day, open_end: F.coalesce(F.date_diff(day, F.lit(first.isoformat()).cast("date")).cast("long"), F.lit(open_end).cast("long"))
    dated = rows.select(*group, value, "id", *kept, leaf(F.col("lo"), 0).alias("lo"), leaf(F.when(F.col("hi") < F.lit(last.isoformat()).cast("date"), F.col("hi")), (1 << levels) - 1).alias("hi"))
    # rows that say the same of the same period are one from here on
    said = F.min(F.struct("id", *kept)).alias("s")
    own = settle(dated.where("lo <= hi").groupBy(*group, value, "lo", "hi").agg(said))
    crowds = settle(own.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > crowd).select(*group))
    n = crowds.count()
    if n == 0:
        return _first(_side_by_side(own, group, value), group, conflict)
    crowds = F.broadcast(crowds) if n <= BROADCAST_ROWS else crowds
    few_rows, many_rows = own.join(crowds, group, "left_anti"), own.join(crowds, group, "left_semi")
    small = _first(_side_by_side(few_rows, group, value), group, conflict)
    return small.unionByName(_first(_by_nodes(many_rows, group, value, levels), group, conflict))


def _side_by_side(own: DataFrame, group: list[str], value: str) -> DataFrame:
    """Pairs of rows (_x, x, _y, y) of a group whose periods overlap; rows are shuffled once, by group."""
    side = lambda v, s, lo, hi: own.select(*group, F.col(value).alias(v), F.col("s").alias(s), F.col("lo").alias(lo), F.col("hi").alias(hi))
    return side("_x", "x", "_lx", "_hx").join(side("_y", "y", "_ly", "_hy"), group).where("_x < _y AND _lx <= _hy AND _ly <= _hx")


def _by_nodes(own: DataFrame, group: list[str], value: str, levels: int) -> DataFrame:
    """The least rows (_x, x, _y, y) of two values at each node that both hold at."""
    lo, hi = F.col("lo"), F.col("hi")
    own = settle(own.withColumn("cover", covering(lo, hi, levels)))
    wanted = sorted(r[0] for r in own.select(F.explode("cover.level").alias("k")).distinct().collect())  # a few levels
    by_node = lambda nodes, name: own.select(*group, value, "s", F.explode(nodes).alias("node")).groupBy(*group, "node", value).agg(F.min("s").alias(name))
    covers = by_node(F.col("cover.node"), "x").withColumnRenamed(value, "_x")
    meets = by_node(F.array_distinct(F.concat("cover.node", _above(lo, hi, levels, wanted or [0]))), "y").withColumnRenamed(value, "_y")
    return covers.join(meets, [*group, "node"]).where("_x != _y")


def _first(pairs: DataFrame, group: list[str], conflict: Callable[[str, str], Column]) -> DataFrame:
    both = F.struct(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    apart = pairs.where(conflict("x", "y"))
    found = apart.groupBy(*group, F.least("_x", "_y").alias("_p"), F.greatest("_x", "_y").alias("_q")).agg(F.min(both).alias("best"))
    return found.select(*group, "best.a", "best.b")
