"""Near-duplicate vectors by robust-pruned graphs over overlapping cluster shards.

Equal vectors are one class.  Each class lies in the shards of its two nearest
centres, the first of which is its home; centres grow with the number of
classes.  Every shard gets a robust-pruned graph of its own, and the adjacency
lists that a class has from its shards are united.  A class then asks its home
and the other nearest clusters that can hold a partner: greedy search over the
united lists from the cluster's medoids, and from the class itself where it
lies there, then expansion of everything in range.
What is found is verified in double precision and counted once, at both ends.

Recall is audited against brute force on classes that have links; below the
target the search is widened, at last to every cluster within reach and to all
its members, which misses nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, settle
from .components import connected_components

MAX_CLUSTERS = 16_384
#: Vectors in the sample that centres are fitted to: so many in all, or for each centre if that is more.
SAMPLE, SAMPLE_PER_CENTRE = 20_000, 20
#: Components of the home vectors that a cluster is meant for: 2 MB in double precision.
SHARD_VALUES = 1 << 18
#: Numbers of one array while clusters within reach are worked out: 16 MB.
REACH_VALUES = 1 << 21
#: Bounds are widened by this much, more than rounding can err (the root of a difference near 0 errs by some 1e-8).
SLACK = 1e-6
#: The search works in single precision; pairs so far under the threshold are still verified in double.
SINGLE_SLACK = 1e-4


@dataclass(frozen=True)
class Search:
    """How wide to search: clusters asked, places in the beam, range beyond the threshold that is expanded; or all of it."""

    routes: int = 3
    beam: int = 6
    margin: float = 0.05
    everything: bool = False

    def wider(self) -> "Search":
        return replace(self, routes=self.routes * 4, beam=self.beam * 2, margin=self.margin * 2)


def shard_rows(dim: int, values: int = SHARD_VALUES) -> int:
    """Vectors of ``dim`` components that a cluster is meant for."""
    return max(1, values // dim)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, also where squares would overflow or vanish."""
    rows = np.asarray(rows, np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def centres(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from the first rows of the sample."""
    c = sample[:k].copy()
    for _ in range(rounds if k > 1 else 1):
        own = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        n = np.linalg.norm(total, axis=1)
        c[n > 1e-12] = total[n > 1e-12] / n[n > 1e-12, None]
    return c


def within_reach(x: np.ndarray, own: np.ndarray, c: np.ndarray, inner: np.ndarray, outer: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix: can a home member of this cluster (column) have a cosine of ``threshold`` with this row of its ``own`` cluster?

    inner, outer: least and greatest distance of a cluster's members from its
    centre.  Rows are taken a few at a time, so that what is held besides the
    result is a few arrays of ``REACH_VALUES`` numbers, whatever the centres.
    """
    r = math.sqrt(max(2 - 2 * threshold, 0)) + SLACK
    found = np.empty((len(x), len(c)), bool)
    order = np.argsort(own, kind="stable")  # rows of one cluster follow each other, so few distances between centres are asked for
    step = max(1, REACH_VALUES // max(len(c), 1))
    for at in range(0, len(x), step):
        rows = order[at : at + step]
        homes, which = np.unique(own[rows], return_inverse=True)
        s = x[rows] @ c.T
        gap = np.take_along_axis(s, own[rows, None], 1) - s
        apart = np.sqrt(np.maximum(2 - 2 * c[homes] @ c.T, 0))
        away = np.sqrt(np.maximum(2 - 2 * s, 0))
        found[rows] = (gap <= r * apart[which] + SLACK) & (away <= outer + r + SLACK) & (away >= inner - r - SLACK)
    return found


# ---- a graph over the rows of one shard, and the search over it


def pruned_graph(x: np.ndarray, degree: int = 16, pool: int = 48, alpha: float = 1.2, far: int = 8) -> np.ndarray:
    """Neighbours of each row (-1: none), 3 x ``degree`` at most: by robust pruning, those that chose the row, and a tree's.

    Candidates are the ``pool`` nearest rows and ``far`` arbitrary ones.  A
    candidate is passed over if one already kept is nearer to it, by the
    factor ``alpha``, than the row itself.  Rows that are nearest to more rows
    than they can list head a tree of these, so that each row can be reached
    from the one nearest to it.
    """
    n = len(x)
    kept = np.full((n, degree), -1, np.int64)
    if n < 2:
        return kept
    near, rng = min(pool, n - 1), np.random.default_rng(n)
    for at in range(0, n, 256):
        rows = np.arange(at, min(at + 256, n))
        s = x[rows] @ x.T
        s[np.arange(len(rows)), rows] = -2
        best = np.argpartition(-s, near - 1, axis=1)[:, :near]
        candidates = np.concatenate((best, rng.integers(0, n, (len(rows), far))), axis=1)
        away = 1 - np.take_along_axis(s, candidates, 1)
        order = np.argsort(away, axis=1, kind="stable")
        candidates, away = np.take_along_axis(candidates, order, 1), np.take_along_axis(away, order, 1)
        between = 1 - np.matmul(x[candidates], x[candidates].transpose(0, 2, 1))
        alive, line = candidates != rows[:, None], np.arange(len(rows))
        for k in range(degree):
            first = alive.argmax(1)
            some = alive[line, first]
            kept[rows[some], k] = candidates[line, first][some]
            alive[line, first] = False
            alive &= alpha * between[line, first] > away
            if not alive.any():
                break
    source, target = np.tile(np.arange(n), degree), kept.T.ravel()  # nearest ones first
    nearest = np.arange(n * degree) < n
    source, target, nearest = source[target >= 0], target[target >= 0], nearest[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target, nearest = source[order], target[order], nearest[order]
    first = np.searchsorted(target, target)
    rank = np.arange(len(target)) - first
    back, tree = np.full((2, n, degree), -1, np.int64)
    listed = rank < degree
    back[target[listed], rank[listed]] = source[listed]
    more = ~listed & nearest
    tree[source[first[more] + rank[more] // degree - 1], rank[more] % degree] = source[more]
    return np.concatenate((kept, back, tree), axis=1)


def medoids(x: np.ndarray, k: int = 4) -> np.ndarray:
    """Rows nearest to the centres of a few parts."""
    part = x[:: max(1, len(x) // 1000)]
    return np.unique((x @ centres(part, min(k, len(part)), 3).T).argmax(0))


def _fresh(seen: np.ndarray, line: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, node) pairs not seen yet, which from now on are."""
    there = nodes >= 0
    line, nodes = line[there], nodes[there]
    new = ~seen[line, nodes]
    key = np.unique(line[new] * seen.shape[1] + nodes[new])
    line, nodes = np.divmod(key, seen.shape[1])
    seen[line, nodes] = True
    return line, nodes


def range_search(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, q: np.ndarray, own: np.ndarray, threshold: float, how: Search, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of what a greedy search finds with an inner product of at least ``threshold``.

    Each query walks from the ``starts``, and from the row that it is itself
    (``own``, -1: none), to the best places of its beam; then the neighbours of
    every row within ``margin`` of the threshold are looked at, and theirs in
    turn, until no more are in range.
    """
    beam, n = how.beam, len(q)
    first = np.column_stack((np.tile(starts, (n, 1)), np.where(np.isin(own, starts), -1, own)))
    at = np.maximum(first, 0)
    reached = np.where(first >= 0, np.einsum("ij,ikj->ik", q, x[at]), -np.inf).astype(x.dtype)
    seen = np.zeros((n, len(x)), bool)
    line, col = np.nonzero(first >= 0)
    seen[line, first[line, col]] = True
    take = np.argsort(-reached, axis=1, kind="stable")[:, :beam]
    places = np.full((n, beam), -1, np.int64)
    scores = np.full((n, beam), -np.inf, x.dtype)
    places[:, : take.shape[1]], scores[:, : take.shape[1]] = np.take_along_axis(first, take, 1), np.take_along_axis(reached, take, 1)
    opened = places < 0
    least = threshold - how.margin
    line, col = np.nonzero(reached >= least)
    near = [(line, first[line, col], reached[line, col])]
    active = np.arange(n)
    while len(active):
        waiting = np.where(opened[active], -np.inf, scores[active])
        pick = np.argsort(-waiting, axis=1, kind="stable")[:, :width]
        useful = np.take_along_axis(waiting, pick, 1) > -np.inf
        active, pick, useful = active[useful.any(1)], pick[useful.any(1)], useful[useful.any(1)]
        if not len(active):
            break
        row, k = np.nonzero(useful)
        opened[active[row], pick[row, k]] = True
        nodes = graph[places[active[row], pick[row, k]]]
        line, nodes = _fresh(seen, np.repeat(active[row], graph.shape[1]), nodes.ravel())
        if not len(line):
            continue
        s = np.einsum("ij,ij->i", q[line], x[nodes])
        close = s >= least
        near.append((line[close], nodes[close], s[close]))
        better = s > scores[line, -1]
        line, nodes, s = line[better], nodes[better], s[better]
        if not len(line):
            continue
        some, inverse = np.unique(line, return_inverse=True)
        rank = np.arange(len(line)) - np.searchsorted(line, line)
        more = np.full((len(some), int(rank.max()) + 1), -1, np.int64)
        worth = np.full(more.shape, -np.inf, x.dtype)
        more[inverse, rank], worth[inverse, rank] = nodes, s
        every = np.concatenate((scores[some], worth), axis=1)
        order = np.argsort(-every, axis=1, kind="stable")[:, :beam]
        scores[some] = np.take_along_axis(every, order, 1)
        places[some] = np.take_along_axis(np.concatenate((places[some], more), axis=1), order, 1)
        opened[some] = np.take_along_axis(np.concatenate((opened[some], more < 0), axis=1), order, 1)
    found = []
    frontier = [np.concatenate(p) for p in zip(*near)]
    while len(frontier[0]):
        found.append([p[frontier[2] >= threshold] for p in frontier[:2]])
        line, nodes = _fresh(seen, np.repeat(frontier[0], graph.shape[1]), graph[frontier[1]].ravel())
        s = np.einsum("ij,ij->i", q[line], x[nodes])
        frontier = [line[s >= least], nodes[s >= least], s[s >= least]]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    line, nodes = (np.concatenate(p) for p in zip(*found))
    order = np.argsort(line, kind="stable")
    return line[order], nodes[order]


class Forest:
    """Links that connect all that was found, fewer than there are vectors."""

    def __init__(self, query_ids: np.ndarray, ids: np.ndarray):
        nodes, inverse = np.unique(np.concatenate((query_ids, ids)), return_inverse=True)
        self.query_ids, self.ids = query_ids, ids
        self.of_query, self.of_target = inverse[: len(query_ids)], inverse[len(query_ids) :]
        self.label, self.links = np.arange(len(nodes)), []

    def add(self, i: int, t: np.ndarray) -> None:
        """Query i is linked to the targets t."""
        own = self.label[self.of_query[i]]
        roots = self.label[self.of_target[t]]
        t, roots = t[roots != own], roots[roots != own]
        if len(t):
            roots, first = np.unique(roots, return_index=True)
            self.links += [(int(self.query_ids[i]), int(self.ids[t[j]])) for j in first]
            self.label[np.isin(self.label, roots)] = own


# ---- the tables


def usable(vector: str) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    e = F.col(vector)
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(e.isNotNull() & fine & F.exists(e, lambda x: x != 0), F.lit(False))


def component_kind(vectors: DataFrame, vector: str) -> str:
    """Floats stay floats, which halves what is stored and dealt out; else double precision."""
    kind = vectors.schema[vector].dataType.simpleString()
    return kind if kind == "array<float>" else "array<double>"


def classes(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """vec, rep (least id, null if there is none), m (rows), dim and cls, a number of its own, of each distinct usable vector."""
    found = (
        vectors.select(F.col(id_col).alias("id"), F.col(vector).cast(component_kind(vectors, vector)).alias("vec"))
        .where(usable("vec"))
        .groupBy("vec")
        .agg(F.min("id").alias("rep"), F.count("*").alias("m"))
    )
    return settle(found.withColumns({"dim": F.size("vec"), "cls": F.monotonically_increasing_id()}))


def _unit_rows(column: pa.ListArray, dim: int) -> np.ndarray:
    return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def fit_centres(found: DataFrame, values: int = SHARD_VALUES, sample: int = SAMPLE, most: int = MAX_CLUSTERS) -> dict[int, np.ndarray]:
    """Cluster centres by dimension, one for each ``values`` components of its vectors, fitted to a sample.

    The sample has ``sample`` vectors of a dimension, or SAMPLE_PER_CENTRE for
    each centre if that is more; dimensions with one centre get 64.  All
    samples come in one job.
    """
    sizes = found.groupBy("dim").agg(F.count("*").alias("n"))
    centre_count = F.least(F.lit(most), F.ceil(F.col("n") / F.greatest(F.lit(1), F.floor(F.lit(values) / F.col("dim")))))
    sizes = sizes.withColumn("k", centre_count.cast("int"))
    sizes = sizes.withColumn("take", F.when(F.col("k") <= 1, 64).otherwise(F.greatest(F.lit(sample), F.col("k") * SAMPLE_PER_CENTRE)))
    drawn = found.join(F.broadcast(sizes), "dim").where(F.pmod(F.xxhash64("cls"), F.col("n")) < F.col("take"))  # a row for each dimension
    rows = drawn.select("dim", "k", "vec", F.xxhash64(F.lit(1), "cls").alias("h")).toArrow().sort_by("h")
    out = {}
    dims = np.array(rows.column("dim"))
    for dim in np.unique(dims):
        own = rows.filter(pa.array(dims == dim)).combine_chunks()
        x = _unit_rows(own.column("vec").combine_chunks(), int(dim))
        out[int(dim)] = centres(x, min(own.column("k")[0].as_py(), len(x)))
    for row in sizes.collect():  # a row for each dimension
        out.setdefault(row["dim"], np.full((1, row["dim"]), 1 / math.sqrt(row["dim"])))
    return out


def _by_dim(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """The rows of each dimension in a batch, that dimension, and their unit vectors."""
    for batch in batches:
        dims = np.array(batch.column("dim"))
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            yield part, int(dim), _unit_rows(part.column("vec"), int(dim))


def _assigned(found: DataFrame, by_dim: dict[int, np.ndarray]) -> DataFrame:
    """cls, m, vec, dim, cluster (home), second (-1: none) and away, the distance from the home's centre."""
    shared = found.sparkSession.sparkContext.broadcast(by_dim)  # at most MAX_CLUSTERS rows of each dimension
    arrow_batches(found.sparkSession, 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, dim, x in _by_dim(batches):
            s = x @ shared.value[dim].T
            line, home = np.arange(len(s)), s.argmax(1)
            away = np.sqrt(np.maximum(2 - 2 * s[line, home], 0))
            s[line, home] = -2
            second = s.argmax(1) if s.shape[1] > 1 else np.full(len(s), -1)
            data = [*part.columns, pa.array(home, pa.int32()), pa.array(second, pa.int32()), pa.array(away)]
            yield pa.RecordBatch.from_arrays(data, [*part.schema.names, "cluster", "second", "away"])

    kind = found.schema["vec"].dataType.simpleString()
    return found.select("cls", "m", "vec", "dim").mapInArrow(run, f"cls bigint, m bigint, vec {kind}, dim int, cluster int, second int, away double")


def _routed(assigned: DataFrame, by_dim: dict[int, np.ndarray], threshold: float, how: Search) -> DataFrame:
    """``assigned`` with goes: its home and, of the clusters that can hold a partner, the ``routes`` nearest."""
    bounds = {dim: (np.full(len(c), np.inf), np.full(len(c), -np.inf)) for dim, c in by_dim.items()}
    for row in assigned.groupBy("dim", "cluster").agg(F.min("away").alias("inner"), F.max("away").alias("outer")).collect():
        inner, outer = bounds[row["dim"]]  # a row for each cluster
        inner[row["cluster"]], outer[row["cluster"]] = row["inner"], row["outer"]
    shared = assigned.sparkSession.sparkContext.broadcast((by_dim, bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres_, bounds_ = shared.value
        for part, dim, x in _by_dim(batches):
            own, c = part.column("cluster").to_numpy(), centres_[dim]
            there = within_reach(x, own, c, *bounds_[dim], threshold)
            there[np.arange(len(x)), own] = True
            if not how.everything and there.shape[1] > how.routes:
                s = np.where(there, x @ c.T, -2)
                s[np.arange(len(x)), own] = 2
                nearest = np.argpartition(-s, how.routes - 1, axis=1)[:, : how.routes]
                chosen = np.zeros_like(there)
                np.put_along_axis(chosen, nearest, True, axis=1)
                there &= chosen
            data = [*part.columns, pa.array([np.flatnonzero(g) for g in there], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(data, [*part.schema.names, "goes"])

    kind = assigned.schema["vec"].dataType.simpleString()
    kept = assigned.select("cls", "m", "vec", "dim", "cluster", "second")
    return kept.mapInArrow(run, f"cls bigint, m bigint, vec {kind}, dim int, cluster int, second int, goes array<int>")


def _matrix(vecs: pd.Series) -> np.ndarray:
    return unit(np.stack(vecs.to_numpy()))


def _shards(assigned: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row for each shard that a class lies in: its home's and its second one's, and which piece of it."""
    rows = assigned.withColumn("home", F.col("cluster")).withColumn(
        "cluster", F.explode(F.filter(F.array("cluster", "second"), lambda c: c >= 0))
    )
    return rows.join(F.broadcast(sizes), ["dim", "cluster"]).withColumn("sub", F.pmod(F.xxhash64("cls"), "subs").cast("int"))


def adjacency(shards: DataFrame) -> DataFrame:
    """(cls, near array<bigint>): the united lists of a class, from the graph of each shard that it lies in."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cls")
        ids = pdf["cls"].to_numpy()
        graph = pruned_graph(_matrix(pdf["vec"]).astype(np.float32))
        return pd.DataFrame({"cls": ids, "near": [ids[g[g >= 0]] for g in graph]})

    lists = shards.select("dim", "cluster", "sub", "cls", "vec").groupBy("dim", "cluster", "sub").applyInPandas(build, "cls bigint, near array<bigint>")
    return lists.groupBy("cls").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # two lists at most


def _local_graph(ids: np.ndarray, near: pd.Series) -> np.ndarray:
    """United lists as places among ``ids`` (sorted); neighbours that lie elsewhere are left out."""
    lists = near.to_numpy()
    size = np.array([0 if g is None else len(g) for g in lists])
    if not size.sum():
        return np.full((len(ids), 1), -1, np.int64)
    flat = np.concatenate([g for g in lists if g is not None and len(g)])
    at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
    line, col = np.repeat(np.arange(len(ids)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    graph = np.full((len(ids), size.max()), -1, np.int64)
    graph[line, col] = np.where(ids[at] == flat, at, -1)
    return graph


KEY = ["dim", "cluster", "sub", "block"]


def links(assigned: DataFrame, near: DataFrame | None, sizes: DataFrame, by_dim: dict[int, np.ndarray], threshold: float, how: Search, values: int = SHARD_VALUES) -> DataFrame:
    """Rows (cls, links, partners, other).

    With ``other`` null, links counts the rows, and partners the classes, that
    one comparison adds to those linked with cls (summed over comparisons, all
    that were found).  Else cls and other are linked; those rows connect all
    that is linked.  A pair is compared where its class of the lower cluster
    asks; where that one does not, the other may.
    """
    routed = settle(_routed(assigned, by_dim, threshold, how))
    rows = F.greatest(F.lit(1), F.floor(F.lit(4 * values) / F.col("dim")))
    asked = routed.select("dim", F.explode("goes").alias("cluster")).groupBy("dim", "cluster").agg(F.ceil(F.count("*") / rows).cast("int").alias("blocks"))
    sizes = settle(sizes.join(asked, ["dim", "cluster"], "left").na.fill(1, ["blocks"]))  # a row for each cluster
    placed = _shards(routed, sizes)
    listed = placed.join(near, "cls", "left") if near is not None else placed.withColumn("near", F.lit(None).cast("array<bigint>"))
    targets = listed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    targets = targets.select(*KEY, "cls", "m", "vec", (F.col("home") == F.col("cluster")).alias("counts"), "goes", "near")
    own = F.broadcast(sizes)
    home_subs = sizes.select("dim", F.col("cluster").alias("home"), F.col("subs").alias("home_subs"))
    queries = (
        routed.withColumnRenamed("cluster", "home")
        .join(F.broadcast(home_subs), ["dim", "home"])
        .withColumn("own_sub", F.pmod(F.xxhash64("cls"), "home_subs").cast("int"))
        .withColumn("cluster", F.explode("goes"))
        .join(own, ["dim", "cluster"])
        .withColumn("sub", F.explode(F.sequence(F.when(F.col("cluster") == F.col("home"), F.col("own_sub")).otherwise(0), F.col("subs") - 1)))
        .withColumn("block", F.pmod(F.xxhash64(F.lit(7), "cls"), "blocks").cast("int"))
        # new names for the columns: both sides of the comparison come from one table
        .select(*[F.col(c).alias(c) for c in (*KEY, "cls", "m", "vec", "home")], ((F.col("cluster") == F.col("home")) & (F.col("sub") == F.col("own_sub"))).alias("inside"))
    )
    empty = pd.DataFrame({"cls": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "partners": pd.Series(dtype="int64"), "other": pd.Series(dtype="Int64")})

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return empty
        left, right = left.sort_values("cls"), right.sort_values("cls")
        ids, x, m, counts = left["cls"].to_numpy(), _matrix(left["vec"]), left["m"].to_numpy(), left["counts"].to_numpy()
        asking, xs, ms = right["cls"].to_numpy(), _matrix(right["vec"]), right["m"].to_numpy()
        home, inside, cluster = right["home"].to_numpy(), right["inside"].to_numpy(), int(left["cluster"].iloc[0])
        goes = left["goes"].to_numpy()
        asks = np.full((len(ids), max(len(g) for g in goes)), -1, np.int64)
        for k, g in enumerate(goes):
            asks[k, : len(g)] = g
        single, singles = x.astype(np.float32), xs.astype(np.float32)
        if not how.everything:
            graph, starts = _local_graph(ids, left["near"]), medoids(single)
            there = np.minimum(np.searchsorted(ids, asking), len(ids) - 1)
            own = np.where(ids[there] == asking, there, -1)
        forest = Forest(asking, ids)
        sums = [np.zeros(n, np.int64) for n in (len(asking), len(asking), len(ids), len(ids))]
        for at in range(0, len(asking), 256):
            if how.everything:
                i, t = np.nonzero(xs[at : at + 256] @ x.T >= threshold)
            else:
                i, t = range_search(single, graph, starts, singles[at : at + 256], own[at : at + 256], threshold - SINGLE_SLACK, how)
            i = i + at
            sure = counts[t] & (asking[i] != ids[t]) & (np.einsum("ij,ij->i", xs[i], x[t]) >= threshold)
            sure &= ~inside[i] | (ids[t] > asking[i])  # both sides hold such a pair twice: once is enough
            i, t = i[sure], t[sure]
            left_to_it = (home[i] > cluster) & (asks[t] == home[i][:, None]).any(1)  # the lower cluster's class asks by itself
            i, t = i[~left_to_it], t[~left_to_it]
            for total, place, what in zip(sums, (i, i, t, t), (m[t], 1, ms[i], 1)):
                np.add.at(total, place, what)
            for k, own_targets in zip(*_groups(i, t)):
                forest.add(int(k), own_targets)
        out = [pd.DataFrame({"cls": c[p > 0], "links": n[p > 0], "partners": p[p > 0], "other": None}) for c, n, p in ((asking, *sums[:2]), (ids, *sums[2:]))]
        out.append(pd.DataFrame({"cls": [a for a, _ in forest.links], "links": 0, "partners": 0, "other": [b for _, b in forest.links]}))
        return pd.concat([empty, *(part.astype(empty.dtypes) for part in out)])

    return targets.groupBy(*KEY).cogroup(queries.groupBy(*KEY)).applyInPandas(compare, "cls bigint, links bigint, partners bigint, other bigint")


def _groups(i: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The targets of each query, from pairs in order of the query."""
    own, first = np.unique(i, return_index=True)
    return own, np.split(t, first[1:])


def audit(found: DataFrame, counts: DataFrame, threshold: float, sample: int = 200) -> float | None:
    """Mean share of its true partners that a linked class was found with; None if no class of the sample has a link.

    The sample is ``sample`` classes that were found linked and as many others,
    in an order by hash; each is compared with all classes, in blocks.  Every
    class that truly has a partner weighs alike, whatever its copies.
    """
    known = found.join(counts, "cls", "left").select("cls", "dim", "vec", F.coalesce("partners", F.lit(0)).alias("partners"))
    order = [F.xxhash64(F.lit(3), "cls"), F.col("cls")]
    parts = [known.where(c).orderBy(*order).limit(sample) for c in (F.col("partners") > 0, F.col("partners") == 0)]
    drawn = parts[0].unionByName(parts[1]).toArrow().to_pylist()
    if not drawn:
        return None
    by_dim = {}
    for k, r in enumerate(drawn):
        by_dim.setdefault(r["dim"], []).append(k)
    asked = {dim: (np.array(own), unit(np.array([drawn[k]["vec"] for k in own]))) for dim, own in by_dim.items()}
    shared = found.sparkSession.sparkContext.broadcast(asked)  # 2 x sample vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(drawn), np.int64)
        for _, dim, x in _by_dim(batches):
            if dim in shared.value:
                own, q = shared.value[dim]
                total[own] += (q @ x.T >= threshold).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "n"])

    rows = found.select("vec", "dim").mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()
    shares = [min(1.0, drawn[r["k"]]["partners"] / (r["n"] - 1)) for r in rows if r["n"] > 1]  # each meets itself once
    return float(np.mean(shares)) if shares else None


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector: str = "embedding", values: int = SHARD_VALUES, target: float = 0.99, how: Search = Search()) -> DataFrame:  # noqa: B008
    """One row per row of ``vectors``: id, n_links, component_id, kept, recall.

    Vectors that are null, zero, or hold null or non-finite components link
    with nothing, and vectors of different lengths do not link.  Equal vectors
    count each other.  Rows that repeat an id are told apart by their vectors.
    Rows without an id count as links; component_id is the least id there is in
    the component, null if there is none, and then they are kept.  recall is
    that of :func:`audit` for the whole table (null: no link in the sample);
    under ``target`` the search is widened twice, and then misses nothing.  An
    empty table gives no rows; other columns are not read.
    """
    found = classes(vectors, id_col, vector)
    by_dim = fit_centres(found, values)
    rows = vectors.select(F.col(id_col), F.col(vector).cast(component_kind(vectors, vector)).alias("_vec"))
    rows = rows.withColumn("_vec", F.when(usable("_vec"), F.col("_vec")))
    if not by_dim:
        alone = [F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"), F.lit(True).alias("kept")]
        return rows.select(id_col, *alone, F.lit(None).cast("double").alias("recall"))
    assigned = settle(_assigned(found, by_dim))
    held = assigned.select("dim", F.explode(F.filter(F.array("cluster", "second"), lambda c: c >= 0)).alias("cluster"))
    cap = F.greatest(F.lit(1), F.floor(F.lit(4 * values) / F.col("dim")))
    sizes = settle(held.groupBy("dim", "cluster").agg(F.ceil(F.count("*") / cap).cast("int").alias("subs")))
    near = settle(adjacency(_shards(assigned, sizes)))
    for attempt in range(3):
        pairs = settle(links(assigned, near, sizes, by_dim, threshold, how, values))
        counts = pairs.where(F.col("other").isNull()).groupBy("cls").agg(F.sum("links").alias("links"), F.sum("partners").alias("partners"))
        counts = settle(counts)
        recall = audit(found, counts, threshold)
        if recall is None or recall >= target or how.everything:
            break
        how = replace(how, everything=True) if attempt == 1 else how.wider()
    # a node knows its least id, so that a component's least node tells it and no join on the component is needed
    node = F.struct(F.col("rep").isNull().alias("no_id"), "rep", "cls")
    named = found.select(node.alias("node"), F.col("cls").alias("_c"))
    forest = pairs.where(F.col("other").isNotNull()).select("cls", "other")
    forest = forest.join(named.withColumnRenamed("node", "a"), F.col("cls") == F.col("_c")).drop("_c")
    forest = forest.join(named.withColumnRenamed("node", "b"), F.col("other") == F.col("_c")).select("a", "b")
    groups = connected_components(forest).select(F.col("node.cls").alias("_g"), F.col("component.rep").alias("least"))
    every = (
        found.join(counts, "cls", "left")
        .join(groups, F.col("cls") == F.col("_g"), "left")
        .select(
            "vec",
            (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.when(F.col("_g").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"),
            F.lit(True).alias("known"),
        )
    )
    joined = rows.join(every, F.col("_vec") == F.col("vec"), "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col(id_col))
    return joined.select(
        id_col,
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.when(component.isNull(), True).otherwise(F.coalesce(component == F.col(id_col), F.lit(False))).alias("kept"),
        F.lit(recall).cast("double").alias("recall"),
    )
