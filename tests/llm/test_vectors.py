"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest

from tidemark.llm import queries, vectors

SF = "/root/testdata/sf0.001"


def components(near):
    """Least row that each row reaches."""
    label, n = np.arange(len(near)), len(near)
    while True:
        least = np.array([label[near[i] | (np.arange(n) == i)].min() for i in range(n)])
        if (least == label).all():
            return label
        label = least


def cosines(x):
    x = np.array(x, float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x @ x.T


def collect(df):
    return {r["vec_id"]: r for r in df.collect()}


@pytest.mark.parametrize("values", [vectors.SHARD_VALUES, 64 * 25])
def test_standard_table(spark, values):
    """With the standard shards, and with many small ones that overlap."""
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    out = collect(queries.op5_near_vectors(spark, SF) if values == vectors.SHARD_VALUES else vectors.near_vectors(table, values=values))
    rows = sorted(table.collect(), key=lambda r: r["vec_id"])
    near = cosines([r["embedding"] for r in rows]) >= 0.95
    label = components(near)
    for i, r in enumerate(rows):
        own = out[r["vec_id"]]
        assert own["n_links"] == near[i].sum() - 1
        assert own["component_id"] == rows[label[i]]["vec_id"] and own["kept"] == (label[i] == i)


def test_odd_rows(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [1.0, float("inf")]), (6, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0]), (10, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect()}
    assert {k for k, v in out.items() if v == (0, k, True)} == {1, 2, 3, 4, 5, 9, 10}
    assert out[6] == (2, 6, True) and out[7] == (2, 6, False) and out[8] == (2, 6, False)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_ids_that_are_missing_or_repeat(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.001]), (1, [0.0, 1.0]), (None, [1.0, 0.002]), (None, [-1.0, 0.0]), (None, [-1.0, 0.001]), (7, [0.0, -1.0]), (None, None)]
    df = spark.createDataFrame([(i, v, "clash", 3) for i, v in rows], "vec_id bigint, embedding array<double>, cls string, rep int")
    found = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in vectors.near_vectors(df).collect())
    assert found == sorted(
        [("1", 2, "1", True), ("1", 2, "1", True), ("1", 0, "1", True), ("None", 2, "1", False),
         ("None", 1, "None", True), ("None", 1, "None", True), ("7", 0, "7", True), ("None", 0, "None", True)]
    )


@pytest.fixture(scope="module")
def crowd(spark):
    """2000 pairs in all directions, and 300 near copies of a vector that 3000 rows share; what links with what."""
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 2300, 64))
    a[2000:] = a[2000]
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= np.einsum("ij,ij->i", a, b)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    c = np.where(np.arange(2300) < 2000, 0.951, 0.98)[:, None]
    copies = a * c + b * np.sqrt(1 - c**2)
    x = np.concatenate((a[:2000], copies[:2000], np.repeat(a[2000:2001], 3000, 0), copies[2000:]))
    df = spark.createDataFrame(list(zip(range(len(x)), x.tolist())), "vec_id bigint, embedding array<double>").repartition(4)
    return df, np.concatenate([x[i : i + 1000] @ x.T >= 0.95 for i in range(0, len(x), 1000)])


@pytest.mark.parametrize("values", [vectors.SHARD_VALUES, 64 * 250])
def test_recall_of_each_linked_class(crowd, values):
    """Far pairs in many overlapping shards, and one crowd: the recall told is that of all linked classes, each with weight 1."""
    df, near = crowd
    out = collect(vectors.near_vectors(df, values=values))
    true = near.sum(1) - 1
    own = [i for i in np.flatnonzero(true) if not 4000 < i < 7000]  # one of the equal rows, and all others
    recall = np.mean([out[i]["n_links"] / true[i] for i in own])
    assert all(out[i]["n_links"] <= true[i] for i in own)
    assert recall >= 0.98 and abs(out[0]["recall"] - recall) < 0.03
    both = [out[i]["n_links"] == out[i + 2000]["n_links"] for i in range(2000)]  # a link counts at both ends
    assert all(both) and all(out[i]["component_id"] in (i, i % 2000) for i in range(4000))
    assert {out[i]["component_id"] for i in range(4000, 7000)} == {4000}


def test_everything_misses_nothing(crowd):
    df, near = crowd
    out = collect(vectors.near_vectors(df, values=64 * 250, how=vectors.Search(everything=True)))
    assert [out[i]["n_links"] for i in range(len(near))] == (near.sum(1) - 1).tolist()


def test_a_poor_search_is_widened(crowd):
    """One route and a beam of one lose links; the audit sees it, and what is returned has the target."""
    df, near = crowd
    out = collect(vectors.near_vectors(df, values=64 * 250, how=vectors.Search(routes=1, beam=1, margin=0.0)))
    true = near.sum(1) - 1
    own = [i for i in np.flatnonzero(true) if not 4000 < i < 7000]
    assert np.mean([out[i]["n_links"] / true[i] for i in own]) >= 0.98 and out[0]["recall"] >= 0.99


def test_clusters_within_reach():
    rng = np.random.default_rng(2)
    x, c = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.normal(size=(300, 16)), rng.normal(size=(3000, 16))))
    own = (x @ c.T).argmax(1)
    inner, outer = rng.uniform(0, 0.2, 3000), rng.uniform(0.3, 0.8, 3000)
    got = vectors.within_reach(x, own, c, inner, outer, 0.95)
    r = np.sqrt(2 - 2 * 0.95) + vectors.SLACK
    s = x @ c.T
    apart, away = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0)), np.sqrt(np.maximum(2 - 2 * s, 0))
    want = (s[np.arange(300), own][:, None] - s <= r * apart[own] + vectors.SLACK) & (away <= outer + r + vectors.SLACK) & (away >= inner - r - vectors.SLACK)
    assert (got == want).all() and 0 < got.sum() < got.size


def test_reach_needs_little_memory():
    import tracemalloc

    rng = np.random.default_rng(2)
    c = rng.normal(size=(16_384, 64))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x, own = c[:1000], np.arange(1000)
    tracemalloc.start()
    found = vectors.within_reach(x, own, c, np.zeros(len(c)), np.full(len(c), 0.5), 0.95)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and found[np.arange(1000), own].all()
