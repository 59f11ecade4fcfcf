"""Language-model scores and collocations against plain versions of them."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import batches, collocations, restaurants

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (4, "One two"), (5, "the end.\nThe END\x0bthe"), (None, "no id at all"), (6, "word " * 3000), (7, "Ünï cödé ß x")]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "src", "clash", 7, b"x", 1.5) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, block string, number int, keys binary, score double")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab Cé.\t\n,", max_size=40)), max_size=8))
def test_words(texts):
    words = batches.split_words(pa.array(texts, pa.string()), collocations.KINDS)
    told = [(bytes(words.body[s:e]).decode(), int(r), int(p)) for s, e, r, p in zip(words.starts, words.ends, words.rows, words.pieces)]
    plain, piece = [], 0
    for row, text in enumerate(texts):
        for part in re.split(r"[.,;:!?\n-\r]", lowered(text)):
            plain += [(w, row, piece) for w in re.split("[ \t]+", part) if w]
            piece += 1
    assert [t[:2] for t in told] == [p[:2] for p in plain]
    same = [a[2] == b[2] for a, b in zip(told, told[1:])]
    assert same == [a[2] == b[2] for a, b in zip(plain, plain[1:])]
    by = dict(zip([t[0] for t in told], words.keys))
    assert len(set(by.values())) == len(by) and all(by[t[0]] == k for t, k in zip(told, words.keys))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50), st.integers(0, 9))
def test_packing_of_keys(keys, bits):
    keys = np.unique(np.array(keys, np.uint64))
    assert (batches.unpack_sorted(batches.pack_sorted(keys)) == keys).all()
    cut = list(batches.buckets_of(keys, bits))
    assert sum(s.stop - s.start for _, s in cut) == len(keys)
    assert all((int(k) >> 64 - bits) == b for b, s in cut for k in keys[s])


def plain_collocations(docs, at_least, top):
    found = {}
    for lang in {lang or "und" for lang, _ in docs}:
        f = Counter()
        for own, text in docs:
            if (own or "und") == lang:
                for piece in re.split(r"[.,;:!?\n-\r]", lowered(text)):
                    w = [x for x in re.split("[ \t]+", piece) if x]
                    f.update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        good = {p: c for p, c in f.items() if len(p) > 1 and c >= at_least}
        rows = []
        for p, a in good.items():
            if any(len(q) > len(p) and 100 * c >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in good.items()):
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            found[lang, rank] = (phrase.decode(), -a, l, r, n, -score)
    return found


def test_collocations(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["a", "b", "c", "Dd", "é", "f", "g-h"]
    docs = [(["en", None, "fr"][i % 3], " ".join(rng.choice(vocabulary, 30)) + rng.choice([". ", "\n", "  "]) + "a b c Dd é f") for i in range(60)]
    docs += docs[:10] + [("en", None), ("en", ""), ("zz", "one two")]
    got = collocations.collocations(spark.createDataFrame(docs, "lang string, text string"), at_least=4, top=50)
    told = {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got.collect()}
    assert told == plain_collocations(docs, 4, 50) and len(told) > 100


def test_collocations_of_odd_rows(spark, odd):
    rows = collocations.collocations(odd, at_least=2).collect()
    assert "word word word word word" in {r["phrase"] for r in rows}
    assert collocations.collocations(odd.limit(0)).count() == 0


def test_common_passages_keep_their_parse(spark):
    text = " ".join(f"w{i * 7919 % 400}" for i in range(300))
    docs = [("en", text)] * 20 + [("en", f"lead{i} {text}") for i in range(20)]
    chunks = collocations.parse(spark.createDataFrame(docs, "lang string, text string")).collect()
    assert sum(c["own"] * c["n"] for c in chunks) == 20 * 300 + 20 * 301
    assert max(c["n"] for c in chunks) == 40 and len(chunks) < 80


# -- the restaurants


def stirling(c, d):
    s = {(1, 1): 1.0}
    for k in range(1, c):
        for t in range(1, k + 2):
            s[k + 1, t] = s.get((k, t - 1), 0.0) + (k - d * t) * s.get((k, t), 0.0)
    return np.array([s[c, t] for t in range(1, c + 1)])


@pytest.mark.parametrize("customers, mass", [(2, 0.3), (3, 2.0), (7, 0.01), (30, 5.0), (64, 1.0)])
def test_draws_of_tables(customers, mass):
    n, d = 40_000, 0.6
    drawn = restaurants.draw_tables(np.full(n, customers), np.full(n, mass), d, np.random.default_rng(5))
    p = stirling(customers, d) * mass ** np.arange(customers)
    p /= p.sum()
    seen = np.bincount(drawn, minlength=customers + 1)[1:] / n
    assert np.abs(seen - p).max() < 0.01


@pytest.mark.parametrize("customers, mass, d", [(65, 0.5, 0.7), (300, 3.0, 0.5), (1000, 40.0, 0.8), (2000, 0.05, 0.3)])
def test_draws_of_many_customers(customers, mass, d):
    logs = restaurants.table_weights(d, customers)[customers, 1:] + np.arange(customers) * math.log(mass)
    p = np.exp(logs - logs.max())
    mean = (p / p.sum() * np.arange(1, customers + 1)).sum()
    drawn = restaurants.draw_tables(np.full(4000, customers), np.full(4000, mass), d, np.random.default_rng(5))
    assert drawn.min() >= 1 and drawn.mean() == pytest.approx(mean, rel=0.08)


def test_seating_by_single_customers():
    """The drawn numbers of tables are those that removing and seating one customer after another settles at."""
    rng, d, mass, c = np.random.default_rng(1), 0.5, 0.8, 6
    tables, seen = [c], Counter()
    for step in range(60_000):
        k = rng.choice(len(tables), p=np.array(tables) / c)
        tables[k] -= 1
        tables = [t for t in tables if t]
        w = np.array([*[t - d for t in tables], mass])
        k = rng.choice(len(w), p=w / w.sum())
        tables = [*tables, 1] if k == len(tables) else [t + (i == k) for i, t in enumerate(tables)]
        seen[len(tables)] += 1
    p = stirling(c, d) * mass ** np.arange(c)
    p /= p.sum()
    assert all(abs(seen[t] / 60_000 - p[t - 1]) < 0.02 for t in range(1, c + 1))


def plain_scores(docs):
    learned = [(i, t) for i, t in docs if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    tokens = lambda t: [*[w for w in re.split(r"[ \t-\r]+", lowered(t)) if w], None]
    c = Counter(w for _, t in learned for w in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in docs:
        w = tokens(t)
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        out.append((i, held, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)))
    return out


def by_row(rows):
    return sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("words", [1 << 20, 40])
def test_scores(spark, words):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = restaurants.score_documents(docs, words=words).collect()
    plain = sorted(plain_scores([(r["doc_id"], r["text"]) for r in docs.collect()]), key=lambda r: (r[0] is None, r))
    got = by_row(rows)
    assert [g[:5] for g in got] == [p[:5] for p in plain]
    assert [g[5] for g in got] == pytest.approx([p[5] for p in plain])
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    bits = lambda flag, name: sum(-r[name] for r in rows if r["held_out"] is flag) / sum(r["n_tokens"] for r in rows if r["held_out"] is flag)
    if words > 40:
        assert bits(True, "score") < bits(True, "base_score") and bits(False, "score") < 0.8 * bits(False, "base_score")


def test_odd_scores(spark, odd):
    rows = restaurants.score_documents(odd).collect()
    assert len(rows) == len(ODD)
    plain = sorted(plain_scores(ODD), key=lambda r: (r[0] is None, r))
    assert [g[:5] for g in by_row(rows)] == [p[:5] for p in plain]
    assert [g[5] for g in by_row(rows)] == pytest.approx([p[5] for p in plain])
    assert len({r["score"] for r in rows if r["doc_id"] == 4}) == 1
    assert restaurants.score_documents(odd.limit(0)).count() == 0
    nothing = restaurants.score_documents(odd.where("doc_id = 0 or crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in nothing)


def test_probabilities_add_up(spark):
    """What the model says of all words after a context, and of one that it never saw, makes one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = restaurants.train(docs, words=300)
    size, asked = len(model.lexicon.keys) + 1, model.lexicon.customers()
    assert model.state.root.sum(axis=0) == pytest.approx(np.ones(restaurants.CHAINS), rel=1e-5)
    counts = {}
    for row in model.gathered.where("not rare").collect():
        contexts, dishes = restaurants._pairs(batches.unpack_sorted(row["keys"]))
        customers = batches.unplaned(row["counts"]).astype(np.int64)
        tables = np.ones((len(customers), restaurants.CHAINS), np.int64)
        several = np.flatnonzero(customers > 1)
        tables[several] = restaurants._drawn(model.drawn_from, contexts[several], dishes[several], customers[several], model.seed, row["bucket"])
        counts |= {(int(u), int(w)): (int(n), t) for u, w, n, t in zip(contexts, dishes, customers, tables)}
    for context in np.argsort(-asked)[[0, 5, 50, 200]].tolist():
        own = [counts.get((context, w), (0, np.zeros(restaurants.CHAINS))) for w in range(size)]
        assert sum(n for n, _ in own) == asked[context]
        p = restaurants.predictive(model.state, asked, np.full(size, context), np.arange(size), np.array([n for n, _ in own]), np.array([t for _, t in own]))
        assert (p > 0).all() and p.sum() == pytest.approx(1, rel=1e-5)
