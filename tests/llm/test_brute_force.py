"""Operators whose results SQL cannot express, against plain Python on small inputs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, licences, lines, mixing, packing, quality, queries, simhash, toxicity, wordpiece

SF = "/root/testdata/sf0.001"


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    tok, rng = Tokenizer.from_file(path), random.Random(4)
    encoder = packing.WordEncoder(open(path, encoding="utf-8").read(), cache_entries=500)
    latin = [chr(i) for i in range(1, 256)] + list("abcdefgh" * 9) + list("'.,;: \n\t" * 4)
    wide = list("ßİΣςσΆ̈中文१२é") + [chr(0x2003), chr(0x3000)]
    pools = [latin, latin + wide, [chr(rng.randrange(1, 0xD7FF)) for _ in range(60)] + list("ab 's ")]
    for _ in range(300):
        texts = ["".join(rng.choice(pools[k % 3]) for _ in range(rng.randrange(60))) for k in range(9)]
        want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert encoder.encode(pa.array([*texts, None])) == [*want, b""]


def brute_chat(turns):
    """(formatted, [(start, end)] of the trained texts in code points) of sorted (role, text) turns."""
    out, spans = "", []
    for i, (role, text) in enumerate(turns):
        if i == 0 or turns[i - 1][0] != role:
            out += "### " + role.replace("\\", "\\e").replace(":", "\\c").replace("\n", "\\n").replace("</turn>", "<\\/turn>") + ":\n"
        else:
            out += "</part>"
        at = len(out)
        out += text.replace("\\", "\\e").replace("</turn>", "<\\/turn>").replace("</part>", "<\\/part>").replace("### ", "#\\## ")
        if role == "assistant":
            spans.append((at, len(out)))
        if i == len(turns) - 1 or turns[i + 1][0] != role:
            out += "</turn>\n"
    return out, spans


def test_chat_mask_and_text(spark):
    odd = ["", "\\", "</turn>\n", "é</part>", "### user:\n", "中文 ### ", "<\\/turn>", "\\e", "plain", "😀" * 9]
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "a:\n b"]), rng.choice(odd)) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(99, t, "assistant" if t % 3 else "user", f"{rng.choice(odd)} {t}") for t in range(3000)]  # a very long conversation
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    for r in made.withColumn("loss", chat.loss_texts(F.col("formatted"), F.col("loss_runs"))).collect():
        own = sorted((t, role, text) for c, t, role, text in rows if c == r["conv_id"])
        want, spans = brute_chat([x[1:] for x in own])
        assert r["formatted"] == want
        at, found, byte = 0, [], 0
        for run in r["loss_runs"]:
            if run["loss"]:
                found.append((at, at + run["length"]))
            assert run["start"] == byte
            at, byte = at + run["length"], byte + run["bytes"]
        assert (at, byte) == (len(want), len(want.encode())) and found == spans
        assert r["loss"] == [text for _, role, text in own if role == "assistant"]
    assert chat.format_chats(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_chat_query_cuts_by_the_mask(spark, monkeypatch):
    """A mask that covers too much changes the query's loss columns."""
    plain = {r["conv_id"]: r["loss_chars"] for r in queries.op4_chat_format(spark, SF).collect()}
    monkeypatch.setattr(chat.format_chats, "__defaults__", (*chat.format_chats.__defaults__[:-1], "user"))
    turned = {r["conv_id"]: r["loss_chars"] for r in queries.op4_chat_format(spark, SF).collect()}
    assert plain[-7] == turned[-7] == len("\\### Assistant: </turn> ok") and plain != turned


def test_lines_with_hot_keys(spark):
    """A line that most rows have, one that a document repeats, and rare ones, against plain Python."""
    rng = random.Random(8)
    rows = []
    for i in range(300):
        own = [f"own {i}", "Hot line" if i % 3 else "  HOT LINE\t", *rng.choices(["a", "b", "c", "", "  "], k=4), f"part {i % 40}"]
        rows.append((i % 290, "\n".join(own) if i % 50 else None))
    rows.append((999, "\n".join(["again"] * 2000)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    having = {}
    for i, t in rows:
        for x in set(map(key, (t or "").split("\n"))) - {""}:
            having.setdefault(x, set()).add((i, t or ""))
    for least in (2, 10):
        want = []
        for i, t in rows:
            cut = (t or "").split("\n")
            kept = [x for x in cut if len(having.get(key(x), ())) < least]
            want.append((i, len(cut), len(cut) - len(kept), "\n".join(kept)))
        got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in lines.dedup_lines(df, min_documents=least).collect()]
        assert sorted(got) == sorted(want)


def test_line_dedup_streams_sorted_rows(spark):
    """First occurrences come from a window over range-partitioned rows, with no shuffle between and no hash aggregate before it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    parts = lines.first_occurrences(lines.keyed_lines(docs), 4)
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Sort [" in plan and plan.count("Exchange") == 1 and "HashAggregate" not in plan


def brute_licences(words, idf, slack=3):
    """label -> coverage, from the definition: every alignment of a notice, every key phrase word by word."""
    found = {}
    for label, (notice, phrases) in licences.TEMPLATES.items():
        own = {k: w for k, w in enumerate(notice.split()) if len(w) >= 4}
        total, length = sum(idf.get(w, 0.0) for w in own.values()), max(own) + slack
        starts = [[i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p in phrases]
        if not all(starts):
            continue
        for s in range(-length, len(words)):
            agree = sum(1 for k, w in own.items() if 0 <= s + k < len(words) and words[s + k] == w)
            if agree >= 2 and all(any(s - slack <= i <= s + length for i in x) for x in starts):
                has = sum(idf.get(w, 0.0) for k, w in own.items() if w in words[max(0, s + k - slack) : max(0, s + k + slack + 1)])
                found[label] = max(found.get(label, 0.0), has / total if total else 0.0)
    return found


def test_licence_labels_and_scores(spark):
    """Labels and scores of texts with whole, broken and mixed notices, against the definition."""
    rng, rows = random.Random(5), []
    filler = "this software license and the of free files program source under terms".split()
    for i, (notice, phrases) in enumerate(list(licences.TEMPLATES.values()) * 4):
        words = notice.split()
        if i % 4 == 1:
            del words[rng.randrange(len(words))]
        if i % 4 == 2:
            words[rng.randrange(len(words))] = rng.choice(filler)
        if i % 4 == 3:
            words = words[: len(words) // 2] + rng.choices(filler, k=5) + words[len(words) // 2 :]
        rows.append((i, " ".join(rng.choices(filler, k=rng.randrange(20)) + words + rng.choices(filler, k=9) + (["MIT License"] if i % 5 == 0 else []))))
    rows.append((100, licences.TEMPLATES["gpl-notice"][0].replace("gnu general", "our general")))
    rows += [(101, None), (102, ""), (103, "apache license " * 3000)]
    df = spark.createDataFrame([(i, t, "x", [1]) for i, t in rows], "doc_id bigint, text string, places string, stands array<int>")
    cut = {i: licences.WORD.findall((t or "").lower()) for i, t in rows}
    index = licences.index_words(licences.TEMPLATES)
    held = {w: sum(w in own for own in map(set, cut.values())) for w in index}
    idf = {w: np.log((1 + len(rows)) / n) for w, n in held.items() if n}
    found = {r["doc_id"]: r for r in licences.scan_licences(df).collect()}
    assert found[100]["labels"] == [] and len(found) == len(rows)
    for i, words in cut.items():
        want = brute_licences(words, idf) if i != 103 else {}
        assert dict(found[i]["matches"]) == pytest.approx(want), i
        base = found[i]["base_labels"]
        assert found[i]["labels"] == sorted({*want, *base})
        assert found[i]["score"] == pytest.approx(1 - (0.5 if base else 1.0) * (1 - max(want.values(), default=0.0)))


def test_toxicity_scores_and_gradient():
    model = toxicity.Model({"vile": 5.0, "vil-": 1.0, "mean": 3.0, "nic-": -2.0}, -4.0)
    text = "Such a vile, vile man! mean nicely. 123 ...\nVILEST of all?! İİ vile"

    def brute(t):
        bags, zs = set(), []
        for s in toxicity.SENTENCE.findall(t.lower()):
            own = toxicity.WORD.findall(s)
            if own:
                bag = frozenset(f for w in own for f in toxicity.features(w) if f in model.weights)
                bags.add(bag)
                zs.append(model.bias + sum(model.weights[f] for f in bag) if bag else -np.inf)
        clean = np.prod([1 - 1 / (1 + np.exp(-model.bias - sum(model.weights[f] for f in bag))) for bag in bags if bag])
        return 1 - clean, sum(z > 0 for z in zs), int(np.argmax(zs))

    score, offending, start, length, number = model.scorer().score(text)
    want = brute(text)
    assert score == pytest.approx(want[0]) and offending == want[1] and number == want[2]
    assert "vile" in text[start : start + length].lower()
    tied = model.scorer().score("vile a. vile b.")
    assert tied[2:] == (0, 6, 0)
    wide = "İ" * 5 + ". So vile"  # its lower case is longer
    found = model.scorer().score(wide)
    assert wide[found[2] : found[2] + found[3]] == " So vile"
    rng = np.random.default_rng(1)
    owner = np.repeat(np.arange(6), 3)
    bag = toxicity.Bags(np.array([1, 0, 1, 0, 0, 1.0]), np.full(6, 1 / 6), owner, rng.integers(0, 18, 40), rng.integers(0, 5, 40))
    theta = np.append(rng.normal(size=5), -2.0)
    value, gradient = bag.loss(theta, 0.01)
    for k in range(6):
        step = np.zeros(6)
        step[k] = 1e-6
        assert (bag.loss(theta + step, 0.01)[0] - bag.loss(theta - step, 0.01)[0]) / 2e-6 == pytest.approx(gradient[k], rel=1e-4, abs=1e-7)
    bags = [1.0]
    for d in range(6):  # the likelihood itself, by its definition
        clean = 1.0
        for s in np.flatnonzero(owner == d):
            clean *= 1 - 1 / (1 + np.exp(-(theta[-1] + sum(theta[w] for w, at in zip(bag.which, bag.sentence) if at == s))))
        bags.append(1 - clean if bag.y[d] else clean)
    assert value == pytest.approx(-np.log(bags).sum() / 6 + 0.005 * (theta[:-1] ** 2).sum())


def test_length_alone_is_not_toxic(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where(~toxicity.held_out()).select("doc_id", "toxic"))
    scorer = model.scorer()
    word = next(f for f in model.weights if not f.endswith("-"))
    assert scorer.score("a harmless sentence. " * 20_000)[0] < 0.3
    varied = " ".join(f"harmless {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}." for i in range(17_000))
    assert scorer.score(varied)[0] < 0.3
    assert scorer.score(f"so {word} it is. ")[0] == pytest.approx(scorer.score(f"so {word} it is. " * 5_000)[0])


@pytest.mark.parametrize("radius", range(5))
def test_every_radius(spark, radius):
    rng = np.random.default_rng(radius)
    prints, want = [], set()
    for _ in range(200):
        a = int(rng.integers(0, 2**63))
        b = a
        for bit in rng.choice(63, radius, replace=False).tolist():
            b ^= 1 << bit
        prints += [(a,), (b,)]
        if radius:
            want.add((min(a, b), max(a, b)))
    df = spark.createDataFrame(prints, "fp bigint")
    assert {tuple(r) for r in simhash.near_pairs(df, radius).collect()} == want
    with pytest.raises(ValueError):
        simhash.near_pairs(df, 5)


def test_mixing_against_plain_python(spark):
    """Posteriors word by word, and all eight totals at their targets."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labelled = queries.domain_labels(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    names = list(mixing.TARGETS)
    domain = {r["doc_id"]: r["domain"] for r in labelled.collect() if r["domain"] in names}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    words = {i: [w for w in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if w] for i, t in texts.items()}
    every = sorted({w for own in words.values() for w in own})
    hashed = spark.createDataFrame([(w,) for w in every], "w string").withColumn("b", F.pmod(F.xxhash64("w"), F.lit(mixing.BUCKETS)))
    bucket = {r["w"]: r["b"] for r in hashed.collect()}
    counts = np.zeros((len(names), mixing.BUCKETS))
    for i, d in domain.items():
        for w in words[i]:
            counts[names.index(d), bucket[w]] += 1
    background, sums = counts.sum(0) / counts.sum(), counts.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        odds = np.where(background > 0, np.log((counts + 100 * background) / (sums[:, None] + 100) / background), 0.0)
    prior = np.log((np.array([sum(x == d for x in domain.values()) for d in names]) + 0.5) / (len(domain) + 0.5 * len(names)))
    out = queries.op1_mixing(spark, SF).collect()
    assert len(out) == len(texts)
    for r in out:
        own = [bucket[w] for w in words[r["doc_id"]]]
        z = prior + odds[:, own].sum(1) / np.sqrt(max(len(own), 1))
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert [r[f"p{k}"] for k in range(len(names))] == pytest.approx(p.tolist(), rel=1e-6, abs=1e-9) and r["n_tokens"] == len(own)
        assert r["rate"] >= 0 and abs(r["copies"] - r["rate"]) < 1
    total = sum(r["n_tokens"] for r in out)
    gaps = [abs(sum(r["n_tokens"] * r["rate"] * r[f"p{k}"] for r in out) / total - mixing.TARGETS[d] / sum(mixing.TARGETS.values())) for k, d in enumerate(names)]
    assert out[0]["target_gap"] == pytest.approx(max(gaps), abs=1e-6) and max(gaps) < 0.02


LONG = [(1, "word " * 60_000), (2, "x" * 400_000), (3, "line\n" * 40_000), (4, "Say it. " * 30_000), (5, None), (6, "")]


def test_very_long_and_empty_texts(spark):
    df = spark.createDataFrame([(i, t, "src", "en", len(t or "")) for i, t in LONG], "doc_id bigint, text string, source string, lang string, n_chars bigint")
    model = toxicity.Model({"say": 1.0}, -6.0)
    labelled = spark.createDataFrame([(1, "en-high"), (2, "en-low")], "doc_id bigint, domain string")
    for f in (
        lambda d: mixing.mix(d, labelled), quality.judge_hosts, lambda d: wordpiece.count_tokens(d, queries.vocabulary_path()),
        licences.scan_licences, simhash.near_groups, lambda d: toxicity.score_documents(d, model), lambda d: lines.dedup_lines(d, min_documents=1),
        simhash.keep_one,
    ):
        assert f(df).count() == (5 if f is simhash.keep_one else 6) and f(df.limit(0)).count() == 0  # null and empty texts are copies
    packed = packing.pack_documents(df, queries.vocabulary_path(), digest_only=True).collect()
    assert sum(r["length"] for r in packed if r["doc_id"] == 1) == 60_001 and {r["doc_id"] for r in packed} == {1, 2, 3, 4, 5, 6}


CLASHING = ["_row", "_bits", "_kept", "n_lines", "n_dropped", "kept_text", "_self", "self", "doc", "_doc", "fp", "component_id", "score", "bits", "rate", "copies", "_id", "label", "weight", "length"]


def test_pipeline_against_plain_python(spark, monkeypatch):
    """Each stage on rows with clashing columns: what stays, and that other columns come through."""
    import corpus_pipeline

    monkeypatch.setattr(toxicity, "train", lambda *_: toxicity.Model({"vile": 9.0}, -6.0))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wide = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])
    rows = {r["doc_id"]: r for r in wide.collect()}

    def whole(df):
        assert df.columns == wide.columns
        found = df.collect()
        assert all(r[c] == f"{c}{r['doc_id']}" for r in found for c in CLASHING)
        return found

    clean = corpus_pipeline.drop_toxic(spark, wide, SF)
    scorer = toxicity.Model({"vile": 9.0}, -6.0).scorer()
    assert sorted(r["doc_id"] for r in whole(clean)) == sorted(i for i, r in rows.items() if scorer.score(r["text"])[0] < queries.TOXIC_AT)
    having = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for i, r in rows.items():
        for x in set(map(key, r["text"].split("\n"))) - {""}:
            having.setdefault(x, set()).add(i)
    for r in whole(corpus_pipeline.drop_lines(spark, wide, SF)):
        want = "\n".join(x for x in rows[r["doc_id"]]["text"].split("\n") if len(having.get(key(x), ())) < 10)
        assert r["text"] == want and r["n_chars"] == len(want)
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(wide).collect()}
    assert sorted(r["doc_id"] for r in whole(corpus_pipeline.drop_near_copies(spark, wide, SF))) == sorted(set(groups.values()))
    labelled = queries.domain_labels(wide, spark.read.parquet(f"{SF}/labels.parquet"))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(wide, labelled).collect()}
    assert sorted(r["doc_id"] for r in whole(corpus_pipeline.mix_domains(spark, wide, SF))) == sorted(i for i, n in copies.items() for _ in range(n))
    packed = corpus_pipeline.pack(spark, wide, SF).collect()
    assert {r["doc_id"] for r in packed} == set(rows)
    none = wide.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
        assert none.count() == 0, name
