"""Connectors, segmenters, packing, the extraction cache and the seed, over small files."""

import datetime
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.sources import charts, files

FILES = {
    "overview.md": "# Overview\n\n**Author:** Ann Tan\n**Language:** pt-BR\n\nIssued: 2026-02-03\n\n## Part\nBody text here.\n| a | b |\n| 1 | 2 |\nAfter the table.\n\n**Closing:**",
    "interviews/2025-01-09-kim.md": "Just words, no heading.",
    "chat/general.md": "# general\nexport note\n**2026-01-05 09:30 — Ann**\nhello\n\nthere\n**2026-01-05 09:41 — Bob**\nhi",
    "email/one.md": "From: ann@x\nSubject: Plans\nDate: 3 March 2026\nsubject: second\n\nDear all,\n\nthe plan.",
    "code/review.md": "# Review\nAuthor: Bob Lee. More\n\nText of 2024-05-06.",
    "dashboards/q1.html": "<html><head><title>Q1</title><style>p {}</style></head><body><p class='x'>n</p><div class=\"subtitle\">as of April 2, 2026</div>"
    "<div class=\"card big\"><span class=\"label\">ARR</span><b class=\"value\">5 M</b><i class=\"delta\">+1</i></div>"
    "<div class=\"section\"><h2>Rows</h2><table><tr><th>k</th><td>v</td></tr></table></div><div class=\"note\">Mind this</div></body></html>",
    "images/board.PNG": "no",
    "images/chart-2026-03-04.png": "bytes",
    "other/skip.txt": "x",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("corpus")
    for name, body in FILES.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body, encoding="utf-8")
    return str(base)


def test_documents(spark, root):
    found = files.discover(spark, root)
    docs = {r["source_uri"]: r for r in files.documents(found).unionByName(files.images(found)).collect()}
    assert set(docs) == set(FILES) - {"images/board.PNG", "other/skip.txt"}
    day = datetime.date
    assert (docs["overview.md"]["title"], docs["overview.md"]["author"], docs["overview.md"]["lang"], docs["overview.md"]["as_of"]) == ("Overview", "Ann Tan", "pt-BR", day(2026, 2, 3))
    assert docs["interviews/2025-01-09-kim.md"]["as_of"] == day(2025, 1, 9) and docs["interviews/2025-01-09-kim.md"]["title"] == "interviews/2025-01-09-kim.md"
    mail = docs["email/one.md"]
    assert (mail["title"], mail["author"], mail["as_of"]) == ("Plans", "ann@x", day(2026, 3, 3))
    assert docs["code/review.md"]["author"] == "Bob Lee" and docs["code/review.md"]["as_of"] == day(2024, 5, 6)
    assert docs["dashboards/q1.html"]["title"] == "Q1" and docs["dashboards/q1.html"]["as_of"] == day(2026, 4, 2)
    image = docs["images/chart-2026-03-04.png"]
    assert image["raw_text"] == "[image: chart-2026-03-04]" and image["as_of"] == day(2026, 3, 4)
    told = files.images(found, F.lit(" A chart ")).first()
    assert told["raw_text"] == "A chart"
    with pytest.raises(Exception, match="more than one connector"):
        files.discover(spark, root, {**files.CONNECTORS, "again": r"^chat/"}).collect()


def test_segments_and_chunks(spark, root):
    found = files.discover(spark, root)
    cut = {r["source_uri"]: [(s["text"], s["atomic"]) for s in r["segments"]] for r in files.segments(files.documents(found)).collect()}
    assert cut["overview.md"] == [
        ("# Overview\n**Author:** Ann Tan\n**Language:** pt-BR", False), ("Issued: 2026-02-03", False), ("## Part\nBody text here.", False),
        ("| a | b |\n| 1 | 2 |", True), ("After the table.", False), ("**Closing:**", False),
    ]
    assert cut["chat/general.md"] == [("# general\nexport note", False), ("**2026-01-05 09:30 — Ann**\nhello\n\nthere", True), ("**2026-01-05 09:41 — Bob**\nhi", True)]
    assert cut["email/one.md"][0] == ("From: ann@x\nSubject: Plans\nDate: 3 March 2026\nsubject: second", True) and len(cut["email/one.md"]) == 3
    assert cut["dashboards/q1.html"] == [
        ("ARR — 5 M — +1 (as of 2026-04-02)", True), ("Rows (as of 2026-04-02)\n| k | v |", True), ("Mind this (as of 2026-04-02)", True),
    ]
    assert files.dashboard_segments("<body>All <b>of it</b></body>") == [("All of it (as of unknown)", False)]
    with pytest.raises(ValueError, match="without text"):
        files.dashboard_segments("<body></body>")
    chunks = files.pack(files.segments(files.documents(found))).where("source_uri = 'chat/general.md'").orderBy("ordinal").collect()
    assert [r["text"] for r in chunks] == ["\n\n".join(t for t, _ in cut["chat/general.md"])]


def estimate(t):
    return max(1, len(t) // 4) if t else 0


def brute_pack(segments, most, target):
    units = []
    for body, atomic in segments:
        body = body.strip("\n")
        if not body.strip():
            continue
        if atomic or estimate(body) <= most:
            units.append(body)
            continue
        import re

        for para in [p.strip() for p in re.split(r"\n\s*\n", body) if p.strip()]:
            if estimate(para) <= most:
                units.append(para)
                continue
            now = ""
            for s in re.split(r"(?<=[.!?])\s+", para):
                if now and estimate(now + " " + s) > most:
                    units.append(now)
                    now = s
                else:
                    now = now + " " + s if now else s
            units += [now] if now else []
    out, now, size = [], [], 0
    for u in units:
        if now and size + estimate(u) > most:
            out.append("\n\n".join(now))
            now, size = [], 0
        now.append(u)
        size += estimate(u)
        if size >= target:
            out.append("\n\n".join(now))
            now, size = [], 0
    return out + (["\n\n".join(now)] if now else [])


def test_packing_against_plain_python(spark):
    """Prose over the limit is cut at paragraphs, then sentences; atomic segments stay whole."""
    import random

    rng = random.Random(6)
    sentence = lambda: " ".join("word" * rng.randrange(1, 3) for _ in range(rng.randrange(1, 30))) + rng.choice([". ", "! ", "?\n"])
    rows = []
    for i in range(40):
        segs = [("".join(sentence() + ("\n\n" if rng.random() < 0.1 else "") for _ in range(rng.randrange(1, 40))), rng.random() < 0.3) for _ in range(rng.randrange(1, 6))]
        rows.append((f"d{i}", [*segs, ("  \n", False)] if i % 3 else segs))
    df = spark.createDataFrame(rows, f"source_uri string, segments {files.SEGMENT}")
    got = {}
    for r in files.pack(df, most=80, target=60).orderBy("source_uri", "ordinal").collect():
        got.setdefault(r["source_uri"], []).append(r["text"])
    assert got == {uri: brute_pack(segs, 80, 60) for uri, segs in rows}


def test_cache_of_extractions(spark, tmp_path):
    folder = str(tmp_path / "cache")
    rows = spark.createDataFrame([("a", 0), ("a", 1)], "source_uri string, ordinal int").selectExpr(
        "*", "array(named_struct('subject', 'S', 'predicate', 'p', 'object_value', '1', 'as_of', cast(null as string), 'confidence', 0.5D, 'evidence', 'e')) AS claims",
        "cast(array() as array<struct<from_entity:string,to_entity:string,link_type:string,as_of:string,confidence:double>>) AS relations",
    )
    assert files.record(rows.where("ordinal = 0"), folder, spark).count() == 1
    assert [r["ordinal"] for r in files.record(rows, folder, spark).collect()] == [1]
    assert files.record(rows, folder, spark).count() == 0
    assert files.replay(spark, folder, rows).count() == 2
    with pytest.raises(Exception, match="not cached: b#7"):
        files.replay(spark, folder, spark.createDataFrame([("b", 7)], "source_uri string, ordinal int")).collect()


CHART = """# Org
## Engineering (40 people, under Hannah Park → Priya Raman)
- **Ann Tan** — Backend Lead, Core — Singapore
  - **Bob Lee** — Engineer — São Paulo
- **Cy** - Designer
## Sales (under Zed Ng)
### LATAM, under Kim Ito
| Name | Role | Location |
|------|------|----------|
| Ivy | AE | SP |
## Executive
| Name | Role | Location | Reports to |
|---|---|---|---|
| Priya Raman | CEO | SG | Board |
| Hannah Park | CTO | SG | Priya Raman |
Dotted-line notes (A, e.g., Ann Tan ↔ Ivy; Cy ↔ Bob Lee)
"""


def plain_chart(people_by_team):
    """A chart of teams ((team, head), [(depth, name)]) and its reporting lines, by a stack."""
    body, edges = [], set()
    for (team, head), listed in people_by_team:
        body.append(f"## {team} (under {head})")
        stack = []
        for depth, name in listed:
            body.append(" " * depth + f"- **{name}** — Role — Place")
            stack = [x for x in stack if x[0] < depth]
            edges.add((name, stack[-1][1] if stack else head))
            stack.append((depth, name))
    return "\n".join(body), edges


def test_charts(spark):
    placed = charts.placed_lines(charts.chart_lines(spark.createDataFrame([("c", CHART), ("d", None)], "chart string, body string")))
    persons = charts.people(placed)
    by = {r["name"]: r for r in persons.collect()}
    assert (by["Ann Tan"]["role"], by["Ann Tan"]["location"], by["Ann Tan"]["team"]) == ("Backend Lead, Core", "Singapore", "Engineering")
    assert (by["Cy"]["role"], by["Cy"]["location"], by["Ivy"]["team"], by["Priya Raman"]["superior"]) == ("Designer", None, "Sales", "Board")
    edges = {(r["from_name"], r["to_name"]) for r in charts.authority(placed, persons).where("link_type = 'reports_to'").collect()}
    assert edges == {
        ("Hannah Park", "Priya Raman"), ("Ann Tan", "Hannah Park"), ("Bob Lee", "Ann Tan"), ("Cy", "Hannah Park"), ("Kim Ito", "Zed Ng"), ("Ivy", "Kim Ito"), ("Priya Raman", "Board"),
    }
    dotted = charts.authority(placed, persons).where("link_type = 'dotted_line_to'").collect()
    assert {(r["from_name"], r["to_name"]) for r in dotted} == {("Ann Tan", "Ivy"), ("Cy", "Bob Lee")}


def test_nested_bullets(spark):
    rng, made = random.Random(4), []
    for c in range(20):
        teams = [((f"T{c}-{t}", f"H{c}-{t}"), [(rng.choice([0, 2, 3, 4, 8]), f"P{c}-{t}-{k}") for k in range(rng.randrange(12))]) for t in range(3)]
        made.append((c, *plain_chart(teams)))
    placed = charts.placed_lines(charts.chart_lines(spark.createDataFrame([(c, body) for c, body, _ in made], "chart int, body string")))
    got = {(r["from_name"], r["to_name"]) for r in charts.authority(placed, charts.people(placed)).where("link_type = 'reports_to'").collect()}
    assert got == set().union(*[edges for _, _, edges in made])


def test_seed(spark):
    others = spark.createDataFrame([("Us", "other", "company", ["the company"])], "name string, entity_type string, kind string, aliases array<string>")
    seeded = charts.seed(spark.createDataFrame([("c", CHART, "2026-04-15")], "chart string, body string, as_of string"), others)
    names = {r["id"]: r["canonical_name"] for r in seeded["entities"].collect()}
    about = {r["canonical_name"]: r["attributes"] for r in seeded["entities"].collect()}
    assert about["Priya Raman"]["reports_to_external"] == "Board" and about["Ann Tan"]["department"] == "Engineering"
    links = seeded["links"].collect()
    assert {(names[r["from_entity_id"]], names[r["to_entity_id"]]) for r in links if r["link_type"] == "reports_to"} == {
        ("Hannah Park", "Priya Raman"), ("Ann Tan", "Hannah Park"), ("Bob Lee", "Ann Tan"), ("Cy", "Hannah Park"),
    }
    assert all((r["as_of"] is None) == (r["link_type"] != "member_of") for r in links)
    assert seeded["entity_aliases"].first()["alias"] == "the company" and seeded["metric_vocab"].count() == 15
    empty = charts.seed(spark.createDataFrame([], "chart string, body string, as_of string"))
    assert empty["links"].count() == empty["entities"].count() == 0


def test_texts_are_cut_a_few_at_once(monkeypatch):
    """A batch of many texts is handed on in parts, with the columns and rows that it had."""
    monkeypatch.setattr(files, "BYTES_AT_ONCE", 1000, raising=False)
    texts = ["a\n\n" + "b" * 400, None, "", "| t |\n\nx", "c" * 5000, "d" * 300] * 3
    batch = pa.RecordBatch.from_pydict({"source_type": ["markdown"] * 18, "as_of": pa.nulls(18, pa.date32()), "raw_text": pa.array(texts), "k": range(18)})
    parts = list(files._cut(iter([batch]), files.SEGMENTERS))
    assert len(parts) >= 6 and [k for p in parts for k in p.column("k").to_pylist()] == list(range(18))
    got = [[(x["text"], x["atomic"]) for x in cut] for p in parts for cut in p.column("segments").to_pylist()]
    assert got == [files.markdown_segments(t or "") for t in texts]
