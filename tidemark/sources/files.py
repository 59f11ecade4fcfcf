"""Connectors: files of one folder tree as documents and their segments.

Files are read by ``binaryFile``, so discovery, listing and reading are
Spark's.  A connector is a path pattern and a segmenter; every file belongs to
at most one, which is checked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.lineage import settle

# Which files a connector takes, by path below the root.
CONNECTORS = {
    "chat": r"^chat/[^/]+\.md$",
    "email": r"^email/[^/]+\.md$",
    "code": r"^code/[^/]+\.md$",
    "dashboard": r"^dashboards/[^/]+\.html$",
    "markdown": r"^(?:[^/]+|interviews/.+)\.md$",
    "image": r"^images/[^/]+\.(?:jpe?g|png)$",
}

SEGMENT = "array<struct<text:string,atomic:boolean>>"


def discover(spark: SparkSession, root: str, connectors: dict[str, str] = CONNECTORS) -> DataFrame:
    """(source_uri, source_type, content) of all files below ``root`` that a connector takes.

    Raises, when the row is evaluated, if two connectors take a file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    uri = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    takers = F.filter(F.array(*[F.when(uri.rlike(p), F.lit(n)) for n, p in connectors.items()]), lambda x: x.isNotNull())
    rows = files.select(uri.alias("source_uri"), takers.alias("_by"), "content").where(F.size("_by") > 0)
    one = F.when(F.size("_by") == 1, F.element_at("_by", 1)).otherwise(
        F.raise_error(F.concat(F.lit("more than one connector takes "), F.col("source_uri")))
    )
    return rows.select("source_uri", one.alias("source_type"), "content")


# Months by their first letters, and the labels of a document's date, the more telling ones first.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
DATE_LABELS = [r"(?:issued|as[\s-]?of|effective|dated|completed|generated|exported|published)", r"\bdate"]
WINDOW = 60


def date_in(body: Column) -> Column:
    """The first ISO date of a text, else its first ``April 15, 2026``, else its first ``15 April 2026``; days that do not exist are none."""

    def written(pattern: str, year: int, month: int, day: int) -> Column:
        part = lambda k: F.regexp_extract(body, pattern, k)
        number = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(F.lower(part(month)), 1, 3))
        padded = lambda c: F.lpad(c.cast("string"), 2, "0")
        return F.when(number > 0, F.concat_ws("-", part(year), padded(number), padded(part(day))).try_cast("date"))

    return F.coalesce(
        F.regexp_extract(body, r"\b(\d{4}-\d{2}-\d{2})\b", 1).try_cast("date"),
        written(r"\b([A-Za-z]{3,9})\s+(\d{1,2}),\s*(\d{4})\b", 3, 1, 2),
        written(r"\b(\d{1,2})\s+([A-Za-z]{3,9})\s+(\d{4})\b", 3, 2, 1),
    )


def document_date(body: Column, path: Column) -> Column:
    """The date behind a label, else the first one of the text, else that of the file's name.

    A text without a year, four digits, is not searched: it has no date of any form.
    """
    labelled = [F.regexp_extract_all(body, F.lit(rf"(?is){label}\b[\s:*\-—]*(?=(.{{0,{WINDOW}}}))"), 1) for label in DATE_LABELS]
    first = lambda windows: F.get(F.filter(F.transform(windows, date_in), lambda d: d.isNotNull()), 0)
    own = F.coalesce(*map(first, labelled), date_in(body))
    return F.coalesce(F.when(body.rlike(r"\d{4}"), own), date_in(F.substring_index(path, "/", -1)))


def _match(body: Column, pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(body, pattern, 1)), F.lit(""))


def page_title(html: Column) -> Column:
    """The title of a page, null if it has none."""
    return _match(html, r"(?is)<title>(.*?)</title>")


def texts(found: DataFrame) -> DataFrame:
    """(source_uri, source_type, raw_text, content_hash) of text files, raw_text in normal form.

    Raises, when the row is evaluated, on a file without text.
    """
    decoded = F.decode("content", "UTF-8")
    blank = F.raise_error(F.concat(F.lit("no text in "), F.col("source_uri")))
    body = F.when(text.is_blank(decoded), blank).otherwise(text.normalize_text(decoded))
    rows = found.where(F.col("source_type") != "image").select("source_uri", "source_type", body.alias("raw_text"))
    return rows.withColumn("content_hash", F.sha2("raw_text", 256))


def documents(found: DataFrame) -> DataFrame:
    """One row per text file: source_uri, source_type, title, author, lang, as_of, content_hash, raw_text.

    Raises, when the row is evaluated, on a file without text.
    """
    return described(texts(found))


def described(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """:func:`documents` of :func:`texts`, with the columns to ``keep``."""
    raw, kind = F.col("raw_text"), F.col("source_type")
    head = F.substring_index(raw, "\n\n", 1)
    header = lambda name: _match(head, rf"(?im)^{name}:\s*(.*)$")
    heading = _match(raw, r"(?m)^#\s+(.+?)\s*$")
    stamps = F.array_join(F.regexp_extract_all(raw, F.lit(r'(?s)class="[^"]*\b(?:subtitle|stamp)\b[^"]*"[^>]*>([^<]*)'), 1), "\n")
    by_kind = lambda **own: F.coalesce(*[F.when(kind == k, v) for k, v in own.items()])
    stamped = F.coalesce(document_date(stamps, F.lit("")), document_date(raw, F.col("source_uri")))
    day = F.when(kind == "dashboard", stamped).when(
        kind == "email", F.coalesce(date_in(header("Date")), document_date(raw, F.col("source_uri")))
    ).otherwise(document_date(raw, F.col("source_uri")))
    return rows.select(
        "source_uri", "source_type",
        F.coalesce(by_kind(email=header("Subject"), dashboard=page_title(raw)), heading, "source_uri").alias("title"),
        F.coalesce(
            by_kind(email=header("From"), code=_match(raw, r"Author:\s*([^.\n]+)")),
            _match(raw, r"(?m)^\s*[-*]?\s*\*\*(?:Name|Author):?\*\*\s*(.+?)\s*$"),
        ).alias("author"),
        _match(raw, r"\*\*Language:?\*\*\s*([A-Za-z-]+)").alias("lang"), day.alias("as_of"), "content_hash", "raw_text", *keep,
    )


def images(found: DataFrame, caption: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per image, with the columns of :func:`documents`: its caption as text, hashed by its bytes.

    ``caption`` is a column over source_uri and content, such as a pandas UDF; blank or without one the file's name stands for it.
    """
    stem = F.regexp_replace(F.substring_index("source_uri", "/", -1), r"\.[^.]+$", "")
    told = F.concat(F.lit("[image: "), stem, F.lit("]"))
    told = told if caption is None else F.coalesce(F.nullif(F.trim(caption), F.lit("")), told)
    none = F.lit(None).cast("string")
    return found.where(F.col("source_type") == "image").select(
        "source_uri", "source_type", stem.alias("title"), none.alias("author"), none.alias("lang"), date_in(F.substring_index("source_uri", "/", -1)).alias("as_of"),
        F.sha2("content", 256).alias("content_hash"), told.alias("raw_text"), *keep,
    )


def table_text(rows: Column) -> Column:
    """array<array<string>> as lines of cells between bars; null cells are empty, newlines in cells blanks."""
    cell = lambda c: F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" "))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))
    return F.array_join(F.transform(rows, line), "\n")


def _line_kind(line: str) -> str:
    bare = line.strip()
    if not bare:
        return "blank"
    if bare.startswith("|"):
        return "table"
    return "label" if re.match(r"#{1,6}\s", line) or re.fullmatch(r"\*\*.+\*\*", bare) else "text"


def markdown_segments(body: str, day: object = None) -> list[tuple[str, bool]]:
    """Runs of text and of table lines; headings and whole bold lines lead the run after them, tables stay whole."""
    out: list[tuple[str, bool]] = []
    lead: list[str] = []
    for kind, run in groupby(body.split("\n"), _line_kind):
        if kind == "label":
            lead += [x.strip() for x in run]
        elif kind != "blank":
            out.append(("\n".join([*lead, *run]), kind == "table"))
            lead = []
    return out + ([("\n".join(lead), False)] if lead else [])


def chat_segments(body: str, day: object = None, longest_header: int = 200) -> list[tuple[str, bool]]:
    """What stands before the first message, then each message, whole, from its ``**... HH:MM — who**`` line on."""
    out: list[list[str]] = [[]]
    for line in body.split("\n"):
        if len(line) <= longest_header and re.match(r"\*\*.*\d{1,2}:\d{2}\s+[—–-]\s+.+\*\*\s*$", line):
            out.append([])
        out[-1].append(line)
    parts = ["\n".join(x).strip("\n") for x in out]
    return [(p, k > 0) for k, p in enumerate(parts) if p.strip()]


def email_segments(body: str, day: object = None) -> list[tuple[str, bool]]:
    """The header block up to the first blank line, whole, then the rest as in :func:`markdown_segments`."""
    head, _, rest = body.partition("\n\n")
    return [*([(head, True)] if head.strip() else []), *markdown_segments(rest)]


class _Element(list):
    """A page element: its texts and elements in order."""

    def __init__(self, tag: str, classes: tuple[str, ...]):
        super().__init__()
        self.tag, self.classes = tag, classes

    def text(self) -> str:
        parts = [x.text() if isinstance(x, _Element) else " ".join(x.split()) for x in self]
        return " ".join(p for p in parts if p)

    def pieces(self) -> list[str]:
        """The texts below, one by one."""
        return [p for x in self for p in (x.pieces() if isinstance(x, _Element) else [" ".join(x.split())]) if p]

    def all(self, *names: str) -> Iterator["_Element"]:
        """Elements below with one of these classes or tags."""
        for x in self:
            if isinstance(x, _Element):
                if x.tag in names or any(f".{c}" in names for c in x.classes):
                    yield x
                yield from x.all(*names)

    def first_text(self, name: str) -> str:
        return next((x.text() for x in self.all(name)), "")


class _Page(HTMLParser):
    """Builds the elements of a page; what is not closed ends with its parent."""

    EMPTY = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr")

    def __init__(self) -> None:
        super().__init__()
        self.root = _Element("", ())
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        element = _Element(tag, tuple((dict(attrs).get("class") or "").split()))
        self.open[-1].append(element)
        if tag not in self.EMPTY:
            self.open.append(element)

    def handle_endtag(self, tag: str) -> None:
        at = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag == tag), 0)
        if at:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag not in ("script", "style"):
            self.open[-1].append(data)


def dashboard_segments(body: str, day: object = None) -> list[tuple[str, bool]]:
    """Cards (label, value and change, or else all their texts, joined by dashes), sections (heading, then table rows or text), banners and notes, each with the page's date.

    Without any of these the whole text; raises on a page without text.
    """
    page = _Page()
    page.feed(body)
    mark = f"(as of {day})" if day is not None and day == day else "(as of unknown)"
    out = []
    for card in page.root.all(".card"):
        told = " — ".join([x for x in (card.first_text(c) for c in (".label", ".value", ".delta")) if x] or card.pieces())
        out += [(f"{told} {mark}", True)] if told else []
    for section in page.root.all(".section"):
        table = next(section.all("table"), None)
        rows = [[cell.text() for cell in row.all("th", "td")] for row in table.all("tr")] if table is not None else []
        told = "\n".join("| " + " | ".join(r) + " |" for r in rows) if table is not None else section.text()
        out.append((f"{section.first_text('h2')} {mark}\n{told}".strip(), True))
    out += [(f"{x.text()} {mark}", True) for x in page.root.all(".banner", ".note") if x.text()]
    if not out:
        whole = next((x.text() for x in page.root.all("body")), page.root.text())
        if not whole:
            raise ValueError("a page without text")
        out.append((f"{whole} {mark}", False))
    return out


SEGMENTERS = {
    "markdown": markdown_segments,
    "code": markdown_segments,
    "chat": chat_segments,
    "email": email_segments,
    "dashboard": dashboard_segments,
    "image": lambda body, day=None: [(body, True)],
}


#: Bytes of texts that a Python task cuts, or reads, at once; a longer text is taken by itself.
BYTES_AT_ONCE = 4 << 20


def segments(docs: DataFrame, segmenters: dict = SEGMENTERS) -> DataFrame:
    """``docs`` (source_uri, source_type, as_of, raw_text) with ``segments``, an array of (text, atomic), per whole document.

    A source of another type needs a path pattern in :func:`discover` and a function of text and date here.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", segments {SEGMENT}"
    return docs.mapInArrow(lambda batches: _cut(batches, segmenters), schema)


def _cut(batches: Iterator[pa.RecordBatch], segmenters: dict) -> Iterator[pa.RecordBatch]:
    """Batches with ``segments``, of few texts each, so that Python holds the pieces of these alone."""
    kind = pa.list_(pa.struct([("text", pa.string()), ("atomic", pa.bool_())]))
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("raw_text")), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // BYTES_AT_ONCE
        firsts = np.flatnonzero(np.diff(group, prepend=-1))
        for first, last in zip(firsts, [*firsts[1:], len(batch)]):
            rows = batch.slice(first, last - first)
            read = zip(*(rows.column(c).to_pylist() for c in ("source_type", "raw_text", "as_of")))
            cut = [[{"text": t, "atomic": a} for t, a in segmenters[k](body or "", day)] for k, body, day in read]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cut, kind)], [*rows.schema.names, "segments"])


def prose_pieces(body: Column, most: int) -> Column:
    """array<string>: paragraphs of a text, those of over ``most`` tokens cut between sentences; a longer sentence stays whole."""

    def step(a: Column, s: Column) -> Column:
        more = a["size"] + 1 + F.char_length(s)
        full = (a["size"] > 0) & (F.greatest(F.lit(1), F.floor(more / 4)) > most)
        anew = full | (a["size"] == 0)
        return F.struct(
            F.when(full, F.array_append(a["done"], F.array_join(a["now"], " "))).otherwise(a["done"]).alias("done"),
            F.when(anew, F.array(s)).otherwise(F.array_append(a["now"], s)).alias("now"), F.when(anew, F.char_length(s)).otherwise(more).alias("size"),
        )

    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), none.alias("now"), F.lit(0).alias("size"))
    last = lambda a: F.when(a["size"] > 0, F.array_append(a["done"], F.array_join(a["now"], " "))).otherwise(a["done"])
    cut = lambda p: F.aggregate(F.split(p, r"(?<=[.!?])\s+"), start, step, last)
    paragraphs = F.filter(F.transform(F.split(body, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    pieces = F.flatten(F.transform(paragraphs, lambda p: F.when(text.token_estimate(p) > most, cut(p)).otherwise(F.array(p))))
    return text.once(pieces, lambda ps: F.when(F.size(ps) > 0, ps).otherwise(F.array(body)))


def pack(docs: DataFrame, most: int = 800, target: int = 650, keep: tuple[str, ...] = ("source_uri",)) -> DataFrame:
    """source_uri (or the columns to ``keep``), ordinal, text: segments joined by blank lines into chunks.

    A chunk is closed once it has ``target`` tokens or the next piece would
    take it over ``most``.  Atomic segments are never cut, other ones of over
    ``most`` tokens are by :func:`prose_pieces`; blank ones are left out.
    """

    def step(acc: Column, s: Column) -> Column:
        size = text.token_estimate(s)
        closed = (F.size(acc["now"]) > 0) & ((acc["size"] >= target) | (acc["size"] + size > most))
        now = F.when(closed, F.array(s)).otherwise(F.array_append(acc["now"], s))
        done = F.when(closed, F.array_append(acc["done"], F.array_join(acc["now"], "\n\n"))).otherwise(acc["done"])
        return F.struct(done.alias("done"), now.alias("now"), F.when(closed, size).otherwise(acc["size"] + size).alias("size"))

    bare = lambda s: F.btrim(s["text"], F.lit("\n"))
    long = lambda s: ~s["atomic"] & (text.token_estimate(bare(s)) > most)
    told = F.filter("segments", lambda s: ~text.is_blank(s["text"]))
    units = F.flatten(F.transform(told, lambda s: F.when(long(s), prose_pieces(bare(s), most)).otherwise(F.array(bare(s)))))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), none.alias("now"), F.lit(0).alias("size"))
    chunks = F.aggregate(
        units, start, step,
        lambda a: F.when(F.size(a["now"]) > 0, F.array_append(a["done"], F.array_join(a["now"], "\n\n"))).otherwise(a["done"]),
    )
    return docs.select(*keep, F.posexplode(chunks).alias("ordinal", "text"))


def record(extracted: DataFrame, folder: str, spark: SparkSession) -> DataFrame:
    """Appends extractions (source_uri, ordinal, claims, relations) that the cache in ``folder`` lacks, and returns them.

    The cache is JSON, one line for each chunk, as :func:`replay` reads it.  A
    job that is lost leaves what it appended; :class:`tidemark.caches.Cache`
    takes all or nothing and can record anew.
    """
    try:
        there = spark.read.schema("source_uri string, ordinal int").json(folder)
        fresh = extracted.join(there, ["source_uri", "ordinal"], "left_anti")
    except AnalysisException:  # no folder yet
        fresh = extracted
    fresh = settle(fresh)
    fresh.write.mode("append").json(folder)
    return fresh


def replay(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """Cached extractions (source_uri, ordinal, claims, relations) of all ``wanted`` chunks; raises on a missing one."""
    claim = "struct<subject:string,predicate:string,object_value:string,as_of:string,confidence:double,evidence:string>"
    relation = "struct<from_entity:string,to_entity:string,link_type:string,as_of:string,confidence:double>"
    cached = spark.read.schema(f"source_uri string, ordinal int, claims array<{claim}>, relations array<{relation}>").json(folder)
    rows = wanted.select("source_uri", "ordinal").join(cached.withColumn("_hit", F.lit(True)), ["source_uri", "ordinal"], "left")
    missing = F.raise_error(F.concat(F.lit("not cached: "), "source_uri", F.lit("#"), F.col("ordinal").cast("string")))
    return rows.where(F.when(F.col("_hit"), True).otherwise(missing.cast("boolean"))).drop("_hit")
