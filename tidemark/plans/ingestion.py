"""Registered queries of dates, tables and chunks, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.commits import Store
from tidemark.functions import text
from tidemark.lineage import settle, shared_folder
from tidemark.operators import extraction
from tidemark.sources import charts, connectors, files

from . import views
from .catalogue import NORMALIZED, query


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN DATE '2025-03-01' + CAST(doc_id % 28 AS INTEGER) WHEN 1 THEN DATE '2024-04-05' WHEN 2 THEN DATE '2026-04-22'
  WHEN 3 THEN DATE '2025-05-07' WHEN 4 THEN DATE '2021-05-03' END AS day FROM documents""")
def document_dates(spark: SparkSession, d: str) -> DataFrame:
    """Days behind a label, in words either way round, in the file's name, after an impossible one, and none."""
    doc, k = views.read(spark, d, "documents"), F.col("doc_id") % 6
    stamp = F.date_add(F.lit("2025-03-01").cast("date"), (F.col("doc_id") % 28).cast("int")).cast("string")
    body = (
        F.when(k == 0, F.concat(F.lit("Report of 2020-01-02. Generated: **"), stamp, F.lit("** by us")))
        .when(k == 1, "We met on April 5, 2024 and left.").when(k == 2, "Sent 22 Apr 2026, fine.")
        .when(k == 4, "Date - 2026-13-45, that is 3 May 2021").otherwise("no day at all")
    )
    path = F.when(k == 3, "notes/2025-05-07.md").otherwise("notes/plain.md")
    return doc.select("doc_id", files.document_date(F.concat(F.lit("x\n"), body), path).alias("day"))


@query("""SELECT n_regionkey AS region, string_agg('| ' || trim(n_name) || ' |  | ' || replace(n_name, 'A', ' ') || ' |', chr(10) ORDER BY n_nationkey) AS body
FROM nation GROUP BY 1""")
def table_texts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of cells, some of them null or with newlines, as lines."""
    n = views.read(spark, d, "nation")
    cells = F.array(F.concat(F.lit(" "), "n_name"), F.lit(None).cast("string"), F.regexp_replace("n_name", "A", "\n"))
    rows = n.groupBy(F.col("n_regionkey").alias("region")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", cells.alias("c")))), lambda x: x["c"]).alias("rows"))
    return rows.select("region", files.table_text(F.col("rows")).alias("body"))


@query("""SELECT page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title FROM pages""")
def stripped_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles as pages are filed by."""
    return views.read(spark, d, "pages").select("page_id", files.page_title(F.col("html")).alias("title"))


@query()
def packed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """All documents cut and packed into chunks; how pieces fall depends on those before, which SQL does not say."""
    doc = views.read(spark, d, "documents")
    own = doc.select(F.concat(F.lit("md/"), F.col("doc_id").cast("string")).alias("source_uri"), F.lit("markdown").alias("source_type"), F.lit(None).cast("date").alias("as_of"), text.normalize_text(F.coalesce("text", F.lit(""))).alias("raw_text"))
    return files.pack(files.segments(own)).select("source_uri", F.col("ordinal").cast("long"), F.sha2("text", 256).alias("text_hash"))


@query("""SELECT doc_id, regexp_replace(source || '/' || lang || ' #' || doc_id, '[^A-Za-z0-9._-]', '_', 'g') AS slug FROM documents""")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    doc = views.read(spark, d, "documents")
    return doc.select("doc_id", text.slug(F.concat("source", F.lit("/"), "lang", F.lit(" #"), F.col("doc_id").cast("string"))).alias("slug"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN ':rev' WHEN 2 THEN 'margin' WHEN 3 THEN 'q1x' ELSE lower(o_orderpriority) END AS stripped FROM orders""")
def loose_periods(spark: SparkSession, d: str) -> DataFrame:
    """Predicates that are a period, have one before a colon, or two before a word, and some without."""
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, " Q1").when(k == 1, "q1:rev").when(k == 2, "FY 2026 - margin").when(k == 3, "Q1x").otherwise(F.col("o_orderpriority"))
    return views.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.strip_period_loosely(raw).alias("stripped"))


@query(f"""WITH {views.CLAIMS}, {views.DOCUMENTS} SELECT c.id, coalesce(c.as_of, d.as_of) AS as_of FROM claims c LEFT JOIN docs d ON c.document_id = d.id WHERE subject_entity_id % 10 > 0""")
def assembled_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims dated by their document if undated; every tenth subject is not resolved."""
    days = views.documents(spark, d).select(F.col("id").alias("_d"), F.col("as_of").alias("document_as_of"))
    own = views.claims(spark, d).join(days, F.col("document_id") == F.col("_d"), "left")
    unresolved = own.withColumn("subject_entity_id", F.when(F.col("subject_entity_id") % 10 > 0, F.col("subject_entity_id")))
    return extraction.assemble_claims(unresolved).select("id", "as_of")


@query(f"""WITH {views.LINKS}, {views.DOCUMENTS} SELECT l.id, coalesce(l.as_of, d.as_of) AS as_of FROM links l LEFT JOIN docs d ON l.document_id = d.id WHERE from_entity_id <> to_entity_id""")
def assembled_links(spark: SparkSession, d: str) -> DataFrame:
    days = views.documents(spark, d).select(F.col("id").alias("_d"), F.col("as_of").alias("document_as_of"))
    own = views.links(spark, d).join(days, F.col("document_id") == F.col("_d"), "left")
    return extraction.assemble_links(own).select("id", "as_of")


def charts_of_nations(spark: SparkSession, d: str) -> DataFrame:
    """A chart for each nation: its suppliers as nested bullets under a head, or as a table where the nation's number is odd."""
    s, n = views.read(spark, d, "supplier"), views.read(spark, d, "nation")
    k, depth = F.col("s_suppkey"), (F.col("s_suppkey") * 7 % 5 * 2).cast("int")
    bullet = F.concat(F.repeat(F.lit(" "), depth), F.lit("- **"), "s_name", F.lit("** — Grade "), (k % 4).cast("string"), F.lit(" — Place "), (k % 3).cast("string"))
    row = F.concat(F.lit("| "), "s_name", F.lit(" | Grade "), (k % 4).cast("string"), F.lit(" | Place "), (k % 3).cast("string"), F.lit(" |"))
    told = F.when(F.col("s_nationkey") % 2 == 0, bullet).otherwise(row)
    listed = s.groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), told.alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    lead = F.when(F.col("s_nationkey") % 2 == 1, F.lit("\n| Name | Role | Location |\n|---|---|---|")).otherwise(F.lit(""))
    title = F.concat(F.lit("## "), "n_name", F.lit(" (under Head "), "n_name", F.lit(" → Chair)"), lead, F.lit("\n"))
    return listed.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_nationkey").alias("chart"), F.concat(title, "body").alias("body"))


@query("""WITH s AS (SELECT s_suppkey AS k, s_name, s_nationkey AS chart, n_name, s_suppkey * 7 % 5 * 2 AS depth FROM supplier JOIN nation ON n_nationkey = s_nationkey),
p AS (SELECT a.k, arg_max(b.s_name, b.k) AS parent FROM s a JOIN s b ON a.chart = b.chart AND b.k < a.k AND b.depth < a.depth WHERE a.chart % 2 = 0 GROUP BY a.k)
SELECT chart, s_name AS from_name, coalesce(parent, 'Head ' || n_name) AS to_name, 'reports_to' AS link_type FROM s LEFT JOIN p USING (k)
UNION ALL SELECT chart, s_name, n_name, 'member_of' FROM s
UNION ALL SELECT DISTINCT chart, 'Head ' || n_name, 'Chair', 'reports_to' FROM s""")
def chart_edges(spark: SparkSession, d: str) -> DataFrame:
    """Lines of authority and memberships out of many charts."""
    placed = charts.placed_lines(charts.chart_lines(charts_of_nations(spark, d)))
    return charts.authority(placed, charts.people(placed))


@query("""WITH s AS (SELECT s_name, s_nationkey, s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey),
e AS (SELECT s_name AS canonical_name, 'person' AS entity_type, 'Grade ' || s_suppkey % 4 AS role, 'Place ' || s_suppkey % 3 AS location FROM s
  UNION ALL SELECT DISTINCT n_name, 'team', NULL, NULL FROM s)
SELECT row_number() OVER (ORDER BY canonical_name, entity_type) AS id, * FROM e""")
def seeded_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities out of many charts, numbered."""
    made = charts.seed(charts_of_nations(spark, d).withColumn("as_of", F.lit("2026-04-15")))["entities"]
    return made.select("id", "canonical_name", "entity_type", F.col("attributes")["role"].alias("role"), F.col("attributes")["location"].alias("location"))


@query(f"""WITH {views.CLAIMS}, n AS (SELECT *, row_number() OVER (PARTITION BY subject_entity_id, predicate, object_value, source_chunk_id ORDER BY id % 2, id) AS rn FROM claims),
f AS (SELECT *, row_number() OVER (ORDER BY id % 2, id) AS new_id FROM n WHERE rn = 1)
SELECT new_id AS id, subject_entity_id, predicate, object_value, source_chunk_id FROM f""")
def committed_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims written to a store in two runs, the second of which repeats the first, and read back."""
    own = views.claims(spark, d).withColumn("arrived", F.col("id")).drop("id")
    first = own.where("arrived % 2 = 0")
    keys = ["subject_entity_id", "predicate", "object_value", "source_chunk_id"]
    store = Store(spark, shared_folder(spark, "store"))
    store.insert("claims", first, ["arrived"], ("orders", 0))
    store.insert("claims", first, ["arrived"], ("orders", 0))
    store.insert("claims", own, ["arrived"], ("orders", 1))
    return store.read("claims").select("id", *keys)


CORPUS = connectors.Connector("corpus", r"^corpus/part-[^/]+\.json$", read=connectors.json_lines("doc_id", "text"))
TOLD = "regexp_matches(coalesce(text, ''), '[^\\s]')"


def corpus_files(spark: SparkSession, d: str) -> DataFrame:
    """All documents written as files of many documents each and read back through their connector; blank ones are no documents."""
    root = shared_folder(spark, "corpus")
    told = views.read(spark, d, "documents").where(~text.is_blank(F.coalesce("text", F.lit(""))))
    told.select("doc_id", "text").write.json(f"{root}/corpus")
    connectors.register(spark, [*connectors.STANDARD, CORPUS])
    return spark.read.format(connectors.FORMAT).option("connectors", CORPUS.source_type).load(root)


@query(f"SELECT doc_id, 'corpus' AS source_type, sha256({NORMALIZED}) AS content_hash FROM documents WHERE {TOLD}")
def connected_documents(spark: SparkSession, d: str) -> DataFrame:
    own = files.documents(corpus_files(spark, d))
    return own.select(F.substring_index("source_uri", "#", -1).cast("bigint").alias("doc_id"), "source_type", "content_hash")


def ingested(spark: SparkSession, d: str) -> tuple[Store, list[DataFrame]]:
    """A store after three runs, with the report of each: documents of even id, the same once more, all."""
    found = settle(corpus_files(spark, d).withColumn("source_uri", F.concat(F.lit("corpus/"), F.substring_index("source_uri", "#", -1))))
    even = found.where(F.substring_index("source_uri", "/", -1).cast("bigint") % 2 == 0)
    store = Store(spark, shared_folder(spark, "store"))
    return store, [connectors.ingest(store, rows, [CORPUS], ("corpus", k)) for k, rows in enumerate((even, even, found))]


RUNS = f"""t AS (SELECT doc_id, 'corpus/' || doc_id AS source_uri, sha256({NORMALIZED}) AS content_hash FROM documents WHERE {TOLD}),
f AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id % 2, source_uri) AS k FROM t)"""


@query(f"WITH {RUNS} SELECT row_number() OVER (ORDER BY doc_id % 2, source_uri) AS id, source_uri, content_hash FROM f WHERE k = 1")
def ingested_documents(spark: SparkSession, d: str) -> DataFrame:
    """What the store holds after repeated runs: each content once, numbered by run and address."""
    return ingested(spark, d)[0].read("documents").select("id", "source_uri", "content_hash")


@query(f"""WITH {RUNS}, e AS (SELECT count_if(doc_id % 2 = 0) AS evens, count(*) AS every, count_if(k = 1 AND doc_id % 2 = 0) AS new_evens, count_if(k = 1) AS news FROM f)
SELECT run, figure, CAST(n AS BIGINT) AS n FROM (SELECT 0 AS run, 'documents_added' AS figure, new_evens AS n FROM e UNION ALL SELECT 0, 'documents_known', evens - new_evens FROM e
UNION ALL SELECT 1, 'documents_added', 0 FROM e UNION ALL SELECT 1, 'documents_known', evens FROM e
UNION ALL SELECT 2, 'documents_added', news - new_evens FROM e UNION ALL SELECT 2, 'documents_known', every - news + new_evens FROM e)""")
def ingest_runs(spark: SparkSession, d: str) -> DataFrame:
    """What each run counted, but for its chunks, whose borders SQL does not know."""
    out = None
    for k, report in enumerate(ingested(spark, d)[1]):
        own = report.where("figure <> 'chunks_added'").select(F.lit(k).alias("run"), "figure", "n")
        out = own if out is None else out.unionByName(own)
    return out
