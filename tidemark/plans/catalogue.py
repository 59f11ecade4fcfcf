"""The registered queries over the standard tables, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import audit, citations, contradictions, extraction, graph, overlap, resolve, retrieval, store, temporal

from . import views

DAY = "1998-06-30"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _pair(extra: str = "", link: str = "a.as_of IS NULL OR b.as_of IS NULL OR a.as_of = b.as_of") -> str:
    return f"""
SELECT a.subject_entity_id, a.predicate, a.id AS claim_a_id, b.id AS claim_b_id,
  CASE WHEN a.document_id <> b.document_id AND (a.as_of IS NULL OR b.as_of IS NULL OR a.as_of = b.as_of) THEN 'source_disagreement'
    WHEN a.as_of IS NOT NULL AND b.as_of IS NOT NULL AND a.as_of <> b.as_of THEN 'temporal' ELSE 'value_conflict' END AS kind
FROM claims a JOIN claims b ON a.subject_entity_id = b.subject_entity_id AND a.predicate = b.predicate AND a.id < b.id
WHERE a.object_value <> b.object_value AND ({link}) {extra}"""


@query(f"WITH {views.CLAIMS} {_pair()}")
def contradictions_claims(spark: SparkSession, d: str) -> DataFrame:
    return contradictions.detect(views.claims(spark, d))


WINDOWS = "a.as_of IS NULL OR b.as_of IS NULL OR (a.as_of <= b.as_of + 30 AND b.as_of <= a.as_of + 30)"


@query(f"WITH {views.CLAIMS} {_pair(link=WINDOWS)}")
def contradictions_windowed(spark: SparkSession, d: str) -> DataFrame:
    """Claims that hold for thirty days."""
    own = views.claims(spark, d).withColumn("valid_from", F.col("as_of")).withColumn("valid_to", F.date_add("as_of", 30))
    return contradictions.detect(own)


@query(f"WITH {views.CLAIMS} {_pair(link=f'a.predicate = $$1-URGENT$$ OR {WINDOWS}')}")
def contradictions_targets(spark: SparkSession, d: str) -> DataFrame:
    """One predicate conflicts whatever its period."""
    own = views.claims(spark, d).withColumn("valid_from", F.col("as_of")).withColumn("valid_to", F.date_add("as_of", 30))
    return contradictions.detect(own, targets=["1-URGENT"])


@query(f"WITH {views.CLAIMS} {_pair(extra='AND a.predicate NOT IN ($$1-URGENT$$, $$5-LOW$$)')}")
def contradictions_set_valued(spark: SparkSession, d: str) -> DataFrame:
    return contradictions.detect(views.claims(spark, d), set_valued=["1-URGENT", "5-LOW"])


@query(f"""WITH {views.CLAIMS}, p AS ({_pair(link='true')}),
k AS (SELECT p.*, row_number() OVER (PARTITION BY p.subject_entity_id, p.predicate, least(a.object_value, b.object_value),
  greatest(a.object_value, b.object_value) ORDER BY claim_a_id, claim_b_id) AS rn
  FROM p JOIN claims a ON a.id = claim_a_id JOIN claims b ON b.id = claim_b_id)
SELECT subject_entity_id, predicate, claim_a_id, claim_b_id, kind FROM k WHERE rn = 1""")
def contradictions_dedup(spark: SparkSession, d: str) -> DataFrame:
    own = views.claims(spark, d)
    open_ended = own.withColumn("valid_from", F.lit("0001-01-01").cast("date")).withColumn("valid_to", F.lit("9999-12-31").cast("date"))
    return contradictions.first_of_each_conflict(open_ended)


@query(f"""WITH {views.CLAIMS}, p AS ({_pair(link="a.as_of IS NULL OR b.as_of IS NULL OR (a.as_of <= b.as_of + CAST(b.id % 90 AS INTEGER) AND b.as_of <= a.as_of + CAST(a.id % 90 AS INTEGER))")}),
k AS (SELECT p.*, row_number() OVER (PARTITION BY p.subject_entity_id, p.predicate, least(a.object_value, b.object_value),
  greatest(a.object_value, b.object_value) ORDER BY claim_a_id, claim_b_id) AS rn
  FROM p JOIN claims a ON a.id = claim_a_id JOIN claims b ON b.id = claim_b_id)
SELECT subject_entity_id, predicate, claim_a_id, claim_b_id, kind FROM k WHERE rn = 1""")
def first_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """The first conflict of each pair of values among claims that hold for up to ninety days."""
    own = views.claims(spark, d).withColumn("valid_from", F.col("as_of")).withColumn("valid_to", F.date_add("as_of", (F.col("id") % 90).cast("int")))
    return contradictions.first_of_each_conflict(own)


@query(f"""WITH {views.LINKS}
SELECT a.from_entity_id AS subject_entity_id, a.link_type AS predicate, a.id AS link_a_id, b.id AS link_b_id,
  CASE WHEN a.document_id <> b.document_id AND (a.as_of IS NULL OR b.as_of IS NULL OR a.as_of = b.as_of) THEN 'source_disagreement'
    WHEN a.as_of IS NOT NULL AND b.as_of IS NOT NULL AND a.as_of <> b.as_of THEN 'temporal' ELSE 'value_conflict' END AS kind
FROM links a JOIN links b ON a.from_entity_id = b.from_entity_id AND a.link_type = b.link_type AND a.id < b.id
WHERE a.to_entity_id <> b.to_entity_id AND (a.as_of IS NULL OR b.valid_to IS NULL OR a.as_of <= b.valid_to)
  AND (b.as_of IS NULL OR a.valid_to IS NULL OR b.as_of <= a.valid_to)""")
def contradictions_links(spark: SparkSession, d: str) -> DataFrame:
    return contradictions.detect_links(views.links(spark, d))


@query(f"""WITH {views.CLAIMS}
SELECT id, subject_entity_id, predicate, as_of, row_number() OVER (PARTITION BY subject_entity_id
  ORDER BY coalesce(as_of, DATE '0001-01-01'), id) AS position FROM claims""")
def timeline(spark: SparkSession, d: str) -> DataFrame:
    return temporal.timeline(views.claims(spark, d)).select("id", "subject_entity_id", "predicate", "as_of", F.col("position").cast("long"))


@query(f"""WITH {views.CLAIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY subject_entity_id, predicate
  ORDER BY as_of DESC NULLS LAST, id) AS rn FROM claims)
SELECT id, subject_entity_id, predicate, object_value, as_of FROM r WHERE rn = 1""")
def freshest_per_predicate(spark: SparkSession, d: str) -> DataFrame:
    return temporal.freshest_per_predicate(views.claims(spark, d)).select("id", "subject_entity_id", "predicate", "object_value", "as_of")


@query(f"""WITH {views.CLAIMS}, n AS (
  SELECT a.id, min(b.as_of) AS day, arg_min(b.id, (b.as_of, b.id)) AS by_id
  FROM claims a JOIN claims b ON a.subject_entity_id = b.subject_entity_id AND a.predicate = b.predicate
    AND a.document_id = b.document_id AND a.as_of < b.as_of AND a.object_value <> b.object_value GROUP BY a.id)
SELECT c.id, n.by_id AS superseded_by, n.day AS valid_to FROM claims c LEFT JOIN n ON c.id = n.id""")
def supersession(spark: SparkSession, d: str) -> DataFrame:
    return temporal.supersede(views.claims(spark, d)).select("id", "superseded_by", "valid_to")


@query(f"""WITH {views.CLAIMS} SELECT predicate, min(as_of) AS earliest, max(as_of) AS latest,
  coalesce(max(as_of) < DATE '2001-08-01', false) AS stale FROM claims GROUP BY predicate""")
def as_of_coverage(spark: SparkSession, d: str) -> DataFrame:
    return temporal.coverage(views.claims(spark, d), "2001-08-01")


@query(f"""WITH {views.LINKS} SELECT id, from_entity_id, to_entity_id FROM links
WHERE (as_of IS NULL OR as_of <= DATE '2024-06-30') AND (valid_to IS NULL OR valid_to > DATE '2024-06-30')""")
def as_of_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return temporal.snapshot(views.links(spark, d), "2024-06-30").select("id", "from_entity_id", "to_entity_id")


@query(f"""WITH {views.CLAIMS}, s AS (
  SELECT predicate, object_value AS v, count(*) AS n, max(as_of) AS freshest, min(id) AS least_id FROM claims GROUP BY 1, 2)
SELECT predicate, n, freshest, least_id,
  row_number() OVER (PARTITION BY predicate ORDER BY n DESC, coalesce(freshest, DATE '0001-01-01') DESC, least_id) AS rank FROM s
QUALIFY sum(n) OVER (PARTITION BY predicate) >= 2""")
def consensus_rollup(spark: SparkSession, d: str) -> DataFrame:
    return temporal.consensus(views.claims(spark, d)).select("predicate", "n", "freshest", "least_id", F.col("rank").cast("long"))


@query(f"""WITH RECURSIVE {views.LINKS},
e AS (SELECT DISTINCT from_entity_id AS child, to_entity_id AS parent FROM links),
walk AS (
  SELECT CAST(min(parent) AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent, 0 AS depth, '/' || min(parent) || '/' AS path
  FROM e WHERE parent NOT IN (SELECT child FROM e)
  UNION ALL
  SELECT e.child, w.id, w.depth + 1, w.path || e.child || '/' FROM walk w JOIN e ON e.parent = w.id
  WHERE position('/' || e.child || '/' IN w.path) = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth, path) AS rn FROM walk WHERE id IS NOT NULL)
SELECT id, parent, depth, path FROM f WHERE rn = 1""")
def org_subtree(spark: SparkSession, d: str) -> DataFrame:
    return graph.subtree(graph.reporting_edges(views.links(spark, d)))


@query(f"""WITH {views.LINKS}, e AS (SELECT DISTINCT from_entity_id AS child, to_entity_id AS parent FROM links)
SELECT DISTINCT parent AS root FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.child = e.parent)""")
def org_root(spark: SparkSession, d: str) -> DataFrame:
    return graph.roots(graph.reporting_edges(views.links(spark, d)))


@query(f"""WITH {views.LINKS} SELECT id, link_type, CASE WHEN from_entity_id = 3 THEN 'outgoing' ELSE 'incoming' END AS direction,
  CASE WHEN from_entity_id = 3 THEN to_entity_id ELSE from_entity_id END AS other_id
FROM links WHERE from_entity_id = 3 OR to_entity_id = 3""")
def relationships_both_directions(spark: SparkSession, d: str) -> DataFrame:
    return graph.relationships(views.links(spark, d), 3).select("id", "link_type", "direction", "other_id")


def _chunk_ids() -> Column:
    return F.when(F.col("source_chunk_id").isNotNull(), F.col("source_chunk_id") * 100000)


SNIPPET = "CASE WHEN length(c.text) > 200 THEN substring(c.text, 1, 200) || '…' ELSE c.text END"


def _cite_sql(facts: str, kind: str, where: str) -> str:
    return f"""
SELECT f.id AS {kind}_id, c.id AS chunk_id, d.id AS doc_id, d.source_uri, coalesce(f.as_of, d.as_of) AS as_of, {SNIPPET} AS snippet
FROM {facts} f LEFT JOIN chunks c ON f.source_chunk_id * 100000 = c.id
LEFT JOIN docs d ON coalesce(f.document_id, c.document_id) = d.id WHERE {where}"""


@query(f"WITH {views.CLAIMS}, {views.DOCUMENTS}, {views.CHUNKS} {_cite_sql('claims', 'claim', 'c.id IS NOT NULL OR d.id IS NOT NULL')}")
def citations_claims(spark: SparkSession, d: str) -> DataFrame:
    own = views.claims(spark, d).withColumn("source_chunk_id", _chunk_ids())
    return citations.of_claims(own, views.chunks(spark, d), views.documents(spark, d))


@query(f"WITH {views.LINKS}, {views.DOCUMENTS}, {views.CHUNKS} {_cite_sql('links', 'link', 'd.id IS NOT NULL')}")
def citations_links(spark: SparkSession, d: str) -> DataFrame:
    own = views.links(spark, d).withColumn("source_chunk_id", _chunk_ids())
    return citations.of_links(own, views.chunks(spark, d), views.documents(spark, d))


@query(f"""WITH {views.DOCUMENTS}, {views.CHUNKS}
SELECT c.id AS chunk_id, d.id AS doc_id, d.source_uri, d.as_of, {SNIPPET} AS snippet FROM chunks c JOIN docs d ON c.document_id = d.id""")
def citations_chunks(spark: SparkSession, d: str) -> DataFrame:
    return citations.of_chunks(views.chunks(spark, d), views.documents(spark, d))


def _census(spark: SparkSession, d: str) -> DataFrame:
    own = views.claims(spark, d).withColumns({"char_start": F.lit(None).cast("int"), "char_end": F.lit(None).cast("int"), "source_chunk_id": F.col("source_chunk_id") * 100000})
    people = views.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("canonical_name"))
    return audit.census(own, views.chunks(spark, d), views.documents(spark, d), people)


CENSUS = f"""{views.CLAIMS}, {views.CHUNKS}, census AS (
  SELECT f.*, c.text AS chunk_text, c.id IS NOT NULL AS chunk_found, d.doc_id IS NOT NULL AS document_found
  FROM claims f LEFT JOIN chunks c ON f.source_chunk_id * 100000 = c.id LEFT JOIN documents d ON f.document_id = d.doc_id)"""


@query(f"""WITH {CENSUS} SELECT id, predicate, chunk_found, document_found, length(chunk_text) AS chunk_chars, c_name AS subject_name
FROM census LEFT JOIN customer ON subject_entity_id = c_custkey""")
def claim_census(spark: SparkSession, d: str) -> DataFrame:
    return _census(spark, d).select("id", "predicate", "chunk_found", "document_found", F.char_length("chunk_text").cast("long").alias("chunk_chars"), "subject_name")


@query(f"""WITH {CENSUS}, v AS (
  SELECT id, 'no_source_chunk' AS category, 'warning' AS severity FROM census WHERE source_chunk_id IS NULL
  UNION ALL SELECT id, 'dangling_chunk_ref', 'error' FROM census WHERE source_chunk_id IS NOT NULL AND NOT chunk_found
  UNION ALL SELECT id, 'no_document_source', 'error' FROM census WHERE NOT document_found
  UNION ALL SELECT id, 'confidence_out_of_range', 'error' FROM census WHERE confidence NOT BETWEEN 0 AND 1
  UNION ALL SELECT id, 'missing_as_of', 'warning' FROM census WHERE as_of IS NULL
  UNION ALL SELECT id, 'no_evidence', 'warning' FROM census WHERE source_chunk_id IS NOT NULL AND evidence IS NULL
  UNION ALL SELECT id, 'evidence_not_in_chunk', 'error' FROM census
    WHERE evidence IS NOT NULL AND chunk_text IS NOT NULL AND NOT contains(lower(chunk_text), lower(evidence)))
SELECT id, category, severity FROM v""")
def audit_violations(spark: SparkSession, d: str) -> DataFrame:
    return audit.violations(_census(spark, d))


@query(f"""WITH {CENSUS} SELECT id FROM census WHERE confidence < 0.5 OR as_of IS NULL
  OR (source_chunk_id IS NOT NULL AND evidence IS NULL)
  OR (evidence IS NOT NULL AND chunk_text IS NOT NULL AND NOT contains(lower(chunk_text), lower(evidence)))""")
def audit_suspicious(spark: SparkSession, d: str) -> DataFrame:
    return _census(spark, d).where(audit.suspicious()).select("id")


@query(f"""WITH {views.CLAIMS}, r AS (SELECT id, predicate, row_number() OVER (PARTITION BY predicate
  ORDER BY (id * 2654435761) % 4294967296, id) AS rn FROM claims)
SELECT id, predicate FROM r ORDER BY rn, predicate LIMIT 25""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return audit.stratified_sample(views.claims(spark, d), "predicate", "id", 25).select("id", "predicate")


def _entities(spark: SparkSession, d: str) -> DataFrame:
    c = views.read(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("Party "), F.floor(F.col("c_custkey") / 2).cast("string")).alias("canonical_name"),
        F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("attributes"), (F.col("c_custkey") % 10 == 0).alias("seeded"),
    )


@query("""WITH e AS (SELECT c_custkey AS id, lower('Party ' || CAST(c_custkey // 2 AS VARCHAR)) AS name, c_mktsegment AS seg, c_custkey % 10 = 0 AS seeded FROM customer),
m AS (SELECT o_orderkey AS mention_id, lower('PARTY ' || CAST(o_custkey // 2 AS VARCHAR)) AS name,
  ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][CAST(o_orderkey % 5 AS INTEGER) + 1] AS seg FROM orders),
c AS (SELECT mention_id, e.id, seeded, lower(e.seg) = lower(m.seg) AS fits, max(seeded::INT) OVER w AS any_seeded FROM m JOIN e USING (name)
  WINDOW w AS (PARTITION BY mention_id)),
s AS (SELECT *, count(*) OVER (PARTITION BY mention_id) AS n FROM c WHERE any_seeded = 0 OR seeded),
o AS (SELECT mention_id, CASE WHEN max(n) = 1 THEN min(id) WHEN count(*) FILTER (WHERE fits) = 1 THEN min(id) FILTER (WHERE fits) END AS entity_id
  FROM s GROUP BY mention_id)
SELECT m.mention_id, o.entity_id FROM m LEFT JOIN o USING (mention_id)""")
def resolve_entity(spark: SparkSession, d: str) -> DataFrame:
    segments = F.array(*map(F.lit, ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]))
    o = views.read(spark, d, "orders")
    mentions = o.select(
        F.col("o_orderkey").alias("mention_id"), F.concat(F.lit("PARTY "), F.floor(F.col("o_custkey") / 2).cast("string")).alias("name"),
        F.create_map(F.lit("segment"), F.get(segments, (F.col("o_orderkey") % 5).cast("int"))).alias("context"),
    )
    aliases = spark.createDataFrame([], "entity_id bigint, alias string")
    return resolve.resolve(mentions, _entities(spark, d), aliases)


def _probe(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in views.read(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


VECTOR = """v AS (SELECT vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS score
  FROM embeddings ORDER BY score DESC, id LIMIT {k})"""
LEXICAL = """t AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM documents),
l AS (SELECT id, len(list_filter(w, lambda x: x IN ('the', 'of'))) / (1.0 + ln(len(w))) AS score FROM t
  WHERE list_contains(w, 'the') AND list_contains(w, 'of') ORDER BY score DESC, id LIMIT {k})"""


@query(f"WITH {VECTOR.format(k=10)} SELECT id, round(score, 6) AS score FROM v")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.vector_topk(views.read(spark, d, "embeddings"), _probe(spark, d), 10, "vec_id")
    return found.select("id", F.round("score", 6).alias("score"))


@query(f"WITH {LEXICAL.format(k=10)} SELECT id, round(score, 6) AS score FROM l")
def lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.lexical_topk(views.read(spark, d, "documents"), "the of", 10, "doc_id")
    return found.select("id", F.round("score", 6).alias("score"))


FUSED = """r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS k FROM v UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) FROM l),
f AS (SELECT id, sum(CAST(1 AS DOUBLE) / (60 + k)) AS score FROM r GROUP BY id ORDER BY score DESC, id LIMIT 8)
SELECT id, round(score, 9) AS score FROM f"""


@query(f"WITH {VECTOR.format(k=8)}, {LEXICAL.format(k=8)}, {FUSED}")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    a = retrieval.vector_topk(views.read(spark, d, "embeddings"), _probe(spark, d), 8, "vec_id")
    b = retrieval.lexical_topk(views.read(spark, d, "documents"), "the of", 8, "doc_id")
    return retrieval.fuse([a, b], 8).select("id", F.round("score", 9).alias("score"))


#: Texts as they are hashed: newlines alike, no blanks at line ends, no blank lines at either end.
NORMALIZED = (
    "regexp_replace(array_to_string(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), "
    "lambda x: rtrim(x, ' ' || chr(9) || chr(11) || chr(12))), chr(10)), '^\\n+|\\n+$', '', 'g')"
)


@query(f"SELECT sha256({NORMALIZED}) AS content_hash, min(doc_id) AS id, count(*) AS n FROM documents GROUP BY 1")
def content_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    own = views.read(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))
    return own.groupBy("content_hash").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))


@query("SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS INTEGER) AS tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return views.read(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query(f"WITH {views.CHUNKS} SELECT id, document_id, ordinal, sha256(text) AS text_hash FROM chunks")
def chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    return views.chunks(spark, d).select("id", "document_id", F.col("ordinal").cast("long"), F.sha2("text", 256).alias("text_hash"))


@query("""SELECT page_id, coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, length(html) AS n FROM pages""")
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    p = views.read(spark, d, "pages")
    return p.select("page_id", F.coalesce(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).alias("title"), F.char_length("html").cast("long").alias("n"))


@query("""SELECT conv_id, count(*) AS messages, string_agg(role, '>' ORDER BY turn) AS roles, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id""")
def chat_messages(spark: SparkSession, d: str) -> DataFrame:
    c = views.read(spark, d, "conversations")
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda t: t["role"])
    return c.groupBy("conv_id").agg(F.count("*").alias("messages"), F.array_join(turns, ">").alias("roles"), F.sum(F.char_length("text")).alias("chars"))


@query("""WITH r AS (SELECT event_type, CASE WHEN value IS NULL THEN 'empty' WHEN value < 10 THEN 'small' ELSE 'kept' END AS reason FROM events)
SELECT coalesce(event_type, '(all)') AS source, count(*) AS n, count(*) FILTER (WHERE reason = 'small') AS small,
  count(*) FILTER (WHERE reason = 'kept') AS kept FROM r GROUP BY ROLLUP (event_type)""")
def loss_ledger(spark: SparkSession, d: str) -> DataFrame:
    e = views.read(spark, d, "events")
    reason = F.when(F.col("value").isNull(), "empty").when(F.col("value") < 10, "small").otherwise("kept")
    own = e.select("event_type", reason.alias("reason"))
    return own.rollup("event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("reason") == "small").alias("small"), F.count_if(F.col("reason") == "kept").alias("kept")
    ).select(F.coalesce("event_type", F.lit("(all)")).alias("source"), "n", "small", "kept")


@query("""SELECT lang, count(*) AS n, sum(quality)::BIGINT AS hits, round(sum(quality) / count(*), 9) AS recall,
  round(greatest(0, (sum(quality) / count(*) + 3.8416 / (2 * count(*)) - 1.96 * sqrt(sum(quality) / count(*) * (1 - sum(quality) / count(*)) / count(*)
    + 3.8416 / (4 * count(*) * count(*)))) / (1 + 3.8416 / count(*))), 9) AS low
FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def wilson_recall(spark: SparkSession, d: str) -> DataFrame:
    own = views.read(spark, d, "labels").join(views.read(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    g = own.groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("hits"))
    low, _ = audit.wilson(F.col("hits"), F.col("n"))
    return g.select("lang", "n", "hits", F.round(F.col("hits") / F.col("n"), 9).alias("recall"), F.round(low, 9).alias("low"))


@query("""SELECT label, count(*) AS n, count(*) FILTER (WHERE embedding IS NOT NULL AND len(embedding) = 64) AS good FROM embeddings GROUP BY label""")
def embedding_audit(spark: SparkSession, d: str) -> DataFrame:
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    good = F.col("embedding").isNotNull() & (F.size("embedding") == 64) & (norm > 0)
    return views.read(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count_if(good).alias("good"))


@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS t FROM documents),
b AS (SELECT DISTINCT item_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS t FROM benchmark),
n AS (SELECT item_id, count(*) AS n FROM b WHERE t <> '' GROUP BY 1),
o AS (SELECT doc_id, item_id, count(*) AS c FROM w JOIN b USING (t) WHERE t <> '' GROUP BY 1, 2)
SELECT doc_id, item_id, round(c / n, 6) AS overlap FROM o JOIN n USING (item_id) WHERE c / n >= 0.6""")
def grounding_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items of which a document has three fifths of the distinct words."""
    found = overlap.containment(views.read(spark, d, "documents"), views.read(spark, d, "benchmark"))
    return found.select("doc_id", "item_id", F.round("overlap", 6).alias("overlap"))


@query("""SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS n, position('the' IN text) - 1 AS first_at FROM documents""")
def evidence_location(spark: SparkSession, d: str) -> DataFrame:
    """How often and where a span stands in each document."""
    own = views.read(spark, d, "documents")
    return own.select("doc_id", text.occurrences(F.col("text"), F.lit("the")).cast("long").alias("n"), (F.instr("text", "the") - 1).cast("long").alias("first_at"))


@query("""WITH w AS (SELECT item_id, regexp_extract_all(text, '([A-Za-z][A-Za-z''&-]+)', 1) AS w FROM benchmark),
p AS (SELECT item_id, w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] AS t FROM w)
SELECT item_id, least(len(list_distinct(t)), 40) AS n FROM p""")
def candidate_terms(spark: SparkSession, d: str) -> DataFrame:
    return views.read(spark, d, "benchmark").select("item_id", F.size(text.candidate_terms(F.col("text"))).cast("long").alias("n"))


@query(f"""WITH {views.CLAIMS} SELECT subject_entity_id, sha256(string_agg(predicate || '=' || object_value, '|' ORDER BY id)) AS cluster_key
FROM claims GROUP BY 1""")
def cluster_key(spark: SparkSession, d: str) -> DataFrame:
    own = views.claims(spark, d)
    rows = F.transform(F.sort_array(F.collect_list(F.struct("id", F.concat_ws("=", "predicate", "object_value").alias("s")))), lambda x: x["s"])
    return own.groupBy("subject_entity_id").agg(F.sha2(F.array_join(rows, "|"), 256).alias("cluster_key"))


@query(f"""WITH {views.CLAIMS}, v AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'Q' || (1 + id % 4) || ' ' || year(as_of)
  WHEN id % 3 = 0 THEN CAST(year(as_of) AS VARCHAR) ELSE strftime(as_of, '%Y-%m-%d') END AS t, as_of FROM claims)
SELECT id, CASE WHEN as_of IS NULL THEN NULL WHEN id % 2 = 0 THEN CASE WHEN year(as_of) >= 2000 THEN CAST(year(as_of) || ['-03-31', '-06-30', '-09-30', '-12-31'][CAST(id % 4 AS INTEGER) + 1] AS DATE) END
  WHEN id % 3 = 0 THEN CAST(year(as_of) || '-12-31' AS DATE) ELSE as_of END AS day FROM v""")
def as_of_coerce(spark: SparkSession, d: str) -> DataFrame:
    """Dates written as quarters, which years before 2000 are not read with, as years and as ISO dates."""
    own = views.claims(spark, d)
    year = F.year("as_of").cast("string")
    written = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Q"), (1 + F.col("id") % 4).cast("string"), F.lit(" "), year)).when(
        F.col("id") % 3 == 0, year
    ).otherwise(F.col("as_of").cast("string"))
    return own.select("id", text.coerce_as_of(written).alias("day"))


@query(f"""WITH {views.CLAIMS} SELECT id, CAST(object_value AS DOUBLE) * CASE WHEN id % 2 = 0 THEN 1000 ELSE 1 END AS number FROM claims""")
def value_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Values with currencies, hedges and scales, read as numbers."""
    own = views.claims(spark, d)
    v = F.col("object_value")
    written = F.when(F.col("id") % 2 == 0, F.concat(F.lit("approx USD "), v, F.lit(" thousand"))).otherwise(
        F.concat(F.lit("~$"), F.regexp_replace(v, r"(?<=\d)(?=(?:\d{3})+$)", ","))
    )
    return own.select("id", text.value_number(text.value_text(written)).alias("number"))


@query(f"""WITH {views.CLAIMS} SELECT subject_entity_id, predicate, object_value, min(id) AS id FROM claims GROUP BY 1, 2, 3""")
def upsert_claims(spark: SparkSession, d: str) -> DataFrame:
    """The first claim of each natural key."""
    key = [F.col(c) for c in ("subject_entity_id", "predicate", "object_value")]
    return extraction.merge_passes(views.claims(spark, d), key, ["id"]).select("subject_entity_id", "predicate", "object_value", "id")


@query(f"""WITH {views.CLAIMS} SELECT 'claims' AS name, count(*) AS n FROM claims UNION ALL SELECT 'documents', count(*) FROM documents
UNION ALL SELECT 'entities', count(*) FROM customer UNION ALL SELECT 'links', count(*) FROM (WITH {views.LINKS} SELECT * FROM links)""")
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    tables = {"claims": views.claims(spark, d), "documents": views.documents(spark, d), "entities": views.read(spark, d, "customer"), "links": views.links(spark, d)}
    return store.table_counts(tables)


@query(f"""WITH {views.CLAIMS} SELECT id, lower(predicate) AS predicate FROM claims
WHERE regexp_replace(lower('Q1 2026 ' || predicate), '^((q[1-4]|h[12]|fy|20[0-9][0-9])[ /-]+)+', '') IN ('1-urgent', '2-high')""")
def claims_by_predicate(spark: SparkSession, d: str) -> DataFrame:
    """Predicates compared without their leading periods."""
    own = views.claims(spark, d).withColumn("_p", F.concat(F.lit("Q1 2026 "), "predicate"))
    return own.where(text.strip_period(F.col("_p")).isin("1-urgent", "2-high")).select("id", F.lower("predicate").alias("predicate"))
