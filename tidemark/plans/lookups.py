"""Registered queries of lookups, writes, sweeps, audits and grading, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.caches import Cache, fingerprint, stale
from tidemark.functions import text
from tidemark.lineage import shared_folder
from tidemark.operators import audit, contradictions, evaluation, graph, ledger, resolve, store, upsert

from . import views
from .answers import CLAIMS, CONFLICTS, claims, conflicts, no_aliases
from .catalogue import CENSUS, _census, _pair, query


def _vocab(spark: SparkSession, d: str) -> DataFrame:
    """Priorities as metrics: the key is the word, the alias the whole."""
    p = views.read(spark, d, "orders").select("o_orderpriority").distinct()
    return p.select(F.lower(F.substring("o_orderpriority", 3, 99)).alias("canonical_key"), F.col("o_orderpriority").alias("display_name"), F.array("o_orderpriority").alias("aliases"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    own = views.documents(spark, d)
    kind = F.when(F.col("id") % 3 == 0, "email").otherwise("markdown")
    return own.withColumns({"source_type": kind, "title": F.concat(F.lit("Text "), F.col("id").cast("string")), "content_hash": text.content_hash(F.col("raw_text"))})


@query(f"""WITH {views.DOCUMENTS} SELECT id, source_uri, CASE WHEN id % 3 = 0 THEN 'email' ELSE 'markdown' END AS source_type, 'Text ' || id AS title, lang,
  strftime(as_of, '%Y-%m-%d') AS as_of FROM docs""")
def document_list(spark: SparkSession, d: str) -> DataFrame:
    return store.document_list(_documents(spark, d))


_LINES = "list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: rtrim(x, ' ' || chr(9) || chr(11) || chr(12)))"


@query(f"""SELECT DISTINCT sha256(regexp_replace(array_to_string({_LINES}, chr(10)), '^\\n+|\\n+$', '', 'g')) AS content_hash FROM documents WHERE text IS NOT NULL""")
def known_hashes(spark: SparkSession, d: str) -> DataFrame:
    return store.known_hashes(_documents(spark, d))


def _entities(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers; a few customers share a name."""
    c = views.read(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("Party "), F.floor(F.col("c_custkey") / 2).cast("string")).alias("canonical_name"),
        F.when(F.col("c_custkey") % 4 == 0, "customer").when(F.col("c_custkey") % 4 == 1, "other").otherwise("person").alias("entity_type"),
        F.create_map(F.lit("role"), F.col("c_mktsegment")).alias("attributes"), (F.col("c_custkey") % 10 == 0).alias("seeded"),
    )
    return c


ENTITIES = """e AS (SELECT c_custkey AS id, 'Party ' || CAST(c_custkey // 2 AS VARCHAR) AS canonical_name,
  CASE c_custkey % 4 WHEN 0 THEN 'customer' WHEN 1 THEN 'other' ELSE 'person' END AS entity_type, c_mktsegment AS role, c_custkey % 10 = 0 AS seeded FROM customer)"""


@query(f"WITH {ENTITIES} SELECT id, canonical_name, entity_type, seeded FROM e WHERE entity_type = 'person'")
def entity_list(spark: SparkSession, d: str) -> DataFrame:
    return store.entity_list(_entities(spark, d), "person")


@query("SELECT DISTINCT lower(substring(o_orderpriority, 3)) AS canonical_key, o_orderpriority AS display_name, o_orderpriority AS aliases FROM orders")
def metric_list(spark: SparkSession, d: str) -> DataFrame:
    return store.metric_list(_vocab(spark, d)).withColumn("aliases", F.array_join("aliases", ","))


@query(f"WITH {views.CLAIMS} SELECT id, predicate, object_value, as_of FROM claims WHERE subject_entity_id = 7")
def claims_of_subject(spark: SparkSession, d: str) -> DataFrame:
    return store.claims_of(views.claims(spark, d), 7).select("id", "predicate", "object_value", "as_of")


@query(f"WITH {views.LINKS} SELECT id, to_entity_id FROM links WHERE link_type = 'reports_to' AND from_entity_id = 4")
def links_from(spark: SparkSession, d: str) -> DataFrame:
    return store.links_where(views.links(spark, d), "reports_to", 4).select("id", "to_entity_id")


@query(f"WITH {CLAIMS}, {CONFLICTS} SELECT id, predicate, kind FROM conflicts WHERE subject_entity_id IN (SELECT min(subject_entity_id) FROM conflicts)")
def contradictions_of_subject(spark: SparkSession, d: str) -> DataFrame:
    """Those on the least subject that has any."""
    rows = conflicts(spark, d)
    least = rows.agg(F.min("subject_entity_id").alias("s")).first()["s"]
    return store.contradictions_of(rows, least).select("id", "predicate", "kind")


@query(f"WITH {views.CHUNKS} SELECT id, document_id, text FROM chunks WHERE id = 100000")
def chunk_by_id(spark: SparkSession, d: str) -> DataFrame:
    return store.chunk(views.chunks(spark, d), 100000).select("id", "document_id", "text")


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey AS s, CASE o_orderkey % 3 WHEN 0 THEN 'Q1 2026 ' || o_orderpriority WHEN 1 THEN lower(substring(o_orderpriority, 3)) ELSE o_orderpriority END AS predicate,
  substring(o_orderpriority, 3) AS word FROM orders)
SELECT id, s AS subject_entity_id, predicate FROM r WHERE word = 'HIGH'""")
def claims_by_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Claims that mean a metric by its key, its alias, or either after a period."""
    k, p = F.col("id") % 3, F.col("predicate")
    own = views.claims(spark, d).withColumn("predicate", F.when(k == 0, F.concat(F.lit("Q1 2026 "), p)).when(k == 1, F.lower(F.substring(p, 3, 99))).otherwise(p))
    return store.by_canonical_predicate(own, _vocab(spark, d), "High").select("id", "subject_entity_id", "predicate")


@query(f"""WITH {views.CLAIMS}, {views.LINKS}, {views.CHUNKS}, p AS ({_pair()})
SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'chunks', count(*) FROM chunks UNION ALL SELECT 'entities', count(*) FROM customer
UNION ALL SELECT 'entity_aliases', count(*) FROM nation UNION ALL SELECT 'metric_vocab', count(DISTINCT o_orderpriority) FROM orders
UNION ALL SELECT 'claims', count(*) FROM claims UNION ALL SELECT 'links', count(*) FROM links UNION ALL SELECT 'contradictions', count(*) FROM p""")
def store_counts(spark: SparkSession, d: str) -> DataFrame:
    """All eight tables; nations stand for aliases."""
    return store.table_counts(
        {
            "documents": _documents(spark, d), "chunks": views.chunks(spark, d), "entities": _entities(spark, d), "entity_aliases": views.read(spark, d, "nation"),
            "metric_vocab": _vocab(spark, d), "claims": views.claims(spark, d), "links": views.links(spark, d), "contradictions": conflicts(spark, d),
        }
    )


@query(f"WITH {views.LINKS} SELECT DISTINCT from_entity_id, link_type FROM links")
def link_groups(spark: SparkSession, d: str) -> DataFrame:
    return contradictions.link_groups(views.links(spark, d))


@query("""SELECT o_orderkey AS id, ['set_valued', 'breakdown', 'functional', 'unknown'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS class FROM orders""")
def predicate_classes(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ["attendee", "refunds", "ga_target", "anything"]))
    o = views.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.get(names, (F.col("o_orderkey") % 4).cast("int")).alias("p"))
    return o.select("id", contradictions.cardinality(F.col("p")).alias("class"))


SWEPT = f"""{views.CLAIMS}, {views.LINKS}, p AS ({_pair(extra="AND a.predicate <> '5-LOW'")}),
cw AS (SELECT p.*, row_number() OVER (PARTITION BY p.subject_entity_id, p.predicate, least(a.object_value, b.object_value), greatest(a.object_value, b.object_value)
  ORDER BY claim_a_id, claim_b_id) AS rn FROM p JOIN claims a ON a.id = claim_a_id JOIN claims b ON b.id = claim_b_id),
lp AS (SELECT a.from_entity_id AS subject_entity_id, a.link_type AS predicate, a.id AS link_a_id, b.id AS link_b_id, least(a.to_entity_id, b.to_entity_id) AS x, greatest(a.to_entity_id, b.to_entity_id) AS y,
  CASE WHEN a.document_id <> b.document_id AND (a.as_of IS NULL OR b.as_of IS NULL OR a.as_of = b.as_of) THEN 'source_disagreement'
    WHEN a.as_of IS NOT NULL AND b.as_of IS NOT NULL AND a.as_of <> b.as_of THEN 'temporal' ELSE 'value_conflict' END AS kind
  FROM links a JOIN links b ON a.from_entity_id = b.from_entity_id AND a.link_type = b.link_type AND a.id < b.id
  WHERE a.to_entity_id <> b.to_entity_id AND (a.as_of IS NULL OR b.valid_to IS NULL OR a.as_of <= b.valid_to) AND (b.as_of IS NULL OR a.valid_to IS NULL OR b.as_of <= a.valid_to)),
lw AS (SELECT *, row_number() OVER (PARTITION BY subject_entity_id, predicate, x, y ORDER BY link_a_id, link_b_id) AS rn FROM lp),
swept AS (SELECT subject_entity_id, predicate, claim_a_id, claim_b_id, CAST(NULL AS BIGINT) AS link_a_id, CAST(NULL AS BIGINT) AS link_b_id, kind FROM cw WHERE rn = 1
  UNION ALL SELECT subject_entity_id, predicate, NULL, NULL, link_a_id, link_b_id, kind FROM lw WHERE rn = 1)"""


@query(f"WITH {SWEPT} SELECT * FROM swept")
def contradiction_sweep(spark: SparkSession, d: str) -> DataFrame:
    """All contradictions anew; one predicate has several true values."""
    return contradictions.sweep(views.claims(spark, d), views.links(spark, d), ["5-LOW"])


@query(f"""WITH {SWEPT}, g AS (SELECT DISTINCT subject_entity_id, predicate FROM claims)
SELECT 'cleared' AS figure, (SELECT count(*) FROM ({_pair()})) AS n UNION ALL SELECT 'claim_groups', count(*) FROM g WHERE predicate <> '5-LOW'
UNION ALL SELECT 'set_valued_groups', count(*) FROM g WHERE predicate = '5-LOW' UNION ALL SELECT 'link_groups', count(*) FROM (SELECT DISTINCT from_entity_id, link_type FROM links)
UNION ALL SELECT 'claim_pairs', count(*) FROM p UNION ALL SELECT 'claims_written', count(*) FROM cw WHERE rn = 1
UNION ALL SELECT 'link_pairs', count(*) FROM lp UNION ALL SELECT 'links_written', count(*) FROM lw WHERE rn = 1""")
def sweep_counts(spark: SparkSession, d: str) -> DataFrame:
    return contradictions.sweep_counts(views.claims(spark, d), views.links(spark, d), conflicts(spark, d), ["5-LOW"])


@query(f"""WITH {SWEPT}, own AS (SELECT subject_entity_id FROM claims GROUP BY 1 HAVING count(*) BETWEEN 2 AND 40),
v AS (SELECT subject_entity_id FROM own WHERE subject_entity_id % 3 <> 0 AND subject_entity_id NOT IN (SELECT from_entity_id FROM links))
SELECT subject_entity_id, predicate, claim_a_id, claim_b_id, link_a_id, link_b_id, kind, 'floor' AS source FROM swept WHERE subject_entity_id NOT IN (SELECT subject_entity_id FROM v)
UNION ALL SELECT subject_entity_id, 'ruled', subject_entity_id, subject_entity_id + 1, NULL, NULL, 'temporal', 'verdict' FROM v WHERE subject_entity_id % 3 = 1""")
def adjudicated_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on two of three subjects without links, one of each two empty, in place of what the sweep found."""
    own, links = views.claims(spark, d), views.links(spark, d)
    clustered = contradictions.clusters(own, links, set_valued=[])
    s = F.col("subject_entity_id")
    none = F.lit(None).cast("bigint")
    row = F.struct(F.lit("ruled").alias("predicate"), s.alias("claim_a_id"), (s + 1).alias("claim_b_id"), none.alias("link_a_id"), none.alias("link_b_id"), F.lit("temporal").alias("kind"))
    rows = F.filter(F.array(row), lambda _: s % 3 == 1)
    without = clustered.join(links.select(F.col("from_entity_id").alias("subject_entity_id")).distinct(), "subject_entity_id", "left_anti")
    verdicts = Cache(spark, shared_folder(spark, "verdicts"), "verdicts")
    verdicts.put(without.where((s % 3 != 0) & F.col("cluster_key").isNotNull()).select("cluster_key", rows.alias("rows")))
    return contradictions.adjudicated(contradictions.sweep(own, links, ["5-LOW"]), clustered, verdicts.read())


CLAIM_KEY = "subject_entity_id, predicate, object_value, source_chunk_id"


@query(f"""WITH {views.CLAIMS}, t AS (SELECT * FROM claims WHERE id % 2 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY {CLAIM_KEY} ORDER BY id) AS rn FROM (SELECT * REPLACE (id + 1 AS id) FROM t UNION ALL SELECT * FROM claims WHERE id % 2 = 1)),
f AS (SELECT * FROM n WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM t WHERE t.subject_entity_id IS NOT DISTINCT FROM n.subject_entity_id AND t.predicate IS NOT DISTINCT FROM n.predicate
  AND t.object_value IS NOT DISTINCT FROM n.object_value AND t.source_chunk_id IS NOT DISTINCT FROM n.source_chunk_id))
SELECT (SELECT max(id) FROM t) + row_number() OVER (ORDER BY id) AS id, subject_entity_id, predicate, object_value, source_chunk_id FROM f""")
def insert_claims(spark: SparkSession, d: str) -> DataFrame:
    """Half of the claims are there; the other half arrives, and the first half again."""
    own = views.claims(spark, d).select("id", *upsert.KEYS["claims"])
    target = own.where("id % 2 = 0")
    again = target.withColumn("arrived", F.col("id") + 1)
    rows = again.unionByName(own.where("id % 2 = 1").withColumn("arrived", F.col("id"))).drop("id")
    return upsert.insert_new(target, rows, upsert.KEYS["claims"], ["arrived"])


@query(f"""WITH {CLAIMS}, {CONFLICTS}, s AS (SELECT least(claim_a_id, claim_b_id) AS claim_a_id, greatest(claim_a_id, claim_b_id) AS claim_b_id, id FROM conflicts)
SELECT (SELECT max(id) FROM conflicts WHERE id % 2 = 0) + row_number() OVER (ORDER BY id) AS id, claim_a_id, claim_b_id FROM s WHERE id % 2 = 1""")
def insert_contradictions(spark: SparkSession, d: str) -> DataFrame:
    """Pairs arrive with their sides turned, twice; those with even ids are there."""
    own = conflicts(spark, d).select("id", "claim_a_id", "claim_b_id", "link_a_id", "link_b_id")
    turned = own.select(F.col("id").alias("arrived"), F.col("claim_b_id").alias("claim_a_id"), F.col("claim_a_id").alias("claim_b_id"), "link_a_id", "link_b_id")
    twice = turned.unionByName(turned.withColumn("arrived", F.col("arrived") + 10**13))
    return upsert.insert_contradictions(own.where("id % 2 = 0"), twice, ["arrived"]).select("id", "claim_a_id", "claim_b_id")


@query("""WITH o AS (SELECT c_custkey AS id, 'Party ' || c_custkey AS n, c_mktsegment AS seg, false AS seeded FROM customer WHERE c_custkey % 2 = 0),
r AS (SELECT 'Party ' || c_custkey AS n, 'new' AS seg, c_custkey % 3 = 0 AS seeded FROM customer WHERE c_custkey % 4 <> 2),
j AS (SELECT o.id, coalesce(o.n, r.n) AS canonical_name, coalesce(r.seg, o.seg) AS seg, o.seg IS NOT NULL AS kept, coalesce(o.seeded, false) OR coalesce(r.seeded, false) AS seeded FROM o FULL JOIN r ON o.n = r.n)
SELECT coalesce(id, (SELECT max(id) FROM o) + row_number() OVER (PARTITION BY id IS NULL ORDER BY canonical_name)) AS id, canonical_name, seg, kept, seeded FROM j""")
def merge_entities(spark: SparkSession, d: str) -> DataFrame:
    """Attributes of arrivals win, older ones stay; new names get ids in order."""
    c = views.read(spark, d, "customer")
    name, kind = F.concat(F.lit("Party "), F.col("c_custkey").cast("string")).alias("canonical_name"), F.lit("customer").alias("entity_type")
    old = F.create_map(F.lit("seg"), F.col("c_mktsegment"), F.lit("kept"), F.lit("yes")).alias("attributes")
    target = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), name, kind, old, F.lit(False).alias("seeded"))
    rows = c.where("c_custkey % 4 <> 2").select(name, kind, F.create_map(F.lit("seg"), F.lit("new")).alias("attributes"), (F.col("c_custkey") % 3 == 0).alias("seeded"))
    made = upsert.merge_entities(target, rows)
    return made.select("id", "canonical_name", F.try_element_at("attributes", F.lit("seg")).alias("seg"), F.try_element_at("attributes", F.lit("kept")).isNotNull().alias("kept"), "seeded")


@query("""WITH l AS (SELECT o_orderpriority AS p, max(o_orderkey) AS k FROM orders GROUP BY 1)
SELECT lower(substring(p, 3)) AS canonical_key, CASE WHEN p LIKE '5%' THEN p ELSE 'Shown ' || k END AS display_name FROM l""")
def upsert_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The last order of each priority but one gives its metric a new name."""
    o = views.read(spark, d, "orders").where("o_orderpriority NOT LIKE '5%'")
    rows = o.select(
        F.lower(F.substring("o_orderpriority", 3, 99)).alias("canonical_key"), F.concat(F.lit("Shown "), F.col("o_orderkey").cast("string")).alias("display_name"),
        F.array("o_orderpriority").alias("aliases"), F.col("o_orderkey").alias("arrived"),
    )
    return store.upsert_metrics(_vocab(spark, d), rows, "arrived").select("canonical_key", "display_name")


@query(f"""WITH {views.DOCUMENTS}, m AS (SELECT DISTINCT source_uri FROM docs WHERE id % 5 = 0)
SELECT id, source_uri FROM docs WHERE source_uri IN (SELECT source_uri FROM m)""")
def source_subset(spark: SparkSession, d: str) -> DataFrame:
    docs = views.documents(spark, d)
    return store.from_sources(docs, docs.where("id % 5 = 0")).select("id", "source_uri")


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN lang || ',' || source ELSE source END AS sources FROM documents WHERE lang IN ('de', 'en', 'es', 'fr')""")
def trimmed_sources(spark: SparkSession, d: str) -> DataFrame:
    """Corroborating sources that a manifest lists: the language, where the id is even, and the source."""
    own = views.read(spark, d, "documents").where("lang IN ('de', 'en', 'es', 'fr')")
    first = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("unlisted")
    rows = own.select(F.col("doc_id").alias("id"), F.array(first, F.lit("nowhere"), F.col("source")).alias("sources"))
    manifest = own.select(F.explode(F.array("lang", "source")).alias("source_uri"))
    return store.trimmed_sources(rows, manifest).select("id", F.array_join("sources", ",").alias("sources"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders""")
def wire_days(spark: SparkSession, d: str) -> DataFrame:
    """Days as the wire gives them: blank or ISO."""
    k = F.col("o_orderkey")
    given = F.when(k % 3 == 1, F.col("o_orderdate").cast("date").cast("string")).when(k % 3 == 2, F.concat(F.lit(" "), F.col("o_orderdate").cast("date").cast("string"))).when(k % 2 == 0, F.lit(" "))
    return views.read(spark, d, "orders").select(k.alias("id"), store.parse_day(given).alias("day"))


@query("""SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '","none":null}' AS json FROM region""")
def wire_rows(spark: SparkSession, d: str) -> DataFrame:
    own = views.read(spark, d, "region").select(F.col("r_regionkey"), "r_name", F.lit(None).cast("string").alias("none"))
    return store.as_json(own)


@query("SELECT vec_id, label FROM embeddings WHERE embedding IS NOT NULL")
def checked_vectors(spark: SparkSession, d: str) -> DataFrame:
    own = views.read(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    return store.checked_vectors(own, 64).where("embedding IS NOT NULL").select(F.col("id").alias("vec_id"), "label")


MENTIONS = """m AS (SELECT o_orderkey AS mention_id, CASE o_orderkey % 6 WHEN 0 THEN 'PARTY ' || o_custkey // 2 WHEN 1 THEN 'Dr. Party ' || o_custkey // 2
  WHEN 2 THEN 'New Firm ' || o_custkey WHEN 3 THEN ' ' WHEN 4 THEN 'new firm ' || o_custkey ELSE 'Mr.' END AS name,
  ['customer', 'other', 'person', 'metric'][CAST(o_orderkey // 6 % 4 AS INTEGER) + 1] AS entity_type, o_orderkey % 5 > 0 AS allow_snap FROM orders)"""


@query(f"""WITH {ENTITIES}, {MENTIONS},
f AS (SELECT *, trim(name) AS n, trim(regexp_replace(name, '^(Dr|Mr)\\.\\s*', '')) AS fold FROM m),
t AS (SELECT mention_id, f.n = 'x' AS x, count(*) AS c, count(*) FILTER (WHERE seeded) AS s, min(id) AS id, min(id) FILTER (WHERE seeded) AS sid
  FROM f JOIN e ON lower(canonical_name) = lower(fold) AND e.entity_type = f.entity_type WHERE fold <> '' GROUP BY ALL),
a AS (SELECT mention_id, count(*) AS c, count(*) FILTER (WHERE seeded) AS s, min(id) AS id, min(id) FILTER (WHERE seeded) AS sid
  FROM f JOIN e ON lower(canonical_name) = lower(fold) WHERE fold <> '' GROUP BY 1),
r AS (SELECT f.*, CASE WHEN t.c = 1 THEN t.id WHEN t.s = 1 THEN t.sid END AS known, CASE WHEN a.c = 1 THEN a.id WHEN a.s = 1 THEN a.sid END AS any_id FROM f LEFT JOIN t USING (mention_id) LEFT JOIN a USING (mention_id)),
j AS (SELECT r.*, CASE WHEN allow_snap AND (e.seeded OR r.entity_type = 'other' OR e.entity_type = 'other') THEN any_id END AS snap FROM r LEFT JOIN e ON e.id = any_id),
o AS (SELECT *, CASE WHEN n = '' THEN 'dropped' WHEN known IS NOT NULL THEN 'known' WHEN entity_type <> 'person' AND fold <> '' THEN CASE WHEN snap IS NOT NULL THEN 'snapped' ELSE 'minted' END ELSE 'dropped' END AS outcome FROM j),
u AS (SELECT lower(fold) AS k, CASE WHEN count(DISTINCT entity_type) FILTER (WHERE entity_type <> 'other') = 1 AND lower(fold) NOT IN (SELECT lower(canonical_name) FROM e WHERE canonical_name IS NOT NULL)
  THEN min(entity_type) FILTER (WHERE entity_type <> 'other') END AS one FROM o WHERE outcome = 'minted' GROUP BY 1),
p AS (SELECT mention_id, n, k, CASE WHEN entity_type = 'other' AND allow_snap AND one IS NOT NULL THEN one ELSE entity_type END AS new_type FROM o JOIN u ON outcome = 'minted' AND k = lower(fold)),
w AS (SELECT mention_id, new_type, min(n) OVER (PARTITION BY k, new_type) AS new_name FROM p)
SELECT mention_id, CASE outcome WHEN 'known' THEN known WHEN 'snapped' THEN snap END AS entity_id, new_name, new_type, outcome
FROM o LEFT JOIN w USING (mention_id)""")
def resolve_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Known, titled, new, blank and title-only names of four types."""
    return resolve.resolve_mentions(_mentions(spark, d), _entities(spark, d), no_aliases(spark))


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    o, k = views.read(spark, d, "orders"), F.col("o_orderkey")
    half, own = F.floor(F.col("o_custkey") / 2).cast("string"), F.col("o_custkey").cast("string")
    names = [F.concat(F.lit("PARTY "), half), F.concat(F.lit("Dr. Party "), half), F.concat(F.lit("New Firm "), own), F.lit(" "), F.concat(F.lit("new firm "), own), F.lit("Mr.")]
    name = reduce(lambda e, x: F.when(k % 6 == x[0], x[1]).otherwise(e), enumerate(names), F.lit(None).cast("string"))
    kinds = F.array(*map(F.lit, ["customer", "other", "person", "metric"]))
    return o.select(
        k.alias("mention_id"), name.alias("name"), F.get(kinds, (F.floor(k / 6) % 4).cast("int")).alias("entity_type"), (k % 5 > 0).alias("allow_snap"),
        F.create_map().cast("map<string,string>").alias("context"),
    )


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'Joao Pereira ' || o_custkey WHEN 1 THEN 'Ana Tan' WHEN 2 THEN 'Muller' ELSE '' END AS name FROM orders""")
def folded_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("Dr. João  Pereira "), F.col("o_custkey").cast("string"))).when(k == 1, " Mrs Ana\tTan ").when(k == 2, "Müller").otherwise("Prof.")
    return views.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), resolve.fold_name(raw).alias("name"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Engineering' WHEN 1 THEN 'Customer Success' END AS department FROM documents""")
def path_contexts(spark: SparkSession, d: str) -> DataFrame:
    doc, k = views.read(spark, d, "documents"), F.col("doc_id")
    uri = F.concat(F.when(k % 3 == 0, "data/ENG/").when(k % 3 == 1, "data\\cs\\sales/").otherwise("data/other/"), k.cast("string"), F.lit(".md"))
    return doc.select("doc_id", F.try_element_at(resolve.path_context(uri), F.lit("department")).alias("department"))


@query(f"""WITH {ENTITIES}, {MENTIONS}, x AS (SELECT mention_id, trim(name) AS n FROM m)
SELECT CASE WHEN n = '' THEN 'blank' WHEN n = 'Mr.' THEN 'title' ELSE 'name' END AS kind, count(*) AS n FROM x GROUP BY 1""")
def mention_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Mentions by what is left of their names once folded."""
    own = _mentions(spark, d)
    kind = F.when(F.trim("name") == "", "blank").when(resolve.fold_name(F.col("name")) == "", "title").otherwise("name")
    return resolve.outcomes(own.withColumn("outcome", kind)).withColumnRenamed("outcome", "kind")


@query(f"""WITH RECURSIVE {views.LINKS}, {ENTITIES}, k AS (SELECT * REPLACE (CASE WHEN id % 7 = 0 THEN 'dotted_line_to' ELSE link_type END AS link_type) FROM links),
g AS (SELECT DISTINCT from_entity_id AS child, to_entity_id AS parent FROM k WHERE link_type = 'reports_to'),
walk AS (SELECT CAST(min(parent) AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent, 0 AS depth, '/' || min(parent) || '/' AS path FROM g WHERE parent NOT IN (SELECT child FROM g)
  UNION ALL SELECT g.child, w.id, w.depth + 1, w.path || g.child || '/' FROM walk w JOIN g ON g.parent = w.id WHERE position('/' || g.child || '/' IN w.path) = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth, path) AS rn FROM walk WHERE id IS NOT NULL),
dl AS (SELECT from_entity_id AS id, string_agg(CAST(to_entity_id AS VARCHAR), ',' ORDER BY to_entity_id) AS dotted FROM (SELECT DISTINCT from_entity_id, to_entity_id FROM k WHERE link_type = 'dotted_line_to') GROUP BY 1)
SELECT f.id, f.parent, f.depth::BIGINT AS depth, canonical_name AS name, CASE WHEN entity_type = 'person' THEN role END AS role, coalesce(dotted, '') AS dotted
FROM f LEFT JOIN e USING (id) LEFT JOIN dl USING (id) WHERE rn = 1""")
def org_chart(spark: SparkSession, d: str) -> DataFrame:
    """The hierarchy with names, roles of people and dotted lines; every seventh link is dotted."""
    kind = F.when(F.col("id") % 7 == 0, "dotted_line_to").otherwise(F.col("link_type"))
    made = graph.org_chart(views.links(spark, d).withColumn("link_type", kind), _entities(spark, d))
    return made.select("id", "parent", F.col("depth").cast("long"), "name", "role", F.array_join("dotted", ",").alias("dotted"))


@query(f"""WITH {views.LINKS}, {ENTITIES}, {views.DOCUMENTS} SELECT l.id, direction, other_id, canonical_name AS other_name, source_uri FROM (
  SELECT *, CASE WHEN from_entity_id = 3 THEN 'outgoing' ELSE 'incoming' END AS direction, CASE WHEN from_entity_id = 3 THEN to_entity_id ELSE from_entity_id END AS other_id
  FROM links WHERE from_entity_id = 3 OR to_entity_id = 3) l LEFT JOIN e ON e.id = other_id LEFT JOIN docs d ON d.id = l.document_id""")
def named_relationships(spark: SparkSession, d: str) -> DataFrame:
    """Relationships with the other end's name and the source."""
    own = graph.named_relationships(views.links(spark, d), _entities(spark, d), 3)
    return store.cited_links(own, views.chunks(spark, d), views.documents(spark, d)).select("id", "direction", "other_id", "other_name", "source_uri")


VIOLATIONS = """v AS (
  SELECT id, 'no_source_chunk' AS category, 'warning' AS severity FROM census WHERE source_chunk_id IS NULL
  UNION ALL SELECT id, 'dangling_chunk_ref', 'error' FROM census WHERE source_chunk_id IS NOT NULL AND NOT chunk_found
  UNION ALL SELECT id, 'no_document_source', 'error' FROM census WHERE NOT document_found
  UNION ALL SELECT id, 'confidence_out_of_range', 'error' FROM census WHERE confidence NOT BETWEEN 0 AND 1
  UNION ALL SELECT id, 'missing_as_of', 'warning' FROM census WHERE as_of IS NULL
  UNION ALL SELECT id, 'no_evidence', 'warning' FROM census WHERE source_chunk_id IS NOT NULL AND evidence IS NULL
  UNION ALL SELECT id, 'evidence_not_in_chunk', 'error' FROM census WHERE evidence IS NOT NULL AND chunk_text IS NOT NULL AND NOT contains(lower(chunk_text), lower(evidence)))"""


@query(f"WITH {CENSUS}, {VIOLATIONS} SELECT category, severity, count(*) AS n FROM v GROUP BY 1, 2")
def violation_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.by_category(audit.violations(_census(spark, d)))


def _traps(spark: SparkSession, d: str) -> DataFrame:
    named = claims(spark, d).withColumns({"subject_name": F.concat(F.lit("Party "), F.col("subject_entity_id").cast("string")), "canonical_predicate": F.col("predicate")})
    pairs = conflicts(spark, d)
    found = [audit.trap_pairs_surface(named, pairs, "party 1", "urgent"), audit.trap_no_contradiction(pairs, "revenue"), audit.trap_no_contradiction(pairs, "high"), audit.trap_names_apart(_entities(spark, d), "person", "Party ")]
    return reduce(DataFrame.unionByName, found)


TRAPS = f"""{CLAIMS}, {CONFLICTS}, {ENTITIES}, traps AS (
  SELECT 'party 1: urgent surfaces' AS trap, count(*) > 0 AS passed FROM conflicts WHERE predicate = 'urgent' AND contains('party ' || subject_entity_id, 'party 1')
  UNION ALL SELECT 'revenue: no contradiction', count(*) = 0 FROM conflicts WHERE predicate = 'revenue'
  UNION ALL SELECT 'high: no contradiction', count(*) = 0 FROM conflicts WHERE predicate = 'high'
  UNION ALL SELECT 'Party: 2 apart', count(DISTINCT id) >= 2 FROM e WHERE entity_type = 'person' AND lower(canonical_name) LIKE 'party %')"""


@query(f"WITH {TRAPS} SELECT trap, passed FROM traps")
def audit_traps(spark: SparkSession, d: str) -> DataFrame:
    return _traps(spark, d)


@query(f"""WITH {CENSUS.replace("claims AS", "c0 AS", 1).replace("FROM claims f", "FROM c0 f")}, {VIOLATIONS}, {TRAPS},
s AS (SELECT count(*) AS violations, count(*) FILTER (WHERE severity = 'error') AS errors, (SELECT count(*) FROM traps WHERE NOT passed) AS failed_traps FROM v)
SELECT *, errors = 0 AND failed_traps = 0 AS clean FROM s""")
def audit_report(spark: SparkSession, d: str) -> DataFrame:
    return audit.report(audit.violations(_census(spark, d)), _traps(spark, d))


BAD = """confidence < 0.5 OR as_of IS NULL OR (source_chunk_id IS NOT NULL AND evidence IS NULL)
  OR (evidence IS NOT NULL AND chunk_text IS NOT NULL AND NOT contains(lower(chunk_text), lower(evidence)))"""


@query(f"""WITH {CENSUS}, h AS (SELECT id, predicate, coalesce({BAD}, false) AS bad, ((id + 1729) * 2654435761) % 4294967296 AS h FROM census),
b AS (SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY predicate ORDER BY h, id) AS r FROM h WHERE bad) ORDER BY r, predicate LIMIT 12),
o AS (SELECT id, h FROM (SELECT *, row_number() OVER (PARTITION BY predicate ORDER BY h, id) AS r FROM h WHERE id NOT IN (SELECT id FROM b)) ORDER BY r, predicate LIMIT 25)
SELECT id, part FROM (SELECT h.id, h.h, 'suspicious' AS part FROM h JOIN b USING (id) UNION ALL SELECT id, h, 'any' FROM o) ORDER BY part DESC, h, id LIMIT 25""")
def review_sample(spark: SparkSession, d: str) -> DataFrame:
    """25 claims for review, half of them suspicious."""
    return audit.review_sample(_census(spark, d), "predicate", "id").select("id", "part")


LEDGER = """lc AS (SELECT event_type AS source_uri, user_id % 4 AS emitted, event_id % 50 = 0 AS truncated FROM events),
ld AS (SELECT event_type AS source_uri, ['validation_error', 'hypothetical', 'ungrounded', 'other'][CAST(event_id % 4 AS INTEGER) + 1] AS reason FROM events WHERE event_id % 3 = 0 AND event_type <> 'view')"""


def _chunks_seen(spark: SparkSession, d: str) -> DataFrame:
    e = views.read(spark, d, "events")
    return e.select(F.col("event_type").alias("source_uri"), (F.col("user_id") % 4).alias("emitted"), (F.col("event_id") % 50 == 0).alias("truncated"))


def _drops(spark: SparkSession, d: str) -> DataFrame:
    e = views.read(spark, d, "events").where("event_id % 3 = 0 AND event_type <> 'view'")
    reasons = F.array(*map(F.lit, ["validation_error", "hypothetical", "ungrounded", "other"]))
    return e.select(F.col("event_type").alias("source_uri"), F.get(reasons, (F.col("event_id") % 4).cast("int")).alias("reason"))


@query(f"""WITH {LEDGER}, u AS (SELECT source_uri, 1 AS c, (emitted = 0)::INT AS e, truncated::INT AS t, emitted AS n, 0 AS dr, 0 AS lo FROM lc
  UNION ALL SELECT source_uri, 0, 0, 0, 0, 1, (reason NOT IN ('hypothetical', 'ungrounded'))::INT FROM ld)
SELECT source_uri, sum(c)::BIGINT AS chunks, sum(e)::BIGINT AS empty_extractions, sum(t)::BIGINT AS truncated_calls, sum(n)::BIGINT AS items_emitted,
  sum(dr)::BIGINT AS items_dropped, sum(lo)::BIGINT AS lossy_drops FROM u GROUP BY ROLLUP (source_uri)""")
def extraction_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Events as chunks seen and items dropped."""
    return ledger.ledger(_chunks_seen(spark, d), _drops(spark, d))


@query(f"WITH {LEDGER} SELECT source_uri, reason, count(*) AS n FROM ld GROUP BY GROUPING SETS ((source_uri, reason), (reason))")
def drop_counters(spark: SparkSession, d: str) -> DataFrame:
    return ledger.counters(_drops(spark, d), "reason")


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'validation_error' WHEN 1 THEN 'validation_error' WHEN 2 THEN 'validation_error' WHEN 3 THEN 'validation_error' WHEN 4 THEN 'hypothetical' END AS drop_reason,
  CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence FROM orders""")
def strict_claims(spark: SparkSession, d: str) -> DataFrame:
    """Items with a blank subject, no predicate, a bad day, an unknown type, a hypothesis, and sound ones."""
    k = F.col("o_orderkey") % 7
    rows = views.read(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(k == 0, " ").otherwise("Acme").alias("subject"), F.when(k == 1, F.lit(None)).otherwise(F.lit(" revenue ")).alias("predicate"),
        F.when(k == 2, "2026-13-01").when(k == 5, "2026-02-03").alias("as_of"), F.when(k == 3, "file").when(k == 6, "person").alias("subject_type"),
        (k == 4).alias("hypothetical"), F.when(F.col("o_orderkey") % 2 == 0, 3.0).alias("confidence"),
    )
    return ledger.drop_reason(rows).select("id", "drop_reason", "confidence")


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'validation_error' WHEN 1 THEN 'validation_error' WHEN 2 THEN 'validation_error' END AS drop_reason FROM orders""")
def strict_links(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    rows = views.read(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(k == 0, "").otherwise("A").alias("from_entity"), F.lit("B").alias("to_entity"),
        F.when(k == 1, "employs").otherwise("owns").alias("link_type"), F.when(k == 2, "soon").alias("as_of"), F.lit(0.5).alias("confidence"),
    )
    return ledger.link_drop_reason(rows).select("id", "drop_reason")


@query("""WITH a AS (SELECT 'documents' AS t, doc_id % 3 = 0 AS added FROM documents UNION ALL SELECT 'chunks', doc_id % 4 = 0 FROM documents UNION ALL SELECT 'claims', o_orderkey % 5 > 0 FROM orders UNION ALL SELECT 'links', s_suppkey % 2 = 0 FROM supplier)
SELECT t || CASE WHEN added THEN '_added' ELSE '_known' END AS figure, count(*) AS n FROM a GROUP BY 1
UNION ALL SELECT 'mentions_' || CASE WHEN trim(name) = '' THEN 'blank' ELSE 'named' END, count(*) FROM (SELECT CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE c_name END AS name FROM customer) GROUP BY 1""")
def ingest_report(spark: SparkSession, d: str) -> DataFrame:
    doc = views.read(spark, d, "documents")
    name = F.when(F.col("c_custkey") % 9 == 0, " ").otherwise(F.col("c_name"))
    mentions = views.read(spark, d, "customer").select(F.when(F.trim(name) == "", "blank").otherwise("named").alias("outcome"))
    return ledger.ingest_report(
        doc.select((F.col("doc_id") % 3 == 0).alias("added")), doc.select((F.col("doc_id") % 4 == 0).alias("added")),
        views.read(spark, d, "orders").select((F.col("o_orderkey") % 5 > 0).alias("added")), views.read(spark, d, "supplier").select((F.col("s_suppkey") % 2 == 0).alias("added")),
        resolve.outcomes(mentions),
    )


@query("""SELECT doc_id, contains(lower(text), 'the') AS present FROM documents""")
def values_present(spark: SparkSession, d: str) -> DataFrame:
    """The word, or what is left of it in its normal form, within each text."""
    doc = views.read(spark, d, "documents")
    return doc.select("doc_id", ledger.normalized_value_present(F.lit("THE "), F.col("text")).alias("present"))


def _checked(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation as a question; its turns are citations, its system turns contradictions."""
    c = views.read(spark, d, "conversations")
    q = c.groupBy(F.col("conv_id").alias("question_id")).agg(F.count("*").alias("_n"))
    asked = F.array(*[F.lit(x) for x in evaluation.CHECKS])
    q = q.select("question_id", F.filter(asked, lambda x, i: (F.col("question_id") + i) % 3 != 0).alias("checks"))
    uri = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("data/Org-Chart/"), "role")).when(F.col("turn") % 3 == 0, "")
    cited = c.select(F.col("conv_id").alias("question_id"), uri.alias("source_uri"), F.when(F.col("turn") > 1, F.lit("2026-01-01").cast("date")).alias("as_of"))
    return evaluation.answer_checks(q, cited, c.where("length(text) % 5 = 0").select(F.col("conv_id").alias("question_id")))


CHECKED = """cq AS (SELECT conv_id AS question_id, count(*) AS n, count(*) FILTER (WHERE turn % 2 = 0) AS sourced, count(*) FILTER (WHERE turn > 1) AS dated,
  count(DISTINCT CASE WHEN turn % 2 = 0 THEN role END) AS sources, count(*) FILTER (WHERE length(text) % 5 = 0) AS conflicts FROM conversations GROUP BY 1),
names AS (SELECT unnest(range(0, 11)) AS i, unnest([{}]) AS name),
checked AS (SELECT question_id, name AS "check", CASE name WHEN 'cites_source' THEN sourced > 0 WHEN 'states_as_of' THEN dated > 0 WHEN 'resolves_hierarchy' THEN sourced > 0
  WHEN 'uses_freshest_as_of' THEN dated > 0 WHEN 'surfaces_contradiction' THEN conflicts > 0 WHEN 'attributes_each_side' THEN conflicts > 0 AND sources >= 2
  WHEN 'cross_document_synthesis' THEN sources >= 2 WHEN 'cites_multiple_sources' THEN sources >= 2 WHEN 'entity_resolution' THEN n > 0 WHEN 'alias_handling' THEN n > 0
  ELSE conflicts = 0 END AS passed, name <> 'alias_handling' AS gating FROM cq, names WHERE (question_id + i) % 3 <> 0)""".format(", ".join(f"'{x}'" for x in evaluation.CHECKS))


@query(f'WITH {CHECKED} SELECT question_id, "check", passed, gating FROM checked')
def answer_checks(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d)


@query(f"""WITH {CHECKED} SELECT question_id, bool_and(passed OR NOT gating) AS gating_passed, bool_or("check" = 'surfaces_contradiction') AS asks_contradiction,
  bool_or("check" = 'surfaces_contradiction' AND passed) AS surfaced FROM checked GROUP BY 1""")
def graded_answers(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.graded_answers(_checked(spark, d))


@query(f"""WITH {CHECKED}, q AS (SELECT question_id, bool_or("check" = 'uses_freshest_as_of') AS f, bool_or("check" = 'surfaces_contradiction') AS c,
  bool_or("check" = 'uses_freshest_as_of' AND passed) AS ok FROM checked GROUP BY 1) SELECT count(*) FILTER (WHERE ok) AS passed, count(*) AS total FROM q WHERE f AND NOT c""")
def as_of_correctness(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.as_of_correctness(_checked(spark, d))


@query("""WITH g AS (SELECT o_orderkey AS golden_id, o_custkey AS q, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS want, lower(o_orderpriority) AS p FROM orders WHERE o_orderkey % 2 = 0),
s AS (SELECT o_custkey AS q, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN o_custkey + 1 ELSE o_custkey END AS has, lower(o_orderpriority) AS p, o_orderkey % 7 > 1 AS two FROM orders WHERE o_orderkey % 2 = 1),
r AS (SELECT golden_id, max(CASE WHEN s.q IS NULL THEN 0 WHEN want IS NULL OR want = has THEN CASE WHEN two THEN 2 ELSE 1 END WHEN has IS NULL THEN 1 ELSE 0 END) AS r FROM g LEFT JOIN s ON s.q = g.q AND s.p = g.p GROUP BY 1)
SELECT golden_id, ['incorrect', 'partial', 'correct'][CAST(r AS INTEGER) + 1] AS class FROM r""")
def contradiction_classes(spark: SparkSession, d: str) -> DataFrame:
    """Even orders are planted, odd ones what answers surfaced."""
    o, k, c = views.read(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    g = o.where("o_orderkey % 2 = 0").select(k.alias("golden_id"), c.alias("question_id"), F.when(k % 3 > 0, c).alias("subject_entity_id"), F.col("o_orderpriority").alias("predicate"))
    s = o.where("o_orderkey % 2 = 1").select(
        c.alias("question_id"), F.when(k % 5 == 1, c + 1).when(k % 5 > 1, c).alias("subject_entity_id"), F.lower("o_orderpriority").alias("predicate"),
        k.alias("claim_a_id"), F.when(k % 7 == 0, k).when(k % 7 > 1, k + 1).alias("claim_b_id"),
    )
    return evaluation.contradiction_classes(g, s)


@query(f"""WITH {LEDGER}, t AS (SELECT DISTINCT event_type AS source_uri FROM events UNION SELECT 'absent'),
v AS (SELECT event_type AS source_uri, count(*) AS total, count(*) FILTER (WHERE event_id % 9 > 0) AS found FROM events WHERE event_type IN ('view', 'click') GROUP BY 1),
l AS (SELECT source_uri, count(*) FILTER (WHERE emitted = 0) + count(*) FILTER (WHERE truncated) AS silent FROM lc GROUP BY 1),
d AS (SELECT source_uri, count(*) FILTER (WHERE reason NOT IN ('hypothetical', 'ungrounded')) AS lossy FROM ld GROUP BY 1)
SELECT source_uri, coalesce(found, 0) AS found, coalesce(total, 0) AS total, CASE WHEN coalesce(found, 0) < coalesce(total, 0) OR silent > 0 THEN 'FAIL' ELSE 'INCOMPLETE' END AS verdict
FROM t LEFT JOIN v USING (source_uri) LEFT JOIN l USING (source_uri) LEFT JOIN d USING (source_uri)""")
def document_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Sources by their golden facts, losses and vectors; vectors are known of one alone."""
    e = views.read(spark, d, "events")
    docs = e.select(F.col("event_type").alias("source_uri")).distinct().unionByName(spark.range(1).select(F.lit("absent").alias("source_uri")))
    told = e.where("event_type IN ('view', 'click')").select(F.col("event_type").alias("source_uri"), F.when(F.col("event_id") % 9 > 0, "found").otherwise("missing").alias("verdict"))
    vectors = docs.where("source_uri = 'view'").withColumn("ok", F.lit(True))
    made = evaluation.document_verdicts(docs, told, ledger.ledger(_chunks_seen(spark, d), _drops(spark, d)), vectors)
    return made.select("source_uri", "found", "total", "verdict")


@query("""SELECT count(*) FILTER (WHERE quality = 1) AS caught, count(*) AS total, count(*) FILTER (WHERE toxic = 1) AS baseline, round(count(*) FILTER (WHERE quality = 1) / count(*), 9) AS recall,
  count(*) FILTER (WHERE quality = 1) >= count(*) FILTER (WHERE toxic = 1) AS held FROM labels""")
def oracle_totals(spark: SparkSession, d: str) -> DataFrame:
    """Labels as verdicts on oracle items."""
    rows = views.read(spark, d, "labels").select((F.col("quality") == 1).alias("caught"), (F.col("toxic") == 1).alias("baseline_caught"))
    return evaluation.oracle_totals(rows).withColumn("recall", F.round("recall", 9))


@query("""WITH f AS (SELECT doc_id % 150 AS id FROM documents), c AS (SELECT doc_id AS a, doc_id + 5 AS b FROM documents WHERE doc_id < 200)
SELECT 'duplicate_fact' AS problem, id FROM f GROUP BY id HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'dangling_side', s FROM (SELECT a AS s FROM c UNION ALL SELECT b FROM c) WHERE s NOT IN (SELECT id FROM f)""")
def golden_problems(spark: SparkSession, d: str) -> DataFrame:
    """Golden data with ids that repeat and sides that name no fact."""
    doc = views.read(spark, d, "documents")
    sides = doc.where("doc_id < 200").select(F.col("doc_id").alias("claim_a"), (F.col("doc_id") + 5).alias("claim_b"))
    return evaluation.sound_golden(doc.select((F.col("doc_id") % 150).alias("id")), sides)


SPAN = 24
SPANS = f"""sp AS (SELECT doc_id AS id, doc_id % 5 AS k, doc_id % 7 AS start, coalesce(text, '') AS body, substring(coalesce(text, ''), doc_id % 7 + 1, {SPAN}) AS cut FROM documents),
ev AS (SELECT *, CASE k WHEN 2 THEN upper(cut) WHEN 4 THEN 'zqx ' || cut ELSE cut END AS evidence, CASE k WHEN 1 THEN start + 1 ELSE start END AS char_start FROM sp)"""


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """A claim for each document, out of a span of its text: told rightly, with offsets one too far, in capitals, with a value of its own, with words of its own."""
    doc = views.read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    k, start = F.col("doc_id") % 5, (F.col("doc_id") % 7).cast("int")
    cut = F.substr("body", start + 1, F.lit(SPAN))
    evidence = F.when(k == 2, F.upper(cut)).when(k == 4, F.concat(F.lit("zqx "), cut)).otherwise(cut)
    first = F.when(k == 1, start + 1).otherwise(start)
    claims = doc.select(
        F.col("doc_id").alias("id"), F.lit(1).cast("bigint").alias("subject_entity_id"), F.lit("said").alias("predicate"), F.when(k == 3, F.lit("zqx")).otherwise(evidence).alias("object_value"),
        F.lit(0.5).alias("confidence"), F.lit("2024-01-01").cast("date").alias("as_of"), F.lit(None).cast("bigint").alias("superseded_by"), F.col("doc_id").alias("source_chunk_id"),
        F.col("doc_id").alias("document_id"), evidence.alias("evidence"), first.alias("char_start"), (first + F.char_length(cut)).alias("char_end"),
    )
    chunks = doc.select(F.col("doc_id").alias("id"), F.col("body").alias("text"))
    none = F.lit(None).cast("string")
    return audit.census(claims, chunks, doc.select(F.col("doc_id").alias("id")), spark.range(1, 2).select("id", none.alias("canonical_name")))


@query(f"""WITH {SPANS}
SELECT id, 'no_evidence' AS category, 'warning' AS severity FROM ev WHERE evidence = ''
UNION ALL SELECT id, 'offsets_mismatch', 'error' FROM ev WHERE evidence <> '' AND substring(body, char_start + 1, length(cut)) <> evidence
UNION ALL SELECT id, 'evidence_not_verbatim', 'warning' FROM ev WHERE k = 2 AND NOT contains(body, evidence)
UNION ALL SELECT id, 'evidence_not_in_chunk', 'error' FROM ev WHERE k = 4 AND NOT contains(body, evidence)
UNION ALL SELECT id, 'value_not_in_evidence', 'warning' FROM ev WHERE k = 3 AND evidence <> '' AND NOT contains(lower(evidence), 'zqx')""")
def span_violations(spark: SparkSession, d: str) -> DataFrame:
    """Evidence and offsets against the whole texts they were cut from."""
    return audit.violations(_spans(spark, d))


@query("""WITH s AS (SELECT 'corpus/' || doc_id AS source_uri, doc_id, coalesce(text, '') AS body FROM documents)
SELECT source_uri, CASE WHEN doc_id % 7 = 0 THEN 'gone' WHEN doc_id % 7 = 1 THEN 'new' ELSE 'changed' END AS fault FROM s
WHERE doc_id % 7 < 2 OR (doc_id % 7 = 2 AND upper(body) <> body)""")
def stale_proofs(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of all documents, before and after some are gone, some are new and some are in capitals."""
    k, body = F.col("doc_id") % 7, F.coalesce("text", F.lit(""))
    doc = views.read(spark, d, "documents").select("doc_id", F.concat(F.lit("corpus/"), F.col("doc_id").cast("string")).alias("source_uri"), body.alias("body"))
    then = doc.where(k != 1).select("source_uri", F.encode("body", "UTF-8").alias("content"))
    now = doc.where(k != 0).select("source_uri", F.encode(F.when(k == 2, F.upper("body")).otherwise(F.col("body")), "UTF-8").alias("content"))
    return stale(fingerprint(then), fingerprint(now))
