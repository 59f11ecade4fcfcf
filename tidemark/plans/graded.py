"""Registered queries of extraction, vocabulary, clusters and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import audit, contradictions, evaluation, extraction, graph, temporal, vocabulary

from . import views
from .catalogue import query


def _vocab(spark: SparkSession, d: str) -> DataFrame:
    """Priorities but the lowest, by their words."""
    p = views.read(spark, d, "orders").select("o_orderpriority").distinct().where("o_orderpriority NOT LIKE '5%'")
    return p.select(F.lower(F.substring("o_orderpriority", 3, 99)).alias("canonical_key"), F.array("o_orderpriority").alias("aliases"))


VOCAB = "v AS (SELECT DISTINCT lower(o_orderpriority) AS term, lower(substring(o_orderpriority, 3)) AS k FROM orders WHERE o_orderpriority NOT LIKE '5%')"


@query(f"""WITH {VOCAB}, r AS (SELECT o_orderkey AS id, o_orderpriority AS p,
  CASE o_orderkey % 3 WHEN 0 THEN 'Q1 2026 ' || o_orderpriority WHEN 1 THEN 'Q1 vs ' || o_orderpriority ELSE o_orderpriority END AS predicate FROM orders)
SELECT id, predicate, CASE WHEN id % 3 <> 1 THEN coalesce(k, predicate) ELSE predicate END AS canonical_predicate FROM r LEFT JOIN v ON term = lower(p)""")
def canonical_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Predicates with a period in front, and with one that a word follows."""
    o, p = views.read(spark, d, "orders"), F.col("o_orderpriority")
    kind = F.col("o_orderkey") % 3
    raw = F.when(kind == 0, F.concat(F.lit("Q1 2026 "), p)).when(kind == 1, F.concat(F.lit("Q1 vs "), p)).otherwise(p)
    return vocabulary.canonical(o.select(F.col("o_orderkey").alias("id"), raw.alias("predicate")), _vocab(spark, d))


@query(f"""WITH {VOCAB}, r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'Acme' END AS subject,
  CASE WHEN o_orderkey % 3 = 0 THEN 'person' ELSE 'metric' END AS subject_type, CASE WHEN o_orderkey % 5 = 0 THEN '2026 1-URGENT' ELSE 'status' END AS predicate FROM orders),
m AS (SELECT *, subject_type = 'metric' AND lower(subject) IN (SELECT term FROM v) AS moved FROM r)
SELECT id, CASE WHEN moved THEN 'Us' ELSE subject END AS subject, CASE WHEN moved THEN 'other' ELSE subject_type END AS subject_type,
  CASE WHEN moved AND predicate = 'status' THEN subject ELSE predicate END AS predicate FROM m""")
def metric_subjects(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = views.read(spark, d, "orders").select(
        k.alias("id"), F.when(k % 2 == 0, F.col("o_orderpriority")).otherwise("Acme").alias("subject"),
        F.when(k % 3 == 0, "person").otherwise("metric").alias("subject_type"), F.when(k % 5 == 0, "2026 1-URGENT").otherwise("status").alias("predicate"),
    )
    return extraction.repair_metric_subjects(rows, _vocab(spark, d), "Us")


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey AS f, o_orderkey % 1000 AS t, ['Manages ', 'reports to', 'employed by', ' ', 'OWNS', 'Lead', NULL, 'part_of'][CAST(o_orderkey % 8 AS INTEGER) + 1] AS verb, o_orderkey % 8 AS k FROM orders)
SELECT id, CASE WHEN k IN (0, 5) THEN t ELSE f END AS from_entity, CASE WHEN k IN (0, 5) THEN f ELSE t END AS to_entity,
  ['reports_to', 'reports_to', 'mentions', NULL, 'owns', 'dotted_line_to', NULL, 'member_of'][CAST(k AS INTEGER) + 1] AS link_type,
  CASE WHEN k = 2 THEN 'employed by' END AS raw_verb, CASE WHEN k IN (3, 6) THEN 'unmappable_enum' END AS drop_reason FROM r""")
def link_verb_coerce(spark: SparkSession, d: str) -> DataFrame:
    verbs = F.array(*map(F.lit, ["Manages ", "reports to", "employed by", " ", "OWNS", "Lead", None, "part_of"]))
    k = F.col("o_orderkey")
    rows = views.read(spark, d, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("from_entity"), (k % 1000).alias("to_entity"), F.get(verbs, (k % 8).cast("int")).alias("link_type")
    )
    return extraction.coerce_links(rows)


@query("""WITH r AS (SELECT o_orderkey AS id, ['Person', 'team', ' Company ', 'ticket', NULL, 'firm'][CAST(o_orderkey % 6 AS INTEGER) + 1] AS t FROM orders)
SELECT id, CASE WHEN id % 6 IN (0, 1) THEN lower(t) WHEN t IS NOT NULL THEN 'other' END AS subject_type, CASE WHEN id % 6 = 3 THEN t END AS raw_subject_type FROM r""")
def subject_type_coerce(spark: SparkSession, d: str) -> DataFrame:
    types = F.array(*map(F.lit, ["Person", "team", " Company ", "ticket", None, "firm"]))
    rows = views.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.get(types, (F.col("o_orderkey") % 6).cast("int")).alias("subject_type"))
    return extraction.coerce_subject_types(rows)


@query(f"""WITH {views.CLAIMS} SELECT id, CASE WHEN evidence IS NULL OR id % 4 = 0 THEN 'ungrounded'
  WHEN id % 5 = 1 THEN 'value_only' ELSE 'exact' END AS grade, CASE WHEN evidence IS NULL OR id % 4 = 0 THEN greatest(0.1, confidence * 0.5) ELSE confidence END::DOUBLE AS confidence
FROM claims""")
def grounding_grades(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth value is not in its evidence; every fifth evidence is not in its chunk."""
    c, k, v = views.claims(spark, d), F.col("id"), F.col("object_value")
    value = F.when(k % 4 == 0, (v.cast("bigint") + 1).cast("string")).otherwise(v)
    body = F.when(k % 5 == 0, F.concat(F.lit("Total — "), v)).when(k % 5 == 1, "nothing here").otherwise(F.concat_ws(" ", F.lit("so"), "evidence", F.lit(".")))
    rows = extraction.graded(c.select("id", "evidence", "confidence", value.alias("object_value"), body.alias("chunk_text")))
    return rows.select("id", "grade", extraction.penalized(F.col("confidence").cast("double"), F.col("grade")).alias("confidence"))


@query("""WITH r AS (SELECT doc_id AS id, text, substring(text, 1, 20) AS e FROM documents),
n AS (SELECT *, (length(text) - length(replace(text, e, ''))) // greatest(1, length(e)) AS n FROM r)
SELECT id, CASE WHEN n = 1 AND trim(e) <> '' THEN 0 END AS char_start, CASE WHEN n = 1 AND trim(e) <> '' THEN length(e)::INTEGER END AS char_end FROM n""")
def evidence_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where the first words of a document stand, if nowhere else in it."""
    t = views.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.substring("text", 1, 20).alias("e"))
    return t.select("id", extraction.locate(F.col("e"), F.col("text")).alias("s")).select("id", "s.char_start", "s.char_end")


@query("""WITH k AS (SELECT event_id, user_id, event_type, event_id % 3 AS pass, row_number() OVER (PARTITION BY user_id, lower(event_type) ORDER BY event_id % 3, event_id) AS rn FROM events)
SELECT event_id, user_id, event_type, pass FROM k WHERE rn = 1""")
def merged_passes(spark: SparkSession, d: str) -> DataFrame:
    """Events of three passes, each user and type once."""
    e = views.read(spark, d, "events").select("event_id", "user_id", "event_type", (F.col("event_id") % 3).alias("pass"))
    return extraction.merge_passes(e, [F.col("user_id"), F.lower("event_type")], ["pass", "event_id"])


@query(f"WITH {views.CLAIMS} SELECT DISTINCT subject_entity_id, predicate FROM claims")
def claim_groups(spark: SparkSession, d: str) -> DataFrame:
    return contradictions.claim_groups(views.claims(spark, d))


@query(f"""WITH {views.CLAIMS} SELECT a.subject_entity_id, a.predicate, a.id AS claim_a_id, b.id AS claim_b_id FROM claims a
JOIN claims b ON a.subject_entity_id = b.subject_entity_id AND a.predicate = b.predicate AND a.id < b.id
WHERE a.object_value <> b.object_value AND (a.as_of IS NULL OR b.as_of IS NULL OR a.as_of = b.as_of)
  AND (a.predicate = '1-URGENT' OR a.subject_entity_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))""")
def contradictions_relevant(spark: SparkSession, d: str) -> DataFrame:
    """Of one market segment's customers, or urgent."""
    subjects = views.read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("subject_entity_id"))
    topics = views.read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderpriority").alias("predicate"))
    found = contradictions.relevant(contradictions.detect(views.claims(spark, d)), subjects, topics)
    return found.select("subject_entity_id", "predicate", "claim_a_id", "claim_b_id")


@query(f"""WITH {views.CLAIMS}, {views.LINKS}, m AS (
  SELECT subject_entity_id AS s, 'claim' AS b, 'claim|' || subject_entity_id || '|' || predicate || '|' || object_value || '|' || coalesce(CAST(as_of AS VARCHAR), '') AS g FROM claims
  UNION ALL SELECT from_entity_id, 'link', 'link|' || from_entity_id || '|' || link_type || '|' || to_entity_id || '|' || coalesce(CAST(as_of AS VARCHAR), '') FROM links),
c AS (SELECT s, count(*) FILTER (WHERE b = 'claim') AS n_claims, count(*) FILTER (WHERE b = 'link') AS n_links, sha256(string_agg(g, chr(10) ORDER BY g)) AS h FROM m GROUP BY s)
SELECT s AS subject_entity_id, n_claims, n_links, n_claims + n_links <= 40 AND (n_claims >= 2 OR n_links >= 2) AS judged,
  CASE WHEN n_claims + n_links <= 40 AND (n_claims >= 2 OR n_links >= 2) THEN h END AS cluster_key FROM c""")
def conflict_clusters(spark: SparkSession, d: str) -> DataFrame:
    return contradictions.clusters(views.claims(spark, d), views.links(spark, d))


@query(f"WITH {views.CLAIMS} SELECT document_id, max(as_of) AS freshest FROM claims WHERE as_of IS NOT NULL GROUP BY 1")
def freshest_per_source(spark: SparkSession, d: str) -> DataFrame:
    return temporal.freshest_per_source(views.claims(spark, d), "document_id")


@query(f"""WITH {views.CLAIMS}, {views.LINKS}
SELECT c_custkey AS id, (SELECT count(*) FROM claims WHERE subject_entity_id = c_custkey) AS claims,
  (SELECT count(*) FROM links WHERE from_entity_id = c_custkey) AS outgoing,
  (SELECT count(*) FROM links WHERE to_entity_id = c_custkey AND from_entity_id <> c_custkey) AS incoming FROM customer""")
def entity_degrees(spark: SparkSession, d: str) -> DataFrame:
    e = views.read(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return graph.degrees(e, views.claims(spark, d), views.links(spark, d))


@query(f"""WITH {views.CLAIMS}, {views.LINKS}
SELECT 'claim' AS fact, id, predicate AS about, object_value AS value, as_of FROM claims WHERE subject_entity_id = 3
UNION ALL SELECT CASE WHEN from_entity_id = 3 THEN 'outgoing' ELSE 'incoming' END, id, link_type,
  CAST(CASE WHEN from_entity_id = 3 THEN to_entity_id ELSE from_entity_id END AS VARCHAR), as_of FROM links WHERE from_entity_id = 3 OR to_entity_id = 3""")
def entity_detail(spark: SparkSession, d: str) -> DataFrame:
    return graph.entity_detail(3, views.claims(spark, d), views.links(spark, d))


@query("""WITH g AS (SELECT vec_id // 2 AS id, count(*) AS n, count(*) FILTER (WHERE list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) > 0) AS good FROM embeddings GROUP BY 1)
SELECT doc_id AS id, coalesce(n, 0) AS n, coalesce(good, 0) AS good, coalesce(n > 0 AND good = n, false) AS ok FROM documents LEFT JOIN g ON id = doc_id""")
def document_embeddings(spark: SparkSession, d: str) -> DataFrame:
    v = views.read(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("document_id"), "embedding")
    return audit.document_embeddings(views.read(spark, d, "documents").select(F.col("doc_id").alias("id")), v)


@query(f"""WITH {views.CLAIMS}, f AS (SELECT id AS fact_id, subject_entity_id, CASE WHEN id % 6 = 0 THEN 'none' ELSE predicate END AS predicate,
  CAST(CAST(object_value AS BIGINT) + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS value, 'd' || document_id AS doc, as_of FROM claims)
SELECT f.fact_id, f.predicate, CASE max(CASE WHEN c.id IS NULL THEN 0 WHEN c.object_value = f.value AND 'd' || c.document_id = f.doc
  AND (f.as_of IS NULL OR coalesce(c.as_of = f.as_of, false)) THEN 2 ELSE 1 END) WHEN 0 THEN 'missing' WHEN 1 THEN 'mismatch' ELSE 'found' END AS verdict
FROM f LEFT JOIN claims c ON c.subject_entity_id = f.subject_entity_id AND c.predicate = f.predicate GROUP BY 1, 2""")
def golden_claim_facts(spark: SparkSession, d: str) -> DataFrame:
    """Claims as golden facts, some with another value or predicate."""
    c, k = views.claims(spark, d), F.col("id")
    facts = c.select(
        k.alias("fact_id"), "subject_entity_id", F.when(k % 6 == 0, "none").otherwise(F.col("predicate")).alias("predicate"),
        F.concat(F.lit("USD "), F.col("object_value").cast("bigint") + F.when(k % 5 == 0, 1).otherwise(0)).alias("value"),
        F.concat(F.lit("d"), "document_id", F.lit(".md")).alias("source_uri"), "as_of",
    )
    uri = F.concat(F.lit("corpus/D"), "document_id", F.lit(".md"))
    stored = c.select("subject_entity_id", "predicate", "object_value", "as_of", uri.alias("source_uri"), F.lit(None).cast("date").alias("source_as_of"))
    return evaluation.claim_facts(facts, stored)


@query(f"""WITH {views.LINKS}, f AS (SELECT id, link_type, CASE WHEN id % 3 = 1 THEN to_entity_id ELSE from_entity_id END AS a,
  CASE WHEN id % 3 = 1 THEN from_entity_id WHEN id % 3 = 2 THEN to_entity_id + 1000000 ELSE to_entity_id END AS b FROM links)
SELECT id AS fact_id, link_type AS predicate, CASE WHEN EXISTS (SELECT 1 FROM links l WHERE l.from_entity_id = a AND l.to_entity_id = b) THEN 'found'
  WHEN EXISTS (SELECT 1 FROM links l WHERE l.from_entity_id = b AND l.to_entity_id = a) THEN 'mismatch' ELSE 'missing' END AS verdict FROM f""")
def golden_link_facts(spark: SparkSession, d: str) -> DataFrame:
    """Links as golden facts, some reversed, some to others."""
    own, k = views.links(spark, d), F.col("id") % 3
    a, b = F.col("from_entity_id"), F.col("to_entity_id")
    facts = own.select(F.col("id").alias("fact_id"), "link_type", F.when(k == 1, b).otherwise(a).alias("from_entity_id"),
                       F.when(k == 1, a).when(k == 2, b + 1000000).otherwise(b).alias("to_entity_id"))
    return evaluation.link_facts(facts, own)


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    own = views.read(spark, d, "labels").join(views.read(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return own.select(F.col("lang").alias("predicate"), F.when(F.col("quality") == 1, "found").when(F.col("toxic") == 1, "mismatch").otherwise("missing").alias("verdict"))


CARD = """p AS (SELECT lang, count(*) AS total, count(*) FILTER (WHERE quality = 1) AS found, count(*) FILTER (WHERE toxic = 1 AND quality IS DISTINCT FROM 1) AS mismatch
  FROM labels JOIN documents USING (doc_id) GROUP BY 1),
s AS (SELECT CAST(sum(total) AS BIGINT) AS total, CAST(sum(found) AS BIGINT) AS found, CAST(sum(mismatch) AS BIGINT) AS mismatch, round(avg(found / total), 9) AS macro_recall,
  round(sum(found) / sum(total), 9) AS recall, round(sum(found) / sum(found + mismatch), 9) AS precision FROM p)"""


@query(f"WITH {CARD} SELECT * FROM s")
def recall_scorecard(spark: SparkSession, d: str) -> DataFrame:
    s = evaluation.scorecard(_verdicts(spark, d))
    return s.withColumns({c: F.round(c, 9) for c in ("macro_recall", "recall", "precision")})


@query(f"""WITH {CARD} SELECT (SELECT recall >= 0.5 FROM s) AS recall_ok, bool_and(l_quantity > 0) AS answers_ok,
  bool_or(l_returnflag = 'R' AND l_linestatus = 'F') AS contradiction_ok FROM lineitem""")
def goal_verdict(spark: SparkSession, d: str) -> DataFrame:
    answers = views.read(spark, d, "lineitem").select(
        (F.col("l_quantity") > 0).alias("gating_passed"), (F.col("l_returnflag") == "R").alias("asks_contradiction"), (F.col("l_linestatus") == "F").alias("surfaced")
    )
    return evaluation.goal(answers, evaluation.scorecard(_verdicts(spark, d)), bar=0.5)


@query("""WITH p AS (SELECT o_custkey AS probe, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey // 32 END AS e FROM orders)
SELECT probe, count(*) = count(e) AND count(DISTINCT e) = count(*) AS passed FROM p GROUP BY 1""")
def entity_collisions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    probes = views.read(spark, d, "orders").select(F.col("o_custkey").alias("probe"), F.when(k % 7 > 0, F.floor(k / 32)).alias("entity_id"))
    return evaluation.collisions(probes)


@query(f"""WITH {views.CLAIMS}, c AS (SELECT a.subject_entity_id AS s, a.predicate AS p, a.object_value || ' against ' || b.object_value AS note FROM claims a
  JOIN claims b ON a.subject_entity_id = b.subject_entity_id AND a.predicate = b.predicate AND a.id < b.id
  WHERE a.object_value <> b.object_value AND (a.as_of IS NULL OR b.as_of IS NULL OR a.as_of = b.as_of)),
i AS (SELECT c_custkey AS item_id, c_custkey AS s, '1-URGENT' AS p, NULL AS x FROM customer
  UNION ALL SELECT -1 - n_nationkey, NULL, '2-HIGH', CAST(n_nationkey + 10 AS VARCHAR) FROM nation)
SELECT item_id, EXISTS (SELECT 1 FROM c WHERE c.p = i.p AND (c.s = i.s OR (i.s IS NULL AND contains(c.note, i.x) AND contains(c.note, 'against')))) AS caught FROM i""")
def oracle_recall(spark: SparkSession, d: str) -> DataFrame:
    """An urgent conflict of each customer, and one for each nation whose subject is unknown."""
    own = views.claims(spark, d)
    values = own.select(F.col("id"), F.col("object_value").alias("v"))
    pairs = contradictions.detect(own)
    named = pairs.join(values.select(F.col("id").alias("claim_a_id"), F.col("v").alias("va")), "claim_a_id").join(
        values.select(F.col("id").alias("claim_b_id"), F.col("v").alias("vb")), "claim_b_id"
    )
    noted = named.select("subject_entity_id", "predicate", F.concat_ws(" against ", "va", "vb").alias("note"))
    none = F.lit(None).cast("string")
    known = views.read(spark, d, "customer").select(
        F.col("c_custkey").alias("item_id"), F.col("c_custkey").alias("subject_entity_id"), F.lit("1-URGENT").alias("predicate"), none.alias("value_a"), none.alias("value_b")
    )
    loose = views.read(spark, d, "nation").select(
        (-1 - F.col("n_nationkey")).alias("item_id"), F.lit(None).cast("bigint").alias("subject_entity_id"), F.lit("2-HIGH").alias("predicate"),
        (F.col("n_nationkey") + 10).cast("string").alias("value_a"), F.lit("AGAINST").alias("value_b"),
    )
    return evaluation.oracle_caught(known.unionByName(loose), noted)
