"""Registered queries through the engine's surface and with aliases, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.lineage import shared_folder
from tidemark.operators import resolve

from . import answers, views
from .catalogue import ORACLE_SQL, query


def engine(spark: SparkSession, d: str) -> Engine:
    """Customers as entities with their phone numbers as aliases, orders as claims, documents as chunks with the vectors of their ids."""
    c, doc = views.read(spark, d, "customer"), views.read(spark, d, "documents")
    none = F.create_map().cast("map<string,string>")
    vectors = views.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    chunks = doc.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("document_id"), F.lit(0).alias("ordinal"), "text")
    vocab = spark.sql("SELECT lower(p) AS canonical_key, p AS display_name, array(concat('prio ', substring(p, 1, 1))) AS aliases FROM VALUES ('1-URGENT'), ('2-HIGH') t(p)")
    return Engine(
        {
            "documents": views.documents(spark, d), "chunks": chunks.join(vectors, "id", "left"),
            "entities": c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("canonical_name"), F.lit("customer").alias("entity_type"), none.alias("attributes"), F.lit(True).alias("seeded")),
            "entity_aliases": c.select(F.col("c_custkey").alias("entity_id"), F.concat(F.lit("Account "), F.col("c_custkey").cast("string")).alias("alias")),
            "metric_vocab": vocab, "claims": views.claims(spark, d), "links": views.links(spark, d).withColumn("raw_verb", F.lit(None).cast("string")),
        },
        buckets=answers.BUCKETS,
    )


#: The index of the surface holds the vectors of chunks; there may be vectors without one.
OF_CHUNKS = ORACLE_SQL["search_rows"].replace("WHERE vector IS NOT NULL", "WHERE vector IS NOT NULL AND vec_id IN (SELECT doc_id FROM documents)")


@query(OF_CHUNKS)
def engine_search(spark: SparkSession, d: str) -> DataFrame:
    """The best passages of all questions, by words and vectors, as the surface shows them."""
    found = engine(spark, d).index(shared_folder(spark, "indexes"), 16).search(answers.searches(spark, d), answers.PASSAGES)
    return found.drop("rank").withColumn("score", F.round("score", 9))


CITED = f"""{views.CLAIMS}, {views.DOCUMENTS}, cited AS (SELECT c.*, d.source_uri, coalesce(c.as_of, d.as_of) AS source_as_of FROM claims c
  LEFT JOIN documents k ON c.source_chunk_id = k.doc_id LEFT JOIN docs d ON coalesce(c.document_id, k.doc_id) = d.id)"""


@query(f"""WITH {CITED} SELECT id AS claim_id, '1-urgent' AS predicate, object_value AS value, as_of, source_uri, source_as_of FROM cited
WHERE subject_entity_id = 7 AND predicate = '1-URGENT'""")
def engine_timeline(spark: SparkSession, d: str) -> DataFrame:
    """What one customer, named by an alias, was given in one priority, named by an alias too."""
    return engine(spark, d).get_timeline("account 7", "Prio 1").select("claim_id", "predicate", "value", "as_of", "source_uri", "source_as_of")


@query(f"""WITH {CITED} SELECT id AS claim_id, subject_entity_id, c_name AS subject_name, object_value AS value, as_of, confidence::DOUBLE AS confidence, source_uri
FROM cited LEFT JOIN customer ON c_custkey = subject_entity_id WHERE predicate = '2-HIGH'""")
def engine_claims_by_predicate(spark: SparkSession, d: str) -> DataFrame:
    """The claims of all customers in one priority."""
    own = engine(spark, d).get_claims_by_predicate("2-high")
    return own.select("claim_id", "subject_entity_id", "subject_name", "value", "as_of", "confidence", "source_uri")


FIRST_WORDS = "regexp_extract_all(lower(text), '[a-z]+')"


def aliases(spark: SparkSession, d: str) -> DataFrame:
    """(entity_id, alias): the first two words of a document, and the second by itself, for the entity of its first word."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)
    w = views.read(spark, d, "documents").select(F.get(words, F.lit(0)).alias("a"), F.get(words, F.lit(1)).alias("b")).where("b IS NOT NULL").distinct()
    e = answers.entities(spark, d).select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("a"))
    return w.join(e, "a").select("entity_id", F.explode(F.array(F.concat("a", F.lit(" "), "b"), F.col("b"))).alias("alias")).distinct()


KNOWN = f"""w AS (SELECT DISTINCT {FIRST_WORDS}[1] AS a, {FIRST_WORDS}[2] AS b FROM documents WHERE len({FIRST_WORDS}) > 1),
aliases AS (SELECT DISTINCT id AS entity_id, alias FROM (SELECT id, unnest([a || ' ' || b, b]) AS alias FROM w JOIN entities ON a = canonical_name)),
known AS (SELECT canonical_name AS name, id FROM entities
  UNION ALL SELECT alias, min(entity_id) FROM aliases WHERE alias NOT IN (SELECT canonical_name FROM entities) GROUP BY 1 HAVING count(*) = 1)"""


@query(f"""WITH {answers.ENTITIES}, {KNOWN}, m AS (SELECT doc_id AS mention_id, {FIRST_WORDS} AS w FROM documents)
SELECT mention_id, id AS entity_id FROM m LEFT JOIN known ON name = CASE mention_id % 3 WHEN 0 THEN w[1] || ' ' || w[2] WHEN 1 THEN w[2] ELSE w[1] END WHERE len(w) > 1""")
def alias_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Names and aliases in any case; an alias of several entities, or that is no one's, stays unresolved."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)
    a, b, k = F.get(words, F.lit(0)), F.get(words, F.lit(1)), F.col("doc_id") % 3
    name = F.when(k == 0, F.upper(F.concat(a, F.lit(" "), b))).when(k == 1, b).otherwise(a)
    mentions = views.read(spark, d, "documents").where(F.size(words) > 1).select(F.col("doc_id").alias("mention_id"), name.alias("name"), F.create_map().cast("map<string,string>").alias("context"))
    return resolve.resolve(mentions, answers.entities(spark, d), aliases(spark, d))


@query(f"""WITH {answers.QUESTIONS}, {answers.TERMS}, {answers.ENTITIES}, {KNOWN},
sf AS (SELECT question_id, id AS entity_id, min(pos) AS pos FROM terms JOIN known ON lower(trim(term)) = name GROUP BY ALL)
SELECT question_id, entity_id, row_number() OVER (PARTITION BY question_id ORDER BY pos, entity_id) AS position FROM sf
QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY pos, entity_id) <= 6""")
def alias_subjects(spark: SparkSession, d: str) -> DataFrame:
    """The subjects of questions by names and aliases, of one word or two."""
    terms = answers.answering.terms(answers.questions(spark, d))
    return resolve.subjects_of(terms, answers.entities(spark, d), aliases(spark, d)).withColumn("position", F.col("position").cast("long"))
