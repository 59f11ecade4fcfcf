"""The ontology's tables derived from the standard benchmark tables, in Spark and as SQL prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as claims: the customer's value for a priority, dated but for every eleventh."""
    key = F.col("o_orderkey")
    null = F.lit(None)
    return read(spark, sf_dir, "orders").select(
        key.alias("id"), F.col("o_custkey").alias("subject_entity_id"), F.col("o_orderpriority").alias("predicate"),
        F.round("o_totalprice").cast("bigint").cast("string").alias("object_value"), null.cast("bigint").alias("object_entity_id"),
        F.when(key % 11 != 0, F.col("o_orderdate").cast("date")).alias("as_of"),
        ((key % 13) / 10.0).alias("confidence"), null.cast("date").alias("valid_from"), null.cast("date").alias("valid_to"),
        null.cast("bigint").alias("superseded_by"), F.when(key % 17 != 0, key % 100).alias("source_chunk_id"),
        (key % 7).alias("document_id"),
        F.when(key % 3 != 0, F.concat(F.lit("total "), F.round("o_totalprice").cast("bigint").cast("string"))).alias("evidence"),
    )


CLAIMS = """claims AS (
  SELECT o_orderkey AS id, o_custkey AS subject_entity_id, o_orderpriority AS predicate,
    CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) AS object_value,
    CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS as_of, (o_orderkey % 13) / 10.0 AS confidence,
    CAST(NULL AS DATE) AS valid_to, CAST(NULL AS BIGINT) AS superseded_by,
    CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey % 100 END AS source_chunk_id, o_orderkey % 7 AS document_id,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'total ' || CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) END AS evidence
  FROM orders)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers report to the supplier of a third of their key; every fourth also to the next one, later."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation")).where("k > 0")
    third = F.floor(F.col("k") / 3).cast("bigint")
    first = s.select(
        (F.col("k") * 2).alias("id"), F.col("k").alias("from_entity_id"), third.alias("to_entity_id"), F.lit("reports_to").alias("link_type"),
        F.when(F.col("k") % 5 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("k") % 300).cast("int"))).alias("as_of"),
        F.when(F.col("k") % 6 == 0, F.lit("2024-06-30").cast("date")).alias("valid_to"), (F.col("k") % 3).alias("document_id"),
        (F.col("k") % 100).alias("source_chunk_id"),
    )
    second = s.where("k % 4 = 0").select(
        (F.col("k") * 2 + 1).alias("id"), F.col("k").alias("from_entity_id"), (third + 1).alias("to_entity_id"), F.lit("reports_to").alias("link_type"),
        F.lit("2024-09-01").cast("date").alias("as_of"), F.lit(None).cast("date").alias("valid_to"), (F.col("k") % 2).alias("document_id"),
        (F.col("k") % 50).alias("source_chunk_id"),
    )
    return first.unionByName(second)


LINKS = """links AS (
  SELECT s_suppkey * 2 AS id, s_suppkey AS from_entity_id, s_suppkey // 3 AS to_entity_id, 'reports_to' AS link_type,
    CASE WHEN s_suppkey % 5 <> 0 THEN DATE '2024-01-01' + CAST(s_suppkey % 300 AS INTEGER) END AS as_of,
    CASE WHEN s_suppkey % 6 = 0 THEN DATE '2024-06-30' END AS valid_to, s_suppkey % 3 AS document_id, s_suppkey % 100 AS source_chunk_id
  FROM supplier WHERE s_suppkey > 0
  UNION ALL
  SELECT s_suppkey * 2 + 1, s_suppkey, s_suppkey // 3 + 1, 'reports_to', DATE '2024-09-01', NULL, s_suppkey % 2, s_suppkey % 50
  FROM supplier WHERE s_suppkey > 0 AND s_suppkey % 4 = 0)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("source_uri"),
        "lang", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("as_of"), F.col("text").alias("raw_text"),
    )


DOCUMENTS = """docs AS (
  SELECT doc_id AS id, 'corpus/' || source || '/' || CAST(doc_id AS VARCHAR) AS source_uri, lang,
    DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS as_of, text AS raw_text FROM documents)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that have a word, as chunks; ids pack the document and the line."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    return d.where(F.trim("text") != "").select(
        (F.col("doc_id") * 100000 + F.col("ordinal")).alias("id"), F.col("doc_id").alias("document_id"), "ordinal", "text"
    )


CHUNKS = """chunks AS (
  SELECT doc_id * 100000 + ordinal AS id, doc_id AS document_id, ordinal, text FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS ordinal FROM documents)
  WHERE trim(text) <> '')"""
