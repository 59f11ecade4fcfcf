"""Tables of the ontology store, as DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "documents": "id BIGINT, source_uri STRING, source_type STRING, title STRING, author STRING, lang STRING, as_of DATE, "
    "ingested_at TIMESTAMP, content_hash STRING, raw_text STRING",
    "chunks": "id BIGINT, document_id BIGINT, ordinal INT, text STRING, embedding ARRAY<FLOAT>",
    "entities": "id BIGINT, canonical_name STRING, entity_type STRING, attributes MAP<STRING,STRING>, seeded BOOLEAN",
    "entity_aliases": "id BIGINT, entity_id BIGINT, alias STRING, source_chunk_id BIGINT",
    "metric_vocab": "canonical_key STRING, display_name STRING, aliases ARRAY<STRING>",
    "claims": "id BIGINT, subject_entity_id BIGINT, predicate STRING, object_value STRING, object_entity_id BIGINT, as_of DATE, "
    "confidence FLOAT, valid_from DATE, valid_to DATE, superseded_by BIGINT, source_chunk_id BIGINT, document_id BIGINT, "
    "evidence STRING, char_start INT, char_end INT",
    "links": "id BIGINT, from_entity_id BIGINT, to_entity_id BIGINT, link_type STRING, as_of DATE, valid_to DATE, "
    "confidence FLOAT, source_chunk_id BIGINT, document_id BIGINT, raw_verb STRING",
    "contradictions": "id BIGINT, subject_entity_id BIGINT, predicate STRING, claim_a_id BIGINT, claim_b_id BIGINT, kind STRING, "
    "note STRING, detected_at TIMESTAMP, link_a_id BIGINT, link_b_id BIGINT",
}

#: Natural key of each table; its rows are unique by it, nulls compared as equal.
KEYS = {
    "documents": ["content_hash"],
    "chunks": ["document_id", "ordinal"],
    "entities": ["canonical_name", "entity_type"],
    "entity_aliases": ["entity_id", "alias"],
    "metric_vocab": ["canonical_key"],
    "claims": ["subject_entity_id", "predicate", "object_value", "source_chunk_id"],
    "links": ["from_entity_id", "to_entity_id", "link_type", "as_of"],
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def create(spark: SparkSession, database: str) -> list[str]:
    """Creates what is missing of the store's tables, as Parquet, and returns the names of all of them."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({columns}) USING parquet")
    return sorted(r["tableName"] for r in spark.sql(f"SHOW TABLES IN `{database}`").collect())
