"""From facts to the documents they came from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text


def _cited(facts: DataFrame, chunks: DataFrame, documents: DataFrame, kind: str) -> DataFrame:
    f = facts.alias("f")
    c = chunks.select(F.col("id").alias("chunk_id"), F.col("document_id").alias("_cd"), F.col("text").alias("_ct")).alias("c")
    d = documents.select(F.col("id").alias("doc_id"), "source_uri", F.col("as_of").alias("_da")).alias("d")
    return (
        f.join(c, F.col("f.source_chunk_id") == F.col("c.chunk_id"), "left")
        .join(d, F.coalesce("f.document_id", "c._cd") == F.col("d.doc_id"), "left")
        .select(
            F.col("f.id").alias(f"{kind}_id"), "chunk_id", "doc_id", "source_uri",
            F.coalesce("f.as_of", "d._da").alias("as_of"), text.snippet(F.col("_ct")).alias("snippet"),
        )
    )


def of_claims(claims: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Claims that have a chunk or a document."""
    return _cited(claims, chunks, documents, "claim").where("chunk_id IS NOT NULL OR doc_id IS NOT NULL")


def of_links(links: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Links that have a document."""
    return _cited(links, chunks, documents, "link").where("doc_id IS NOT NULL")


def of_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    d = documents.select(F.col("id").alias("doc_id"), "source_uri", "as_of")
    return chunks.join(d, chunks["document_id"] == d["doc_id"]).select(
        chunks["id"].alias("chunk_id"), "doc_id", "source_uri", "as_of", text.snippet(chunks["text"]).alias("snippet")
    )


def enforce(sentences: DataFrame, citations: DataFrame) -> DataFrame:
    """Sentences (pos, sentence) of which a marker like [C12] names a citation (marker), with their markers in order."""
    marked = sentences.select(
        "pos", "sentence", F.explode(F.regexp_extract_all("sentence", F.lit(r"\[([CSL]\d+)\]"))).alias("marker")
    )
    known = marked.join(citations.select("marker").distinct(), "marker", "left_semi")
    return known.groupBy("pos", "sentence").agg(F.array_sort(F.collect_set("marker")).alias("markers"))
