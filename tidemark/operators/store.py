"""Lookups and writes over the store's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text

from .citations import of_claims, of_links
from .vocabulary import terms


def document_list(documents: DataFrame) -> DataFrame:
    """The inventory without texts: id, source_uri, source_type, title, lang and the day as text, by id."""
    return documents.select("id", "source_uri", "source_type", "title", "lang", F.col("as_of").cast("string").alias("as_of")).orderBy("id")


def entity_list(entities: DataFrame, entity_type: str | None = None) -> DataFrame:
    """Entities without attributes, by type, name and id; an unknown type has none."""
    own = entities if entity_type is None else entities.where(F.col("entity_type") == entity_type)
    return own.select("id", "canonical_name", "entity_type", "seeded").orderBy("entity_type", "canonical_name", "id")


def metric_list(vocab: DataFrame) -> DataFrame:
    """The vocabulary with sorted aliases, by key."""
    return vocab.select("canonical_key", "display_name", F.array_sort(F.coalesce("aliases", F.array().cast("array<string>"))).alias("aliases")).orderBy("canonical_key")


def known_hashes(documents: DataFrame) -> DataFrame:
    return documents.select("content_hash").where("content_hash IS NOT NULL").distinct()


def claims_of(claims: DataFrame, subject: int, predicate: str | None = None) -> DataFrame:
    """A subject's claims, newest first (undated last), then by id."""
    own = claims.where(F.col("subject_entity_id") == subject)
    own = own if predicate is None else own.where(F.col("predicate") == predicate)
    return own.orderBy(F.col("as_of").desc_nulls_last(), "id")


def contradictions_of(contradictions: DataFrame, subject: int | None = None) -> DataFrame:
    """Contradictions on a subject, all of them without one, by id."""
    own = contradictions if subject is None else contradictions.where(F.col("subject_entity_id") == subject)
    return own.orderBy("id")


def links_where(links: DataFrame, link_type: str | None = None, from_id: int | None = None, to_id: int | None = None) -> DataFrame:
    """Links that meet all of the conditions given, by id."""
    for column, value in (("link_type", link_type), ("from_entity_id", from_id), ("to_entity_id", to_id)):
        links = links if value is None else links.where(F.col(column) == value)
    return links.orderBy("id")


def chunk(chunks: DataFrame, chunk_id: int) -> DataFrame:
    """The chunk with its whole text; no row if there is none."""
    return chunks.where(F.col("id") == chunk_id)


def by_canonical_predicate(claims: DataFrame, vocab: DataFrame, asked: str) -> DataFrame:
    """Claims, superseded ones too, whose predicate means ``asked``, ordered by subject, newest first, id.

    Meant are the term itself, the key it belongs to, and that key's aliases,
    in any case, with or without leading periods.
    """
    known = terms(vocab)
    target = known.where(F.col("term") == asked.strip().lower()).select("canonical_key")
    wanted = known.join(target, "canonical_key", "left_semi").select("term").unionByName(
        claims.sparkSession.range(1).select(F.lit(asked.strip().lower()).alias("term"))
    ).distinct()
    forms = F.array_distinct(F.array(F.lower("predicate"), text.strip_period(F.col("predicate"))))
    hits = claims.select("id", F.explode(forms).alias("term")).join(wanted, "term", "left_semi").select("id").distinct()
    own = claims.join(hits, "id", "left_semi")
    return own.orderBy(F.col("subject_entity_id").asc_nulls_last(), F.col("as_of").desc_nulls_last(), "id")


def named(rows: DataFrame, entities: DataFrame, id_col: str, name: str) -> DataFrame:
    """``rows`` with the name of the entity in ``id_col``, null if it is unknown."""
    e = entities.select(F.col("id").alias("_e"), F.col("canonical_name").alias(name))
    return rows.join(e, F.col(id_col) == F.col("_e"), "left").drop("_e")


def cited_claims(claims: DataFrame, chunks: DataFrame, documents: DataFrame, order: str) -> DataFrame:
    """``claims`` with source_uri, snippet and source_as_of of their citation, in the order of a column they have."""
    c = of_claims(claims, chunks, documents).select(F.col("claim_id").alias("_c"), "source_uri", "snippet", F.col("as_of").alias("source_as_of"))
    return claims.join(c, F.col("id") == F.col("_c"), "left").drop("_c").orderBy(order)


def cited_links(links: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``links`` with source_uri, snippet and source_as_of of their citation, by type and id."""
    c = of_links(links, chunks, documents).select(F.col("link_id").alias("_c"), "source_uri", "snippet", F.col("as_of").alias("source_as_of"))
    return links.join(c, F.col("id") == F.col("_c"), "left").drop("_c").orderBy("link_type", "id")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table."""
    out = None
    for name, table in tables.items():
        one = table.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def upsert_metrics(target: DataFrame, rows: DataFrame, arrival: str) -> DataFrame:
    """The vocabulary after ``rows``: of each key the last row to arrive, in place of what was there."""
    last = rows.groupBy("canonical_key").agg(F.max_by(F.struct("display_name", "aliases"), arrival).alias("s"))
    new = last.select("canonical_key", "s.display_name", "s.aliases")
    return target.join(new.select("canonical_key"), "canonical_key", "left_anti").select(new.columns).unionByName(new)


def cleared(rows: DataFrame) -> tuple[DataFrame, int]:
    """An empty table in place of ``rows``, and how many rows that takes away."""
    return rows.limit(0), rows.count()


def checked_vectors(chunks: DataFrame, dimension: int, vector: str = "embedding") -> DataFrame:
    """``chunks``; raises, when a row is evaluated, on a vector of another length or with a component that is no finite number."""
    e = F.col(vector)
    sound = (F.size(e) == dimension) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fault = F.raise_error(F.concat(F.lit("unfit vector of chunk "), F.col("id").cast("string"))).cast("boolean")
    return chunks.where(F.when(e.isNull() | sound, True).otherwise(fault))


def from_sources(rows: DataFrame, manifest: DataFrame, column: str = "source_uri") -> DataFrame:
    """Rows of sources that the manifest (source_uri) lists."""
    return rows.join(manifest.select(F.col("source_uri").alias(column)).distinct(), column, "left_semi")


def trimmed_sources(rows: DataFrame, manifest: DataFrame, column: str = "sources") -> DataFrame:
    """``rows`` whose array of sources keeps the listed ones in order; rows left without any are gone."""
    listed = manifest.select(F.col("source_uri").alias("_s")).distinct()
    spread = rows.select("id", F.posexplode(column).alias("_k", "_s")).join(listed, "_s", "left_semi")
    kept = spread.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_s"))), lambda x: x["_s"]).alias(column))
    return rows.drop(column).join(kept, "id").select(rows.columns)


def parse_day(given: Column) -> Column:
    """An ISO date; null if it is blank; raises on anything else."""
    iso = F.when(F.trim(given).rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.trim(given).try_cast("date"))
    fault = F.raise_error(F.concat(F.lit("not an ISO date: "), given)).cast("date")
    return F.when(F.coalesce(F.trim(given), F.lit("")) == "", F.lit(None).cast("date")).when(iso.isNotNull(), iso).otherwise(fault)


def fresh_ids(rows: DataFrame, missing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``rows`` whose keys the table ``missing`` lacks: what a cache has still to record."""
    return rows.join(missing.select(*keys).distinct(), keys, "left_anti")


def as_json(rows: DataFrame) -> DataFrame:
    """(json) of each row; nulls are written."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


def numbered(rows: DataFrame, group: str, order: list[str], prefix: str) -> DataFrame:
    """``rows`` with marker, the prefix and the place from 1 within the group.  Groups are capped lists."""
    k = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("marker", F.concat(F.lit(prefix), k.cast("string")))
