"""Predicates by their canonical keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text


def terms(vocab: DataFrame) -> DataFrame:
    """(term, canonical_key): keys and aliases in lower case; a term of several keys has the least."""
    own = F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("canonical_key"))
    every = vocab.select("canonical_key", F.explode(own).alias("term"))
    return every.groupBy(F.lower("term").alias("term")).agg(F.min("canonical_key").alias("canonical_key"))


def canonical(rows: DataFrame, vocab: DataFrame, column: str = "predicate") -> DataFrame:
    """``rows`` with canonical_predicate: the key of the predicate, else of it without leading periods, else itself.

    Terms are unique, so the joins add no rows; unknown and null predicates stay as they are.
    """
    t = terms(vocab)
    whole = t.select(F.col("term").alias("_whole"), F.col("canonical_key").alias("_key"))
    bare = t.select(F.col("term").alias("_bare"), F.col("canonical_key").alias("_bare_key"))
    joined = rows.join(whole, F.lower(F.trim(F.col(column))) == F.col("_whole"), "left").join(
        bare, text.strip_period(F.col(column)) == F.col("_bare"), "left"
    )
    named = joined.withColumn("canonical_predicate", F.coalesce("_key", "_bare_key", column))
    return named.drop("_whole", "_key", "_bare", "_bare_key")
