"""Ranked retrieval: vectors, words, and their fusion by reciprocal rank."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text

RRF = 60


def vector_topk(chunks: DataFrame, query: list[float], k: int, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, score): the ``k`` nearest by cosine; rows without a vector, or with a zero one, have no score."""
    score = text.cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    return chunks.select(F.col(id_col).alias("id"), score.alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), "id").limit(k)


def tokens(column: Column) -> Column:
    """Lower-case letter and digit runs."""
    return F.filter(F.split(F.lower(column), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != "")


def lexical_topk(chunks: DataFrame, query: str, k: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, score): rows that have all words of the query, by their count over 1 + ln of the length."""
    wanted = sorted({w for w in re.split(r"[\W_]+", query.lower()) if w})
    if not wanted:
        return chunks.sparkSession.createDataFrame([], "id bigint, score double")
    own = chunks.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))
    words = F.array(*map(F.lit, wanted))
    hits = F.size(F.filter("t", lambda w: F.array_contains(words, w)))
    return (
        own.where(F.size(F.array_except(words, F.col("t"))) == 0)
        .select("id", (hits / (1.0 + F.log(F.size("t").cast("double")))).alias("score"))
        .orderBy(F.desc("score"), "id")
        .limit(k)
    )


def fuse(lists: list[DataFrame], k: int, constant: int = RRF) -> DataFrame:
    """(id, score) of ranked (id, score) lists by the sum of 1 / (constant + rank)."""
    ranked = []
    for one in lists:  # each is at most a top-k list
        order = Window.orderBy(F.desc("score"), "id")
        ranked.append(one.select("id", (F.lit(1.0) / (constant + F.row_number().over(order))).alias("part")))
    every = ranked[0]
    for more in ranked[1:]:
        every = every.unionByName(more)
    return every.groupBy("id").agg(F.sum("part").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def hybrid(chunks: DataFrame, query: str, vector: list[float], k: int = 8, id_col: str = "id") -> DataFrame:
    """Both lists cut to ``k`` before they are fused."""
    return fuse([vector_topk(chunks, vector, k, id_col), lexical_topk(chunks, query, k, id_col)], k)
