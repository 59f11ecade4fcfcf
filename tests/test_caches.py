"""Caches of what models said, and fingerprints of what a proof was made from."""

import pytest
from pyspark.sql import functions as F

from tidemark.caches import Cache, fingerprint, stale
from tidemark.commits import Conflict

KEY = "source_uri string, ordinal int"


def extracted(spark, rows):
    made = spark.createDataFrame(rows, f"{KEY}, value string")
    claim = F.struct(F.lit("a").alias("subject"), F.lit("p").alias("predicate"), F.col("value").alias("object_value"), F.lit(None).cast("string").alias("as_of"), F.lit(1.0).alias("confidence"), F.lit("e").alias("evidence"))
    none = F.array().cast("array<struct<from_entity:string,to_entity:string,link_type:string,as_of:string,confidence:double>>")
    return made.select("source_uri", "ordinal", F.array(claim).alias("claims"), none.alias("relations"), F.lit(1).alias("extra"))


def told(rows):
    return sorted((r["source_uri"], r["ordinal"], r["claims"][0]["object_value"]) for r in rows.collect())


def test_what_is_there_stays_unless_forced(spark, tmp_path):
    cache = Cache(spark, str(tmp_path / "x"), "extractions")
    assert cache.read().count() == 0
    assert told(cache.put(extracted(spark, [("a", 0, "2"), ("a", 0, "1"), (None, 1, "0"), ("a", None, "0")]))) == [("a", 0, "1")]
    assert told(cache.put(extracted(spark, [("a", 0, "9"), ("b", 0, "3")]))) == [("b", 0, "3")] and cache.store.version() == 2
    assert cache.put(extracted(spark, [("a", 0, "9")])).count() == 0 and cache.store.version() == 2
    assert told(cache.put(extracted(spark, [("a", 0, "9"), ("c", 2, "4")]), force=True)) == [("a", 0, "9"), ("c", 2, "4")]
    assert told(cache.read()) == [("a", 0, "9"), ("b", 0, "3"), ("c", 2, "4")]
    wanted = spark.createDataFrame([("a", 0), ("d", 1), ("d", 1)], KEY)
    assert [tuple(r) for r in cache.missing(wanted).collect()] == [("d", 1)]
    assert told(cache.get(wanted.where("ordinal = 0"))) == [("a", 0, "9")]
    with pytest.raises(Exception, match="not cached: d#1"):
        cache.get(wanted).collect()


def test_a_failed_or_overtaken_put_changes_nothing(spark, tmp_path):
    cache = Cache(spark, str(tmp_path / "x"), "extractions")
    cache.put(extracted(spark, [("a", 0, "1")]))
    with pytest.raises(Exception, match="lost"):
        cache.put(extracted(spark, [("b", 0, "1"), ("c", 0, "1")]).withColumn("ordinal", F.when(F.col("source_uri") == "c", F.raise_error(F.lit("lost")).cast("int")).otherwise(0)))
    other, commit = Cache(spark, str(tmp_path / "x"), "extractions"), cache.store.commit

    def late(**more):
        other.put(extracted(spark, [("z", 0, "1")]))
        return commit(**more)

    cache.store.commit = late
    with pytest.raises(Conflict):
        cache.put(extracted(spark, [("b", 0, "1")]))
    assert told(other.read()) == [("a", 0, "1"), ("z", 0, "1")]


def test_verdicts_may_be_empty_and_are_final(spark, tmp_path):
    cache = Cache(spark, str(tmp_path / "v"), "verdicts")
    row = "named_struct('predicate', 'p', 'claim_a_id', 1L, 'claim_b_id', 2L, 'link_a_id', null, 'link_b_id', null, 'kind', 'temporal')"
    cache.put(spark.sql(f"SELECT 'k' AS cluster_key, array({row}) AS rows UNION ALL SELECT 'e', slice(array({row}), 1, 0)"))
    assert cache.put(spark.sql(f"SELECT 'e' AS cluster_key, array({row}) AS rows")).count() == 0
    assert {r["cluster_key"]: len(r["rows"]) for r in cache.read().collect()} == {"k": 1, "e": 0}


def test_fingerprints(spark):
    rows = lambda *x: fingerprint(spark.createDataFrame(list(x), "source_uri string, content binary"))
    old = rows(("a", b"1"), ("b", b"2"), ("c", b""), ("d", None))
    assert stale(old, old).count() == 0
    found = stale(old, rows(("a", b"1"), ("b", b"3"), ("e", b""))).where("source_uri <> 'd'")
    assert sorted(tuple(r) for r in found.collect()) == [("b", "changed"), ("c", "gone"), ("e", "new")]
