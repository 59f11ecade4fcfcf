"""Streams over files that arrive in batches."""

import datetime

from pyspark.sql import functions as F

from tidemark.streaming import upserts

CLAIM = "subject_entity_id bigint, predicate string, object_value string, source_chunk_id bigint, seq bigint, at timestamp"


def rows(spark, data):
    day = datetime.datetime(2026, 1, 1)
    return spark.createDataFrame([(s, "p", v, c, k, day + datetime.timedelta(minutes=m)) for s, v, c, k, m in data], CLAIM)


def test_upserts_are_idempotent(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda n: upserts.upsert_batches(spark.readStream.schema(CLAIM).parquet(source), target, str(tmp_path / f"c{n}"), "seq").trigger(availableNow=True).start().awaitTermination()
    rows(spark, [(1, "a", None, 5, 0), (1, "a", None, 3, 1), (2, "b", 7, 4, 2)]).write.parquet(source)
    run(1)
    assert sorted(r["seq"] for r in spark.read.parquet(target).collect()) == [3, 4]  # the first of a key, nulls alike
    rows(spark, [(2, "b", 7, 1, 3), (3, "c", 1, 9, 4)]).write.mode("append").parquet(source)
    run(1)
    run(2)  # another query replays everything
    assert sorted(r["seq"] for r in spark.read.parquet(target).collect()) == [3, 4, 9]


def test_windows_and_first_arrivals(spark, tmp_path):
    source = str(tmp_path / "in")
    rows(spark, [(1, "a", 1, 1, 0), (1, "a", 1, 2, 3), (1, "b", 1, 3, 12), (2, "c", 1, 4, 400)]).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(CLAIM).parquet(source)
    upserts.first_arrivals(stream, "at", "1 hour").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("firsts").count() == 3
    counted = upserts.windowed_counts(stream, "at", "subject_entity_id", "10 minutes", "1 hour")
    counted.writeStream.format("memory").outputMode("append").queryName("counted").option("checkpointLocation", str(tmp_path / "b")).trigger(availableNow=True).start().awaitTermination()
    found = sorted((r["subject_entity_id"], r["n"]) for r in spark.table("counted").select("subject_entity_id", F.col("n")).collect())
    assert found == [(1, 1), (1, 2)]  # the window of the last row is still open
