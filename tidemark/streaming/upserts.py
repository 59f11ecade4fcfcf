"""Claims as a stream: idempotent arrival and supersession in event time."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schemas import KEYS


def first_arrivals(stream: DataFrame, event_time: str, delay: str, keys: list[str] = KEYS["claims"]) -> DataFrame:
    """The first row of each key; state is dropped once the watermark has passed."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, event_time: str, group: str, window: str, delay: str) -> DataFrame:
    """Rows by window and group, final once the watermark has passed the window."""
    own = stream.withWatermark(event_time, delay)
    return own.groupBy(F.window(event_time, window), group).agg(F.count("*").alias("n"))


def upsert_batches(stream: DataFrame, target: str, checkpoint: str, arrival: str, keys: list[str] = KEYS["claims"]):
    """A query that appends, batch by batch, rows whose key the Parquet table ``target`` lacks; replays add nothing.

    Of a batch's rows with one key the first by ``arrival`` counts.  The table
    is made by the first batch.  It is partitioned by a hash of the key
    (column bucket), and a batch reads only the buckets that its keys fall in.
    """
    buckets = 64
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        order = F.row_number().over(Window.partitionBy(*keys).orderBy(arrival))
        first = batch.withColumn("_k", order).where("_k = 1").drop("_k").withColumn("bucket", bucket)
        try:
            there = spark.read.schema(first.schema).parquet(target)
        except AnalysisException:  # the first batch
            first.write.mode("append").partitionBy("bucket").parquet(target)
            return
        used = [r["bucket"] for r in first.select("bucket").distinct().collect()]  # at most ``buckets``
        same = F.col("n.bucket") == F.col("t.bucket")
        for k in keys:
            same = same & F.col(f"n.{k}").eqNullSafe(F.col(f"t.{k}"))
        known = there.where(F.col("bucket").isin(used)).select(*keys, "bucket")
        first.alias("n").join(known.alias("t"), same, "left_anti").write.mode("append").partitionBy("bucket").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
