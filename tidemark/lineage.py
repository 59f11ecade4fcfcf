"""Checkpoints: results that later steps read again, kept where every executor sees them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: So many rows that a large table is asked for are sent to all tasks that read it; more are joined by shuffles.
BROADCAST_ROWS = 100_000


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a checkpoint in the folder that ``spark.checkpoint.dir`` names.

    Only a local master may do without that setting; it gets a temporary folder.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint(eager=True)


def few(df: DataFrame) -> DataFrame:
    """``df`` settled, and sent to all tasks of a join if its rows are few."""
    df = settle(df)
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a written table beside the checkpoints, where every executor sees it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        settle(spark.range(0))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
