"""Connected components by repeated contraction, for the near-duplicate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Near copies form stars and short chains, which a few plain rounds contract at less cost.
PLAIN_ROUNDS = 3


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the least node of its component.

    Each round maps a node to the least node among itself and its neighbours,
    then contracts the edges along that map and drops loops and repeats.  From
    the fourth round on the map is first followed to its ends by doubling; an
    end takes in at least one other node, so such a round at least halves a
    component, chains included.  All of it is joins and partial minima, and hubs are ordinary keys that adaptive skew joins can
    split.  No edges: no rows.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    pairs = settle(pairs)
    found, rounds = None, 0
    while not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("to")))
        rounds += 1
        while rounds > PLAIN_ROUNDS:  # what is left holds chains: each pass doubles the steps that the map takes
            ahead = least.select(F.col("node").alias("_n"), F.col("to").alias("_far"))
            further = settle(least.join(ahead, F.col("to") == F.col("_n")).select("node", "to", "_far"))
            if further.where(F.col("to") != F.col("_far")).isEmpty():
                break
            least = further.select("node", F.col("_far").alias("to"))
        if found is None:
            found = least.withColumnRenamed("to", "component")
        else:
            step = least.select(F.col("node").alias("_n"), "to")
            found = settle(
                found.join(step, F.col("component") == F.col("_n"), "left").select(
                    "node", F.coalesce("to", "component").alias("component")
                )
            )
        left = least.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = least.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        pairs = settle(
            pairs.join(left, "a").join(right, "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .where("a <> b").distinct()
        )
    if found is None:
        return spark.createDataFrame([], f"node {edges.schema[a].dataType.simpleString()}, component {edges.schema[a].dataType.simpleString()}")
    return found
