"""What models said, kept so that nobody asks twice: extractions by chunk, verdicts by cluster of facts.

A cache is a store of one table.  What is put in comes whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.commits import Store
from tidemark.lineage import settle

_CLAIM = "STRUCT<subject: STRING, predicate: STRING, object_value: STRING, as_of: STRING, confidence: DOUBLE, evidence: STRING>"
_RELATION = "STRUCT<from_entity: STRING, to_entity: STRING, link_type: STRING, as_of: STRING, confidence: DOUBLE>"
_RULED = "STRUCT<predicate: STRING, claim_a_id: BIGINT, claim_b_id: BIGINT, link_a_id: BIGINT, link_b_id: BIGINT, kind: STRING>"
TABLES = {
    "extractions": f"source_uri STRING, ordinal INT, claims ARRAY<{_CLAIM}>, relations ARRAY<{_RELATION}>",
    "verdicts": f"cluster_key STRING, rows ARRAY<{_RULED}>",
}
KEYS = {"extractions": ["source_uri", "ordinal"], "verdicts": ["cluster_key"]}


class Cache:
    """The cache of that name (see TABLES) in a folder that the driver and all executors see."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.name, self.keys, self.store = name, KEYS[name], Store(spark, root, {name: TABLES[name]})

    def read(self) -> DataFrame:
        return self.store.read(self.name)

    def put(self, rows: DataFrame, force: bool = False) -> DataFrame:
        """Adds rows whose key is not there yet and returns them; ``force`` records all of them anew, in place of what was there.

        Rows without a whole key are left out; of several with one key the
        least is taken, so that a run done twice says the same.  A forced run
        writes the table anew.  Raises Conflict, and changes nothing, if
        another writer came between.
        """
        base = self.store.version()
        there = self.store.read(self.name, base)
        kinds = StructType.fromDDL(TABLES[self.name])
        others = [f.name for f in kinds if f.name not in self.keys]
        own = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds]).dropna(subset=self.keys)
        one = own.groupBy(*self.keys).agg(F.min(F.struct(*others)).alias("_s")).select(*self.keys, "_s.*")
        fresh = settle(one if force else one.join(there.select(*self.keys), self.keys, "left_anti"))
        if fresh.isEmpty():
            return fresh
        if force:
            kept = there.join(fresh.select(*self.keys), self.keys, "left_anti")
            self.store.commit(replaced={self.name: kept.unionByName(fresh)}, base=base)
        else:
            self.store.commit(added={self.name: fresh}, base=base)
        return fresh

    def missing(self, wanted: DataFrame) -> DataFrame:
        """Keys of ``wanted`` that the cache lacks: what a model has still to be asked."""
        return wanted.select(*self.keys).distinct().join(self.read().select(*self.keys), self.keys, "left_anti")

    def get(self, wanted: DataFrame) -> DataFrame:
        """The rows of all ``wanted`` keys; raises, when a row is evaluated, on one that is missing."""
        found = wanted.select(*self.keys).join(self.read().withColumn("_hit", F.lit(True)), self.keys, "left")
        told = F.concat_ws("#", *[F.col(k).cast("string") for k in self.keys])
        fault = F.raise_error(F.concat(F.lit("not cached: "), told)).cast("boolean")
        return found.where(F.when(F.col("_hit"), True).otherwise(fault)).drop("_hit")


def fingerprint(found: DataFrame) -> DataFrame:
    """(source_uri, digest): the SHA-256 of the bytes (content) of each source, by which a proof says what it was made from."""
    return found.select("source_uri", F.sha2("content", 256).alias("digest"))


def stale(proved: DataFrame, now: DataFrame) -> DataFrame:
    """(source_uri, fault) where two fingerprints differ: changed, gone (only in the proof) or new; no row means that the proof holds."""
    a, b = (x.select("source_uri", F.col("digest").alias(n)) for x, n in ((proved, "_a"), (now, "_b")))
    both = a.join(b, "source_uri", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.select("source_uri", F.when(F.col("_b").isNull(), "gone").when(F.col("_a").isNull(), "new").otherwise("changed").alias("fault"))
