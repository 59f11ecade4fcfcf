"""A store that changes at once or not at all."""

import pytest
from pyspark.sql import functions as F

from tidemark.commits import Conflict, Store
from tidemark.operators import contradictions, temporal


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def claims(spark, rows):
    made = spark.createDataFrame(rows, "subject_entity_id bigint, predicate string, object_value string, source_chunk_id bigint, as_of string, arrived int")
    return made.withColumn("as_of", F.col("as_of").cast("date")).withColumn("document_id", F.lit(1).cast("bigint"))


FIRST = [(1, "p", "1", 1, "2024-01-01", 1), (1, "p", "2", 1, "2024-01-02", 2), (1, "p", "1", 1, "2024-01-03", 3), (None, "q", None, None, None, 4)]


def test_repeated_writes_change_nothing(spark, store):
    assert store.version() == 0 and store.read("claims").count() == 0
    assert store.insert("claims", claims(spark, FIRST), ["arrived"]) == 1
    before = sorted(tuple(r) for r in store.read("claims").select("id", "predicate", "object_value").collect())
    assert before == [(1, "p", "1"), (2, "p", "2"), (3, "q", None)]
    assert store.insert("claims", claims(spark, FIRST[::-1]), ["arrived"]) == 1
    assert store.insert("claims", claims(spark, [(1, "p", "1", 2, None, 5), FIRST[0]]), ["arrived"]) == 2
    assert {r["id"] for r in store.read("claims").collect()} == {1, 2, 3, 4}
    assert store.read("claims", 1).count() == 3 and store.unnamed() == []


def test_a_lost_writer_leaves_the_old_state(spark, store):
    store.insert("claims", claims(spark, FIRST), ["arrived"])
    broken = claims(spark, [(9, "p", "9", 9, None, 1)]).withColumn("predicate", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        store.commit(added={"links": spark.range(3).select(F.col("id").alias("from_entity_id")), "claims": broken})
    assert store.version() == 1 and store.read("claims").count() == 3 and store.read("links").count() == 0
    store._publish, publish = lambda manifest: (_ for _ in ()).throw(KeyboardInterrupt()), store._publish
    with pytest.raises(KeyboardInterrupt):  # all is staged, but the manifest is not in place
        store.commit(added={"claims": claims(spark, FIRST[:1])})
    store._publish = publish
    assert Store(spark, store.root).version() == 1 and store.read("claims").count() == 3 and store.unnamed()


def test_two_writers(spark, store):
    store.insert("claims", claims(spark, FIRST), ["arrived"])
    other = Store(spark, store.root)
    base = other.version()
    store.replace("links", spark.range(2))
    with pytest.raises(Conflict):
        other.commit(added={"claims": claims(spark, FIRST[:1])}, base=base)
    assert store.read("claims").count() == 3


def test_tables_change_together(spark, store):
    store.commit(added={"claims": claims(spark, FIRST).withColumn("id", F.col("arrived").cast("bigint")), "metric_vocab": spark.createDataFrame([("k", "K", ["a"])], "canonical_key string, display_name string, aliases array<string>")})
    base = store.version()
    after = temporal.supersede(store.read("claims", base))
    found = contradictions.first_of_each_conflict(after).withColumn("id", F.monotonically_increasing_id())
    assert store.commit(replaced={"claims": after, "contradictions": found}, base=base) == 2
    assert {r["id"]: r["superseded_by"] for r in store.read("claims").collect()} == {1: 2, 2: 3, 3: None, 4: None}
    assert store.read("claims", 1).where("superseded_by IS NOT NULL").count() == 0
    store.replace("contradictions", None)
    assert store.read("contradictions").count() == 0 and store.read("metric_vocab").count() == 1


def test_steps_of_a_source_count_once(spark, store):
    rows = [claims(spark, [(k, "p", str(k), 1, None, 1)]) for k in range(3)]
    for step in (0, 1, 1, 0, 2, 2):
        store.commit(added={"claims": rows[step].withColumn("id", F.lit(step))}, mark=("stream", step))
    assert sorted(r["id"] for r in store.read("claims").collect()) == [0, 1, 2]


def test_entities_merge(spark, store):
    kind = "canonical_name string, entity_type string, attributes map<string,string>, seeded boolean"
    store.merge_entities(spark.createDataFrame([("Ann", "person", {"role": "CEO"}, True)], kind))
    store.merge_entities(spark.createDataFrame([("Ann", "person", {"role": "CTO", "x": "1"}, False), ("Bob", "person", None, False)], kind))
    rows = {r["canonical_name"]: r for r in store.read("entities").collect()}
    assert rows["Ann"]["attributes"] == {"role": "CTO", "x": "1"} and rows["Ann"]["seeded"] and rows["Bob"]["id"] == 2


def test_a_stream_into_the_store(spark, store, tmp_path):
    source, kind = str(tmp_path / "in"), "subject_entity_id bigint, predicate string, object_value string, source_chunk_id bigint, arrived int"
    for part in ([(1, "p", "1", 1, 1), (1, "p", "1", 1, 2)], [(1, "p", "1", 1, 3), (2, "p", "1", 1, 4)]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
    write = lambda batch, step: store.insert("claims", batch, ["arrived"], ("in", step)) and None
    for k in range(2):  # the second run has lost the stream's checkpoint and repeats all its steps
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / f"state{k}")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted((r["id"], r["subject_entity_id"]) for r in store.read("claims").collect()) == [(1, 1), (2, 2)]
