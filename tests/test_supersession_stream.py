"""Supersession over a stream equals that over a table, whatever the order of arrival."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import temporal
from tidemark.streaming import supersession

CLAIM = "id bigint, subject_entity_id bigint, predicate string, object_value string, as_of date, valid_to date, superseded_by bigint, document_id bigint"
DAY = datetime.date(2024, 1, 1)


def claim(i, subject, value, day, source=1):
    return (i, subject, "p", value, None if day is None else DAY + datetime.timedelta(day), None, None, source)


def run(spark, folder, name, delay):
    stream = spark.readStream.schema(CLAIM).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    made = supersession.superseded(stream, delay)
    made.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/c-{name}").trigger(availableNow=True).start().awaitTermination()
    return {(r["id"], r["superseded_by"], r["valid_to"]) for r in spark.read.schema("id bigint, superseded_by bigint, valid_to date").parquet(f"{folder}/{name}").collect()}


def in_table(spark, rows):
    found = temporal.supersede(spark.createDataFrame(rows, CLAIM)).where("superseded_by IS NOT NULL")
    return {(r["id"], r["superseded_by"], r["valid_to"]) for r in found.collect()}


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, CLAIM).coalesce(1).write.mode("append").parquet(f"{folder}/in")


@pytest.mark.parametrize("seed", range(2))
def test_equals_the_table(spark, tmp_path, seed):
    rng = random.Random(seed)
    values = ["1", "2", "1.0", "SGD 3", "3", "plan b", None, "1.0000000000001"]
    rows = [claim(i, rng.randrange(4), rng.choice(values), rng.choice([None, *range(20)]), rng.choice([1, 2, None])) for i in rng.sample(range(1000), 150)]
    for part in range(3):
        arrive(spark, tmp_path, rows[part::3] + rows[:5])  # five rows arrive again and again
    arrive(spark, tmp_path, [claim(5000, 99, "x", 400)])  # the watermark passes all days
    got = run(spark, tmp_path, "out", "60 days")
    assert got == in_table(spark, rows) and len(got) > 30


def test_late_claims(spark, tmp_path):
    late = claim(3, 1, "c", 12)
    first = [claim(1, 1, "a", 10), claim(2, 1, "b", 20)]
    arrive(spark, tmp_path, first)
    assert run(spark, tmp_path, "out", "30 days") == set()  # an earlier answer could still arrive
    arrive(spark, tmp_path, [late])
    run(spark, tmp_path, "out", "30 days")
    arrive(spark, tmp_path, [claim(4, 99, "x", 100)])
    got = run(spark, tmp_path, "out", "30 days")
    assert got == in_table(spark, [*first, late]) == {(1, 3, DAY + datetime.timedelta(12)), (3, 2, DAY + datetime.timedelta(20))}
    arrive(spark, tmp_path, [claim(5, 1, "d", 15), first[0], claim(6, 1, "d", 90)])  # beyond the delay, again, and in time
    run(spark, tmp_path, "out", "30 days")
    arrive(spark, tmp_path, [claim(7, 99, "x", 200)])
    assert run(spark, tmp_path, "out", "30 days") - got == {(2, 6, DAY + datetime.timedelta(90))}


@pytest.mark.parametrize("seed", range(30))
def test_days_in_one_pass(seed):
    rng = random.Random(seed)
    claims = sorted((rng.randrange(8), i, v, None) for i, v in ((i, rng.choice("ab")) for i in range(12)))
    want = {}
    for c in claims:
        later = [x for x in claims if x[0] > c[0] and x[2] != c[2]]
        if later:
            want[c[1]] = (later[0][1], later[0][0])
    assert supersession.superseding(claims) == want


def test_midnight_is_utc(spark):
    assert spark.range(1).select(F.unix_seconds(supersession.day_time(F.lit(DAY))).alias("s")).first()["s"] == 1704067200
