"""Stays from a stream with late, absent and returning keys, against the history of whole days."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import versions
from tidemark.streaming import stays

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept) if kept else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_as_the_history_of_days(spark, tmp_path, rocks):
    rng = random.Random(3)
    days = [f"2024-05-{d:02}" for d in range(1, 11)]
    seen = [(k, rng.choice("ab"), day) for day in days for k in range(6) if rng.random() < 0.75]
    late = [r for r in seen if rng.random() < 0.3]
    batches = [[] for _ in range(5)]
    for r in seen:
        n = days.index(r[2]) // 2
        batches[min(4, n + (r in late))].append(r)
    # Two rows of a later time move the watermark past all others: timers fire in the batch after it has moved.
    batches[4].append((99, "end", "2024-07-01"))
    batches.append([(99, "end", "2024-07-02")])
    want = versions.history_of(spark.createDataFrame(seen, "k long, status string, day string").withColumn("day", F.to_date("day")), ["k", "status"])
    want = sorted((r.k, r.status, str(r.first_seen), str(r.last_seen)) for r in want.collect())
    for batch in batches:
        rng.shuffle(batch)
        spark.createDataFrame(batch, "k long, status string, day string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k long, status string, day string").parquet(str(tmp_path / "in")).withColumn("at", F.to_timestamp("day"))
        out = stays.stays_by_key(stream, "k", "status", "at", 1, "4 days")
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.k, r.status, str(r.first_seen.date()), str(r.last_seen.date())) for r in got.collect()) == want
