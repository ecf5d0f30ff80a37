"""Feed history in layers: equal to the history of all snapshots at once, written by change, and the same when a day is run again."""

import os
import random

from pyspark.sql import functions as F

from tidemark.operators import versions
from tidemark.streaming import feeds

SCHEMA = "k long, status string"


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.startswith("part-"))


def land(spark, base, day, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{base}/snapshots/{day}")
    spark.createDataFrame([(day, f"{base}/snapshots/{day}")], "day string, path string").coalesce(1).write.mode("append").json(f"{base}/manifests")


def run(spark, base, progress="progress"):
    feeds.feed_stream(spark, f"{base}/manifests", f"{base}/state", f"{base}/{progress}", ["k"], 3)
    return sorted((r.k, r.status, str(r.first_seen), str(r.last_seen)) for r in feeds.feed_history(spark, f"{base}/state", 3).collect())


def test_as_all_at_once_and_again(spark, tmp_path):
    rng, base = random.Random(4), str(tmp_path)
    days = [f"2024-02-{d:02}" for d in (1, 2, 3, 5, 6, 9, 10, 12)]
    every = []
    for day in days:
        rows = [(k, rng.choice("ab")) for k in range(12) if rng.random() < 0.8]
        land(spark, base, day, rows + rows[:2])
        every += [(day, *r) for r in rows]
    whole = versions.history_of(spark.createDataFrame(every, f"day string, {SCHEMA}").withColumn("day", F.to_date("day")), ["k", "status"])
    want = sorted((r.k, r.status, str(r.first_seen), str(r.last_seen)) for r in whole.collect())
    assert run(spark, base) == want
    written = {d: size(f"{base}/state/{d}") for d in ("opened", "closed", "current")}
    # From no progress, every day is run again over the files that are there.
    os.rename(f"{base}/progress", f"{base}/lost")
    try:
        run(spark, base, "progress")
    except Exception as e:  # days before the newest are refused
        assert "arrived after" in str(e)
    assert sorted((r.k, r.status, str(r.first_seen), str(r.last_seen)) for r in feeds.feed_history(spark, f"{base}/state", 3).collect()) == want
    assert {d: size(f"{base}/state/{d}") for d in written} == written


def test_a_day_writes_its_change(spark, tmp_path):
    """Twenty changed rows of 40,000 cost a day little, however much history there is."""
    base = str(tmp_path)
    rows = {k: f"state {k * 7919 % 100_003}" for k in range(40_000)}
    for d in range(1, 6):
        for k in range(20):
            rows[k * 31 + d] = f"day {d}"
        land(spark, base, f"2024-03-0{d}", list(rows.items()))
    run(spark, base)
    first = size(f"{base}/state/opened/2024-03-01")
    for d in (2, 4, 5):
        assert size(f"{base}/state/opened/2024-03-0{d}") + size(f"{base}/state/closed/2024-03-0{d}") < first / 20
    assert os.listdir(f"{base}/state/current") == ["2024-03-03"]


def test_columns_come_and_go(spark, tmp_path):
    base = str(tmp_path)
    for day, rows, schema in (("2024-01-01", [(1, "a")], SCHEMA), ("2024-01-02", [(1, "a", 5), (2, "b", 6)], f"{SCHEMA}, more int"), ("2024-01-03", [(2, "b")], SCHEMA)):
        spark.createDataFrame(rows, schema).write.parquet(f"{base}/snapshots/{day}")
        spark.createDataFrame([(day, f"{base}/snapshots/{day}")], "day string, path string").coalesce(1).write.mode("append").json(f"{base}/manifests")
    assert run(spark, base) == [(1, "a", "2024-01-01", "2024-01-02"), (2, "b", "2024-01-02", "2024-01-03")]
