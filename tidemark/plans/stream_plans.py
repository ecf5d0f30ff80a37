"""Streams over the given tables, run to what has arrived, with SQL for their final state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.lineage import shared_dir
from tidemark.plans.common import table
from tidemark.plans.version_plans import DAYS, HISTORY, _label, _snapshot
from tidemark.streaming import feeds

P, SQL = {}, {}


def folder(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder, or in a temporary one where the master is local and the session names none."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def streamed(spark, d, name) -> DataFrame:
    """A table as a stream of its files. The path is a pattern, as a stream's plain path must be a folder."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def _final(spark, stream: DataFrame, mode: str = "complete", key: str | None = None) -> DataFrame:
    """What a stream's last batch wrote; of an appending one, what all did; of an updating one, the last row of each key."""
    out = folder(spark, "stream")
    kept = {}

    def each(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/{number}")
        kept["last"] = f"{out}/{number}"

    feeds.drain(stream, each, folder(spark, "progress"), mode)
    rows = spark.read.parquet(f"{out}/*" if mode != "complete" else kept["last"])
    if mode == "update":
        rest = [c for c in rows.columns if c not in (key, "_batch")]
        rows = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "_batch").alias("_x")).select(key, "_x.*")
    return rows.drop("_batch")


def _feed(spark, d):
    base = folder(spark, "feed")
    for i, day in enumerate(DAYS):
        _snapshot(spark, d, i).write.parquet(f"{base}/snapshots/{day}")
        spark.createDataFrame([(day, f"{base}/snapshots/{day}")], "day string, path string").coalesce(1).write.mode("append").json(f"{base}/manifests")
        feeds.feed_stream(spark, f"{base}/manifests", f"{base}/state", f"{base}/progress", ["user_id"])
    return feeds.feed_history(spark, f"{base}/state")


P["t01_feed_stream"] = _feed
SQL["t01_feed_stream"] = f"SELECT * FROM {HISTORY}"
P["t02_state_per_key"] = lambda s, d: _final(s, feeds.state_by_key(streamed(s, d, "events").select("user_id", "event_type", "event_id"), "user_id", "event_type", "event_id"), "update", "user_id")
SQL["t02_state_per_key"] = """WITH e AS (SELECT *, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS starts FROM events),
 g AS (SELECT *, sum(starts::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e), r AS (SELECT user_id, run, any_value(event_type) AS status, min(event_id) AS first_seen, max(event_id) AS last_seen FROM g GROUP BY 1, 2)
 SELECT user_id, status, first_seen, last_seen FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY run DESC) AS k FROM r) WHERE k = 1"""


def _late(spark, d):
    out = folder(spark, "late")

    def each(batch: DataFrame, number: int) -> None:
        on_time, late = feeds.split_late(batch, "day", "month", 2, "1998-03-10")
        on_time.groupBy("period").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/on_time/{number}")
        late.groupBy("period").agg(F.count("*").alias("n"), F.bool_and("revision").alias("revision")).write.mode("overwrite").parquet(f"{out}/late/{number}")

    feeds.drain(streamed(spark, d, "orders").withColumn("day", F.to_date("o_orderdate")), each, folder(spark, "progress"))
    late = spark.read.parquet(f"{out}/late/*")
    return late.groupBy("period").agg(F.sum("n").alias("n"), F.bool_and("revision").alias("revision"))


P["t03_late_rows"] = _late
SQL["t03_late_rows"] = f"SELECT {_label('month', 'o_orderdate')} AS period, count(*) AS n, true AS revision FROM orders WHERE {_label('month', 'o_orderdate')} < '1998-02' GROUP BY 1"
P["t04_period_tumbling"] = lambda s, d: feeds.period_totals(_final(s, feeds.period_counts(streamed(s, d, "events"), "ts", "quarter", "value"))).withColumn("total", F.round("total", 6))
SQL["t04_period_tumbling"] = f"SELECT {_label('quarter', 'ts')} AS period, count(*) AS n, round(fsum(value), 6) AS total FROM events GROUP BY 1"
P["t05_once_per_day"] = lambda s, d: _final(s, feeds.once_a_day(streamed(s, d, "events").withColumn("at", F.col("ts").cast("timestamp")), "at", ["user_id"]).select("user_id", "day"), "append")
SQL["t05_once_per_day"] = "SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events"
P["t06_usage_stream"] = lambda s, d: _final(s, feeds.usage(streamed(s, d, "events").select(F.when(F.col("event_id") % 50 == 0, F.lit('{"event": "cut')).otherwise(F.to_json(F.struct(F.col("event_type").alias("event"), "user_id"))).alias("line"))))
SQL["t06_usage_stream"] = "SELECT CASE WHEN event_id % 50 = 0 THEN 'unreadable' ELSE event_type END AS class, count(*) AS n FROM events GROUP BY 1"
