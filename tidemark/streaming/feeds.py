"""Streams: feed history snapshot by snapshot, state by key, late rows, counts by period, one fetch a day, usage counts."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tidemark.operators.catalogue import usage_counts
from tidemark.operators.exact import merged, partials
from tidemark.operators.versions import change_log, finished, period, row_key


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run all that has arrived, batch by batch, and stop; the next call goes on from there."""
    query = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def feed_stream(spark: SparkSession, manifests: str, state: str, checkpoint: str, key: list[str], every: int = 8) -> None:
    """Each arriving manifest (JSON: day, path of a whole snapshot) advances the feed's history and writes its change log.

    A row's absence shows only against a whole snapshot, so a batch takes manifests day by day. A day writes what it changed and nothing else: the states
    that began (state/opened/<day>), those that it found gone, closed for good (state/closed/<day>), and its change log (state/log/<day>). The current states are the
    newest whole list of them (state/current/<day>, written every `every` days) with what was opened and without what was closed since. A day is
    made of files of days before it alone and overwrites its own, so a batch that is run again writes what it wrote before. Days must arrive in order: a
    snapshot of a day before the newest one read would not enter the later histories, and is refused.
    """
    arriving = spark.readStream.schema("day string, path string").option("maxFilesPerTrigger", 1).json(manifests)

    def each(batch: DataFrame, number: int) -> None:
        for row in batch.orderBy("day").collect():  # manifests: one file's few lines
            snapshot = spark.read.parquet(row.path)
            days = sorted(r.day for r in _days(spark, state))
            if days and days[-1] > row.day:
                raise ValueError(f"snapshot of {row.day} arrived after that of {days[-1]}")
            done = [x for x in days if x < row.day]
            held = _current(spark, state, done, every)
            opened, closed = day_change(held, snapshot, row.day, done[-1] if done else None)
            log = change_log(held.drop("_state", "first_seen") if done else None, snapshot, key)
            opened.write.mode("overwrite").parquet(f"{state}/opened/{row.day}")
            closed.write.mode("overwrite").parquet(f"{state}/closed/{row.day}")
            log.withColumn("day", F.lit(row.day)).write.mode("overwrite").json(f"{state}/log/{row.day}")
            if len(done) % every == every - 1:
                _since(spark, state, [*done, row.day], _whole(done, every)).write.mode("overwrite").parquet(f"{state}/current/{row.day}")
            spark.createDataFrame([(row.day,)], "day string").write.mode("overwrite").json(f"{state}/days/{row.day}")

    drain(arriving, each, checkpoint)


def day_change(held: DataFrame | None, snapshot: DataFrame, day: str, last: str | None) -> tuple[DataFrame, DataFrame]:
    """(states that begin on a day, states that end with the fetch before it) against a whole snapshot.

    held: the current states, with first_seen and _state, which tells a stay of a state from all others. States are compared on shared columns.
    """
    seen = snapshot.distinct()
    if held is None:
        opened, closed = seen, None
    else:
        fields = [c for c in snapshot.columns if c in held.columns]
        now, old = snapshot.select(row_key(fields).alias("_h")).distinct(), held.withColumn("_h", row_key(fields))
        opened = seen.withColumn("_h", row_key(fields)).dropDuplicates(["_h"]).join(old.select("_h").distinct(), "_h", "left_anti").drop("_h")
        closed = old.join(now, "_h", "left_anti").drop("_h").withColumn("last_seen", F.lit(last).cast("date"))
    stay = F.struct(row_key(snapshot.columns).alias("row"), F.lit(day).alias("day"))
    opened = opened.select("*", F.lit(day).cast("date").alias("first_seen"), stay.alias("_state"))
    return opened, opened.withColumn("last_seen", F.col("first_seen")).limit(0) if closed is None else closed


def _whole(done: list[str], every: int) -> str | None:
    """The newest of the days so far that wrote the current states whole."""
    return done[len(done) - len(done) % every - 1] if len(done) >= every else None


def _since(spark: SparkSession, state: str, days: list[str], whole: str | None) -> DataFrame:
    """Current states after `days`: the whole list of one of them, what was opened after it, without what was closed after it."""
    later = [x for x in days if whole is None or x > whole]
    read = spark.read.option("mergeSchema", True)
    rows = [read.parquet(f"{state}/current/{whole}")] if whole else []
    if later:
        rows.append(read.parquet(*[f"{state}/opened/{x}" for x in later]))
    held = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return held.join(read.parquet(*[f"{state}/closed/{x}" for x in later]).select("_state"), "_state", "left_anti") if later else held


def _current(spark: SparkSession, state: str, done: list[str], every: int) -> DataFrame | None:
    return _since(spark, state, done, _whole(done, every)) if done else None


def _days(spark: SparkSession, state: str) -> list:
    try:
        return spark.read.schema("day string").json(f"{state}/days/*").distinct().collect()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise


def feed_history(spark: SparkSession, state: str, every: int = 8) -> DataFrame:
    """Every stay of a state, first_seen and last_seen: what days closed, and the current states, seen until the newest day."""
    days = sorted(r.day for r in _days(spark, state))
    closed = spark.read.option("mergeSchema", True).parquet(*[f"{state}/closed/{x}" for x in days])
    current = _current(spark, state, days, every).withColumn("last_seen", F.lit(days[-1]).cast("date"))
    return closed.unionByName(current, allowMissingColumns=True).drop("_state")


def state_by_key(stream: DataFrame, key: str, status: str, order: str) -> DataFrame:
    """key, status, first_seen, last_seen: the current state of each key and when it was first and last seen so.

    `order` alone says what comes after what: a key's rows may come in any order, within a batch (parts of it are in none) and over batches. The state
    held is the last row of another status, before which no row matters, and a heap of the orders of the current run, which a late row can still
    cut. Of equal orders the greater status is the later; rows without an order are the last.
    """
    kind = stream.schema[key].dataType.simpleString()
    when = stream.schema[order].dataType.simpleString()
    out = f"{key} {kind}, status string, first_seen {when}, last_seen {when}"
    kept = f"status string, end {when}, last {when}, run array<{when}>, bounded boolean, bound {when}, bound_status string"
    whole = when in ("tinyint", "smallint", "int", "bigint")  # with nulls, pandas has them as floats
    place = lambda t: (t is None, 0 if t is None else t)
    time = lambda at: None if at[0] else at[1]
    full = lambda at, s: (*at, s is not None, s or "")

    def plain(t):
        return None if pd.isna(t) else int(t) if whole else t.to_pydatetime() if hasattr(t, "to_pydatetime") else t

    def update(k: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, end, last, run, bound = None, None, None, [], None
        if state.exists:
            now, end, last, times, bounded, at, s = state.get
            end, run, bound = place(end), [place(t) for t in times], (place(at), s) if bounded else None
        for part in rows:
            for t, s in zip(part[order].tolist(), part[status].tolist()):
                t, s = plain(t), None if pd.isna(s) else s
                at = place(t)
                if bound and full(at, s) <= full(*bound):
                    continue
                if run and s == now:
                    heapq.heappush(run, at)
                    end = max(end, at)
                    last = t if last is None else last if t is None else max(last, t)
                elif not run or full(at, s) > full(end, now):  # a new run
                    bound = (end, now) if run else None
                    now, end, last, run = s, at, t, [at]
                else:  # a row of another status inside the run, which now begins after it
                    bound = (at, s)
                    while full(run[0], now) <= full(*bound):
                        heapq.heappop(run)
        state.update((now, time(end), last, [time(at) for at in run], bound is not None, time(bound[0]) if bound else None, bound[1] if bound else None))
        yield pd.DataFrame({key: [k[0]], "status": [now], "first_seen": [time(run[0])], "last_seen": [last]})

    return stream.groupBy(key).applyInPandasWithState(update, out, kept, "update", GroupStateTimeout.NoTimeout)


def split_late(batch: DataFrame, day: str, grain: str, window: int, today: str) -> tuple[DataFrame, DataFrame]:
    """(rows in time, late rows flagged as revisions): a row of a finished period is late, kept, never dropped."""
    label = period(F.col(day), grain)
    late = F.coalesce(finished(label, grain, window, today), F.lit(False))
    rows = batch.withColumn("period", label)
    return rows.where(~late), rows.where(late).withColumn("revision", F.lit(True))


def period_counts(stream: DataFrame, day: str, grain: str, value: str) -> DataFrame:
    """Partial counts and exact sums by period and bin as rows arrive (complete or update mode), for period_totals."""
    return partials(stream.withColumn("period", period(F.col(day), grain)), ["period"], {"total": F.col(value)}, {"n": (F.count("*"), F.sum)})


def period_totals(rows: DataFrame) -> DataFrame:
    """period, n, total of what period_counts keeps."""
    return merged(rows, ["period"], ["total"], {"n": (F.count("*"), F.sum)}).select("period", "n", "total")


def once_a_day(stream: DataFrame, at: str, by: list[str], wait: str = "2 days") -> DataFrame:
    """The first row of a dataset's day; a second change waits for the next."""
    return stream.withColumn("day", F.to_date(at)).withWatermark(at, wait).dropDuplicatesWithinWatermark([*by, "day"])


def usage(stream: DataFrame, column: str = "line") -> DataFrame:
    return usage_counts(stream, column)
