"""Versions of a table: differences by key, digests, periods and their parts, change logs, snapshots, and feed history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


class KeyError_(ValueError):
    """Two different rows under one key."""


def same_key(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in key])


def row_hash(columns: list[str]) -> Column:
    """A digest of a row's values, NULL told apart from empty text."""
    return F.xxhash64(*[x for c in sorted(columns) for x in (F.col(c).isNull(), F.col(c))])


def row_key(columns: list[str]) -> Column:
    """128 bits that stand for a row's values where rows are taken as equal by them: two digests, the second begun from another value."""
    return F.struct(row_hash(columns).alias("one"), F.xxhash64(F.lit(1), *[x for c in sorted(columns) for x in (F.col(c).isNull(), F.col(c))]).alias("two"))


def conflicts(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys of more than one distinct row: key, rows, versions."""
    rest = [c for c in df.columns if c not in key] or key
    return df.withColumn("_h", row_key(rest)).groupBy(*key).agg(F.count("*").alias("rows"), F.count_distinct("_h").alias("versions")).where("versions > 1")


def repeats(df: DataFrame, key: list[str]) -> DataFrame:
    """repeated rows, conflicting keys: what reading a table by its key finds."""
    by_key = df.withColumn("_h", row_key([c for c in df.columns if c not in key] or key)).groupBy(*key, "_h").agg(F.count("*").alias("n"))
    per_key = by_key.groupBy(*key).agg(F.sum(F.col("n") - 1).alias("extra"), F.count("*").alias("kinds"))
    return per_key.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("repeated"), F.count_if(F.col("kinds") > 1).alias("conflicting"))


def diff(a: DataFrame, b: DataFrame, key: list[str], volatile: tuple[str, ...] = ()) -> DataFrame:
    """key and state (added, removed, changed, unchanged) of every key of either version; exact repeats count once.

    A field that only one version has changes every row; volatile fields are not compared; NULL key parts match.
    """
    shared = [c for c in b.columns if c not in key and c not in volatile]
    fields_moved = {c for c in a.columns if c not in volatile} != {c for c in b.columns if c not in volatile}
    shared = [c for c in shared if c in a.columns]
    kind_moved = any(dict(a.dtypes)[c] != dict(b.dtypes)[c] for c in shared)
    old = a.select(*[F.col(c).alias(f"_a{i}") for i, c in enumerate(key)], *[F.col(c).alias(f"_x{i}") for i, c in enumerate(shared)], F.lit(1).alias("_in_a")).distinct()
    new = b.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(key)], *[F.col(c).alias(f"_y{i}") for i, c in enumerate(shared)], F.lit(1).alias("_in_b")).distinct()
    on = reduce(lambda x, y: x & y, [F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}")) for i in range(len(key))])
    both = old.join(new, on, "full_outer")
    differ = reduce(lambda x, y: x | y, [~F.col(f"_x{i}").eqNullSafe(F.col(f"_y{i}")) for i in range(len(shared))], F.lit(fields_moved or kind_moved))
    state = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(differ, "changed").otherwise("unchanged")
    return both.select(*[F.coalesce(f"_b{i}", f"_a{i}").alias(c) for i, c in enumerate(key)], state.alias("state"))


def diff_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("state").agg(F.count("*").alias("n"))


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """field, change (added, removed, retyped) from the two schemas."""
    old, new = dict(a.dtypes), dict(b.dtypes)
    made = [(c, "removed") for c in old if c not in new] + [(c, "added") for c in new if c not in old] + [(c, "retyped") for c in old if c in new and old[c] != new[c]]
    return a.sparkSession.createDataFrame(made, "field string, change string")


def field_changes(fields: DataFrame) -> DataFrame:
    """dataset, version, field, change (added, removed, retyped) of every version against the one before, from a table of fields: dataset, version, field, type.

    The schemas of a whole register are compared in one job; a dataset's first version has no changes.
    """
    versions = fields.select("dataset", "version").distinct()
    steps = versions.withColumn("before", F.lag("version").over(W.partitionBy("dataset").orderBy("version"))).where("before is not null")
    now = steps.join(fields, ["dataset", "version"]).select("dataset", "version", "field", F.col("type").alias("_new"))
    old = steps.join(fields.withColumnRenamed("version", "before"), ["dataset", "before"]).select("dataset", "version", "field", F.col("type").alias("_old"))
    both = now.join(old, ["dataset", "version", "field"], "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "retyped")
    return both.select("dataset", "version", "field", change.alias("change")).where("change is not null")


def change_examples(a: DataFrame, b: DataFrame, key: list[str], limit: int = 10) -> DataFrame:
    """The first changed rows by key, a row for each field that moved: key, field, before, after."""
    fields = [c for c in b.columns if c not in key and c in a.columns]
    old = a.select(*key, F.array(*[F.col(c).cast("string") for c in fields]).alias("_old"), *[F.col(c).alias(f"_o_{c}") for c in fields])
    new = b.select(*[F.col(k).alias(f"_k_{k}") for k in key], F.array(*[F.col(c).cast("string") for c in fields]).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in fields])
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key])
    moved = [F.when(~F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}")), F.struct(F.lit(c).alias("field"), F.get("_old", F.lit(i)).alias("before"), F.get("_new", F.lit(i)).alias("after"))) for i, c in enumerate(fields)]
    changed = old.join(new, on).select(*key, F.filter(F.array(*moved), lambda x: x.isNotNull()).alias("m")).where(F.size("m") > 0)
    return changed.orderBy(*key).limit(limit).select(*key, F.explode("m").alias("m")).select(*key, "m.*")


def count_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """table, before, after from two lists of (table, rows)."""
    b = b.select(F.col("table").alias("_t"), F.col("rows").alias("after"))
    return a.select("table", F.col("rows").alias("before")).join(b, F.col("table") == F.col("_t"), "full_outer").select(F.coalesce("table", "_t").alias("table"), "before", "after")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one and not the other, as often as they are over, with side a or b."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).union(b.exceptAll(a).withColumn("side", F.lit("b")))


def digest(df: DataFrame, by: list[str] | None = None, volatile: tuple[str, ...] = ()) -> DataFrame:
    """rows, sum and xor of row digests: the same for the same rows in any order, repeats told apart by count and sum."""
    h = row_hash([c for c in df.columns if c not in volatile and c not in (by or [])])
    return df.withColumn("_h", h).groupBy(*(by or [])).agg(F.count("*").alias("rows"), F.sum(F.col("_h").cast("decimal(38,0)")).cast("string").alias("digest_sum"), F.bit_xor("_h").alias("digest_xor"))


def same_content(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """by, same: whether a group of one version has the rows, each as often, that it has in the other."""
    mark = lambda df, name: digest(df, by).select(*by, F.struct("rows", "digest_sum", "digest_xor").alias(name))
    return mark(a, "_a").join(mark(b, "_b"), by, "left").select(*by, F.col("_a").eqNullSafe(F.col("_b")).alias("same"))


def changes_list(versions: DataFrame, key: list[str], number: str) -> DataFrame:
    """number, added, removed, kept: each version's keys against those of the version before, in one join over all of them.

    versions: number (from 0, without gaps), key; the first version is compared with none and has no row.
    """
    last = versions.agg(F.max(number).alias("_last"))
    now = versions.select(*key, number, F.lit(True).alias("_here")).where(F.col(number) > 0)
    before = versions.crossJoin(F.broadcast(last)).where(F.col(number) < F.col("_last"))  # one row
    before = before.select(*key, (F.col(number) + 1).alias(number), F.lit(True).alias("_before"))
    both = now.join(before, [*key, number], "full_outer")
    here, there = F.col("_here").isNotNull(), F.col("_before").isNotNull()
    return both.groupBy(number).agg(F.count_if(~there).alias("added"), F.count_if(~here).alias("removed"), F.count_if(here & there).alias("kept"))


def whole_or_parts(sizes: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """dataset, whole: whether a dataset (dataset, rows, bytes) is small enough to be published as one file."""
    return sizes.select("dataset", ((F.col("rows") <= most_rows) & (F.col("bytes") <= most_bytes)).alias("whole"))


# Periods.


def period(c: Column, grain: str) -> Column:
    """A day's label: 2025, 2025-26 (July to June), 2025-Q1, 2025-01; no day is undated."""
    y, m = F.year(c), F.month(c)
    first = F.when(m < 7, y - 1).otherwise(y)
    made = {
        "year": F.format_string("%04d", y),
        "fiscal": F.format_string("%04d-%02d", first, (first + 1) % 100),
        "quarter": F.format_string("%04d-Q%d", y, F.quarter(c)),
        "month": F.format_string("%04d-%02d", y, m),
    }[grain]
    return F.when(c.isNull(), "undated").otherwise(made)


def open_since(grain: str, window: int, day: str) -> Column:
    """The label of the oldest of the `window` newest periods on a day."""
    months = {"year": 12, "fiscal": 12, "quarter": 3, "month": 1}[grain]
    return period(F.add_months(F.lit(day).cast("date"), -months * (window - 1)), grain)


def finished(label: Column, grain: str, window: int, day: str) -> Column:
    return (label != "undated") & (label < open_since(grain, window, day))


def touched_periods(a: DataFrame, b: DataFrame, day: str, grain: str, volatile: tuple[str, ...] = ()) -> DataFrame:
    """Periods in which the rows of two fetches differ."""
    state = lambda df: df.select(period(F.col(day), grain).alias("period"), row_key([c for c in df.columns if c not in volatile]).alias("_h"))
    return multiset_difference(state(a), state(b)).select("period").distinct()


def part_digests(df: DataFrame, day: str, grain: str, volatile: tuple[str, ...] = ()) -> DataFrame:
    return digest(df.withColumn("period", period(F.col(day), grain)), ["period"], volatile)


def reusable_parts(now: DataFrame, before: DataFrame) -> DataFrame:
    """period, write: whether a part differs from the one before and must be written."""
    old = before.select("period", F.col("rows").alias("_r"), F.col("digest_sum").alias("_s"), F.col("digest_xor").alias("_x"))
    same = (F.col("rows") == F.col("_r")) & (F.col("digest_sum") == F.col("_s")) & (F.col("digest_xor") == F.col("_x"))
    return now.join(old, "period", "left").select("period", (~F.coalesce(same, F.lit(False))).alias("write"))


def revisions(now: DataFrame, before: DataFrame, grain: str, window: int, day: str) -> DataFrame:
    """Finished periods whose rows differ from before, or that are gone."""
    old = before.select(F.col("period").alias("_p"), F.col("digest_sum").alias("_s"), F.col("rows").alias("_r"))
    both = now.join(old, F.col("period") == F.col("_p"), "full_outer").withColumn("label", F.coalesce("period", "_p"))
    moved = F.col("period").isNull() | (F.col("_p").isNotNull() & ((F.col("digest_sum") != F.col("_s")) | (F.col("rows") != F.col("_r"))))
    return both.where(moved & finished(F.col("label"), grain, window, day)).select(F.col("label").alias("period"))


def change_log(a: DataFrame | None, b: DataFrame, key: list[str], volatile: tuple[str, ...] = ()) -> DataFrame:
    """added, removed, changed, unchanged, churn of one fetch against the one before; the first fetch adds all."""
    if a is None:
        return b.agg(F.count("*").alias("added")).select("added", *[F.lit(0).cast("bigint").alias(c) for c in ("removed", "changed", "unchanged")], F.lit(None).cast("double").alias("churn"))
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    made = diff(a, b, key, volatile).agg(n("added"), n("removed"), n("changed"), n("unchanged"))
    before = F.col("removed") + F.col("changed") + F.col("unchanged")
    return made.withColumn("churn", F.when(before > 0, (F.col("added") + F.col("removed") + F.col("changed")) / before))


def snapshot_cut(log: DataFrame) -> DataFrame:
    """Why each fetch is a snapshot: first, revision, churn, period-close, monthly, or none (NULL).

    log: dataset, day, revised (count), churn, period_end (the last closed period's end on that day).
    """
    w = W.partitionBy("dataset").orderBy("day")
    before = F.lag("day").over(w)
    reason = (
        F.when(before.isNull(), "first").when(F.col("revised") > 0, "revision").when(F.col("churn") > 0.05, "churn")
        .when(before < F.col("period_end"), "period-close").when(F.trunc(before, "month") < F.trunc("day", "month"), "monthly")
    )
    return log.withColumn("reason", reason)


def late_promotion(fetches: DataFrame, today: str) -> DataFrame:
    """The newest fetch of each dataset is promoted to a snapshot once its month has closed."""
    newest = F.row_number().over(W.partitionBy("dataset").orderBy(F.desc("day"))) == 1
    return fetches.withColumn("promote", newest & F.col("reason").isNull() & (F.trunc("day", "month") < F.trunc(F.lit(today).cast("date"), "month")))


def version_chain(versions: DataFrame) -> DataFrame:
    return versions.withColumn("before", F.lag("version").over(W.partitionBy("dataset").orderBy("version")))


def latest(versions: DataFrame, withheld: DataFrame | None = None) -> DataFrame:
    """The newest version of each dataset that is not withheld."""
    left = versions.join(withheld, ["dataset", "version"], "left_anti") if withheld is not None else versions
    return left.groupBy("dataset").agg(F.max_by(F.struct(*[c for c in versions.columns if c != "dataset"]), "version").alias("x")).select("dataset", "x.*")


def free_version(changed: DataFrame, taken: DataFrame) -> DataFrame:
    """dataset, version: the day of change, or the next day that no version has, however many in a row are taken.

    Days taken in a row are one island (their distance from their rank is equal); a change within one moves to the day after its end.
    """
    days = taken.select("dataset", "version").where("version is not null").distinct()
    rank = F.row_number().over(W.partitionBy("dataset").orderBy("version"))
    islands = days.withColumn("_i", F.date_sub("version", rank)).groupBy(F.col("dataset").alias("_d"), "_i").agg(F.min("version").alias("_from"), F.max("version").alias("_to"))
    held = changed.select("dataset", "day").distinct().join(islands, F.col("dataset").eqNullSafe(F.col("_d")) & F.col("day").between(F.col("_from"), F.col("_to")), "left")
    return held.select("dataset", F.coalesce(F.date_add("_to", 1), "day").alias("version")).groupBy("dataset").agg(F.min("version").alias("version"))


def revised_between(fetches: DataFrame, snapshots: DataFrame) -> DataFrame:
    """dataset, version, periods revised by any fetch after the snapshot before and up to this one."""
    spans = snapshots.withColumn("after", F.lag("version").over(W.partitionBy("dataset").orderBy("version")))
    on = (F.col("s.dataset") == F.col("f.dataset")) & (F.col("f.day") <= F.col("s.version")) & (F.col("s.after").isNull() | (F.col("f.day") > F.col("s.after")))
    joined = spans.alias("s").join(fetches.alias("f"), on, "left")
    return joined.groupBy("s.dataset", "s.version").agg(F.array_join(F.array_sort(F.collect_set("f.revised")), ",").alias("revised"))


def grain_problem(sizes: DataFrame, coarser: Column, limit: int) -> DataFrame:
    """period, problem: finer where a part is over the limit, coarser where even its coarser period fits."""
    total = F.sum("bytes").over(W.partitionBy(coarser))
    return sizes.select("period", F.when(F.col("bytes") > limit, "finer").when(total <= limit, "coarser").alias("problem"))


# Feed history.


def advance(history: DataFrame, snapshot: DataFrame, day: str, last: str | None) -> DataFrame:
    """Feed history after one more snapshot: one row for each unbroken stay of a row's state, with first_seen and last_seen.

    A state that was current at the fetch before and is there still is carried on; one that is gone stays closed; one that comes
    back, or is new, begins a row. Columns that either side lacks are NULL there; states are compared on shared columns.
    """
    fields = [c for c in snapshot.columns if c in history.columns]
    seen = snapshot.select("*", row_key(fields).alias("_h")).dropDuplicates(["_h"])
    old = history.withColumn("_h", row_key(fields)).withColumn("_current", F.col("last_seen") == F.lit(last).cast("date"))
    now = seen.select("_h", F.lit(True).alias("_here"))
    carried = old.join(now, "_h", "left").withColumn("last_seen", F.when(F.col("_current") & F.col("_here"), F.lit(day).cast("date")).otherwise(F.col("last_seen")))
    current = old.where("_current").select("_h").distinct()
    fresh = seen.join(current, "_h", "left_anti").withColumns({"first_seen": F.lit(day).cast("date"), "last_seen": F.lit(day).cast("date")})
    return carried.drop("_h", "_current", "_here").unionByName(fresh.drop("_h"), allowMissingColumns=True)


def history_of(snapshots: DataFrame, columns: list[str], day: str = "day") -> DataFrame:
    """The same history from all snapshots at once: runs of consecutive fetch days in which a state is present."""
    days = snapshots.select(day).distinct().withColumn("_n", F.dense_rank().over(W.orderBy(day)))  # one row a fetch day
    rows = snapshots.select(day, *columns).distinct().join(F.broadcast(days), day)
    w = W.partitionBy(*columns).orderBy("_n")
    runs = rows.withColumn("_run", F.col("_n") - F.row_number().over(w))
    return runs.groupBy(*columns, "_run").agg(F.min(day).alias("first_seen"), F.max(day).alias("last_seen")).drop("_run")


def carry_last_seen(history: DataFrame, newest: str, read: str) -> DataFrame:
    """States current at the newest fetch hold until a later unchanged read."""
    return history.withColumn("last_seen", F.when(F.col("last_seen") == F.lit(newest).cast("date"), F.lit(read).cast("date")).otherwise(F.col("last_seen")))
