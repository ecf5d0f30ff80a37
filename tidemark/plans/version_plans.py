"""Versions of orders, derived by arithmetic: differences, digests, periods, snapshots and feed history, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidemark.operators import versions as v
from tidemark.plans.common import table

P, SQL = {}, {}
KEY = ["o_orderkey"]


def version_a(spark, d):
    return table(spark, d, "orders").where("o_orderkey % 17 <> 0").select("o_orderkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("day"))


def version_b(spark, d):
    k = F.col("o_orderkey")
    price = F.when(k % 11 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return table(spark, d, "orders").where("o_orderkey % 13 <> 0").select("o_orderkey", F.when(k % 19 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), price.alias("o_totalprice"), F.to_date("o_orderdate").alias("day"))


A = "(SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 17 <> 0)"
B = "(SELECT o_orderkey, CASE WHEN o_orderkey % 19 <> 0 THEN o_orderstatus END AS o_orderstatus, o_totalprice + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS o_totalprice, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 13 <> 0)"
DIFF = f"""(SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed'
 WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_totalprice IS DISTINCT FROM b.o_totalprice OR a.day IS DISTINCT FROM b.day THEN 'changed' ELSE 'unchanged' END AS state
 FROM {A} a FULL JOIN {B} b ON a.o_orderkey = b.o_orderkey)"""

P["j01_version_diff"] = lambda s, d: v.diff(version_a(s, d), version_b(s, d), KEY)
SQL["j01_version_diff"] = f"SELECT * FROM {DIFF}"
P["j02_cell_differs"] = lambda s, d: v.diff_counts(v.diff(version_a(s, d).withColumn("x", F.lit(float("nan"))), version_b(s, d).withColumn("x", F.lit(float("nan"))), KEY))
SQL["j02_cell_differs"] = f"SELECT state, count(*) AS n FROM {DIFF} GROUP BY 1"
P["j03_repeat_key_guard"] = lambda s, d: v.repeats(table(s, d, "lineitem").select("l_orderkey", "l_returnflag"), ["l_orderkey"])
SQL["j03_repeat_key_guard"] = "SELECT sum(n - kinds)::BIGINT AS repeated, count(*) FILTER (kinds > 1) AS conflicting FROM (SELECT l_orderkey, count(*) AS n, count(DISTINCT coalesce(l_returnflag, '?')) AS kinds FROM lineitem GROUP BY 1)"
P["j05_change_examples"] = lambda s, d: v.change_examples(version_a(s, d).select("o_orderkey", "o_orderstatus"), version_b(s, d).select("o_orderkey", "o_orderstatus"), KEY)
SQL["j05_change_examples"] = f"SELECT a.o_orderkey, 'o_orderstatus' AS field, a.o_orderstatus AS before, b.o_orderstatus AS after FROM {A} a JOIN {B} b USING (o_orderkey) WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus ORDER BY 1 LIMIT 10"


def _counts(spark, d, names, where="true"):
    return reduce(lambda a, b: a.unionByName(b), [table(spark, d, t).where(where).agg(F.lit(t).alias("table"), F.count("*").alias("rows")) for t in names])


P["j06_table_count_diff"] = lambda s, d: v.count_diff(_counts(s, d, ["orders", "part"]), _counts(s, d, ["part", "nation"]))
SQL["j06_table_count_diff"] = "SELECT 'orders' AS \"table\", (SELECT count(*) FROM orders) AS before, NULL::BIGINT AS after UNION ALL SELECT 'part', (SELECT count(*) FROM part), (SELECT count(*) FROM part) UNION ALL SELECT 'nation', NULL, (SELECT count(*) FROM nation)"
P["g01_key_unique"] = lambda s, d: v.conflicts(table(s, d, "lineitem").select("l_orderkey", "l_linestatus"), ["l_orderkey"])
SQL["g01_key_unique"] = "SELECT l_orderkey, count(*) AS rows, count(DISTINCT l_linestatus) AS versions FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1"
P["x01_union_by_name"] = lambda s, d: version_a(s, d).select("o_orderkey", "o_orderstatus").unionByName(version_b(s, d).select("o_orderkey", "day"), allowMissingColumns=True)
SQL["x01_union_by_name"] = f"SELECT o_orderkey, o_orderstatus, NULL::DATE AS day FROM {A} UNION ALL SELECT o_orderkey, NULL, day FROM {B}"
P["x02_distinct_union"] = lambda s, d: version_a(s, d).union(version_b(s, d)).distinct()
SQL["x02_distinct_union"] = f"SELECT * FROM {A} UNION SELECT * FROM {B}"
P["x03_multiset_difference"] = lambda s, d: v.multiset_difference(version_a(s, d).select("o_orderstatus", "day"), version_b(s, d).select("o_orderstatus", "day"))
SQL["x03_multiset_difference"] = f"SELECT *, 'a' AS side FROM (SELECT o_orderstatus, day FROM {A} EXCEPT ALL SELECT o_orderstatus, day FROM {B}) UNION ALL SELECT *, 'b' FROM (SELECT o_orderstatus, day FROM {B} EXCEPT ALL SELECT o_orderstatus, day FROM {A})"
P["x04_key_membership"] = lambda s, d: version_a(s, d).join(version_b(s, d), KEY, "left_anti").select("o_orderkey")
SQL["x04_key_membership"] = f"SELECT o_orderkey FROM {A} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {B})"
P["x05_carry_forward"] = lambda s, d: version_a(s, d).where("o_orderstatus = 'F'").unionByName(version_b(s, d).where("o_orderstatus <> 'F'"))
SQL["x05_carry_forward"] = f"SELECT * FROM {A} WHERE o_orderstatus = 'F' UNION ALL SELECT * FROM {B} WHERE o_orderstatus <> 'F'"
P["x06_first_by_id"] = lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.min_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.*")
SQL["x06_first_by_id"] = "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1"


def _label(grain, day="day"):
    y, m = f"year({day})", f"month({day})"
    first = f"CASE WHEN {m} < 7 THEN {y} - 1 ELSE {y} END"
    made = {"year": f"printf('%04d', {y})", "fiscal": f"printf('%04d-%02d', {first}, ({first} + 1) % 100)", "quarter": f"printf('%04d-Q%d', {y}, quarter({day}))", "month": f"printf('%04d-%02d', {y}, {m})"}[grain]
    return f"CASE WHEN {day} IS NULL THEN 'undated' ELSE {made} END"


def _dated(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 23 != 0, F.to_date("o_orderdate")).alias("day"))


D = "(SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 23 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders)"
GRAINS = ("year", "fiscal", "quarter", "month")
P["v01_period_label"] = lambda s, d: _dated(s, d).select("o_orderkey", *[v.period(F.col("day"), g).alias(g) for g in GRAINS])
SQL["v01_period_label"] = f"SELECT o_orderkey, {', '.join(f'{_label(g)} AS {g}' for g in GRAINS)} FROM {D}"
P["v02_open_finished"] = lambda s, d: _dated(s, d).select("o_orderkey", v.finished(v.period(F.col("day"), "quarter"), "quarter", 3, "1996-05-10").alias("finished"))
SQL["v02_open_finished"] = f"SELECT o_orderkey, p <> 'undated' AND p < '1995-Q4' AS finished FROM (SELECT o_orderkey, {_label('quarter')} AS p FROM {D})"
P["v03_split_parts"] = lambda s, d: v.part_digests(_dated(s, d), "day", "month").select("period", "rows")
SQL["v03_split_parts"] = f"SELECT {_label('month')} AS period, count(*) AS rows FROM {D} GROUP BY 1"
P["v04_reuse_parts"] = lambda s, d: v.reusable_parts(v.part_digests(version_b(s, d).where("o_orderkey % 11 = 0 or year(day) < 1996"), "day", "year"), v.part_digests(version_a(s, d).where("year(day) < 1996"), "day", "year"))
_BOTH = f"SELECT {_label('year')} AS period, * FROM"
SQL["v04_reuse_parts"] = f"""WITH n AS ({_BOTH} {B} WHERE o_orderkey % 11 = 0 OR year(day) < 1996), b AS ({_BOTH} {A} WHERE year(day) < 1996), x AS ((SELECT * FROM n EXCEPT ALL SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM n))
 SELECT DISTINCT period, period IN (SELECT period FROM x) AS write FROM n"""


def _digests(spark, d):
    """A version's digest against those of its rows dealt anew, with some rows twice, and without some, by status."""
    a, k, by = version_a(spark, d), F.col("o_orderkey"), ["o_orderstatus"]
    other = {"dealt": a.repartition(5), "twice": a.unionByName(a.where(k % 1009 == 0)), "without": a.where(k % 1013 != 0)}
    made = v.digest(a, by).select("o_orderstatus", "rows", F.struct("rows", "digest_sum", "digest_xor").alias("_a"))
    for name, rows in other.items():
        made = made.join(v.digest(rows, by).select("o_orderstatus", F.struct("rows", "digest_sum", "digest_xor").alias(f"_{name}")), "o_orderstatus", "left")
    return made.select("o_orderstatus", "rows", *[F.col("_a").eqNullSafe(F.col(f"_{name}")).alias(name) for name in other])


P["v05_rows_digest"] = _digests
SQL["v05_rows_digest"] = f"SELECT o_orderstatus, count(*) AS rows, true AS dealt, count(*) FILTER (o_orderkey % 1009 = 0) = 0 AS twice, count(*) FILTER (o_orderkey % 1013 = 0) = 0 AS without FROM {A} GROUP BY 1"
P["v06_touched_periods"] = lambda s, d: v.touched_periods(version_a(s, d), version_a(s, d).where("o_orderkey % 1009 <> 0"), "day", "month")
SQL["v06_touched_periods"] = f"SELECT DISTINCT {_label('month')} AS period FROM {A} WHERE o_orderkey % 1009 = 0"
P["v07_change_log"] = lambda s, d: v.change_log(version_a(s, d), version_b(s, d), KEY, ("day",)).withColumn("churn", F.round("churn", 6))
SQL["v07_change_log"] = f"SELECT *, round((added + removed + changed) / (removed + changed + unchanged), 6) AS churn FROM (SELECT count(*) FILTER (state = 'added') AS added, count(*) FILTER (state = 'removed') AS removed, count(*) FILTER (state = 'changed') AS changed, count(*) FILTER (state = 'unchanged') AS unchanged FROM {DIFF})"


def _log(spark, d):
    """A change log of daily fetches made of orders: the status is the dataset."""
    day = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("dataset"), F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return day.where("n % 3 <> 0").select("dataset", "day", (F.col("n") % 5 == 4).cast("int").alias("revised"), (F.col("n") / 40).alias("churn"), F.trunc("day", "quarter").alias("period_end"))


LOG = "(SELECT dataset, day, CAST(n % 5 = 4 AS INT) AS revised, n / 40 AS churn, CAST(date_trunc('quarter', day) AS DATE) AS period_end FROM (SELECT o_orderstatus AS dataset, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1, 2) WHERE n % 3 <> 0)"
CUT = f"(SELECT dataset, day, CASE WHEN b IS NULL THEN 'first' WHEN revised > 0 THEN 'revision' WHEN churn > 0.05 THEN 'churn' WHEN b < period_end THEN 'period-close' WHEN date_trunc('month', b) < date_trunc('month', day) THEN 'monthly' END AS reason FROM (SELECT *, lag(day) OVER (PARTITION BY dataset ORDER BY day) AS b FROM {LOG}))"
P["v08_snapshot_cut"] = lambda s, d: v.snapshot_cut(_log(s, d)).select("dataset", "day", "reason")
SQL["v08_snapshot_cut"] = f"SELECT * FROM {CUT}"
P["v09_late_promotion"] = lambda s, d: v.late_promotion(v.snapshot_cut(_log(s, d)).where("reason is null or reason <> 'first'"), "2030-01-01").select("dataset", "day", "promote")
SQL["v09_late_promotion"] = f"SELECT dataset, day, row_number() OVER (PARTITION BY dataset ORDER BY day DESC) = 1 AND reason IS NULL AS promote FROM {CUT} WHERE reason IS NULL OR reason <> 'first'"
DAYS = [f"2024-01-0{i}" for i in range(1, 7)]


def _snapshot(spark, d, i):
    """Day i of a feed: users that are in it that day, and the type of their latest event by then."""
    events = table(spark, d, "events").where((F.col("user_id") + i) % 5 != 0).where(F.col("event_id") % 7 <= i)
    return events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"))


_SNAPSHOTS = " UNION ALL ".join(f"SELECT DATE '{DAYS[i]}' AS day, user_id, arg_max(event_type, event_id) AS status FROM events WHERE (user_id + {i}) % 5 <> 0 AND event_id % 7 <= {i} GROUP BY user_id" for i in range(len(DAYS)))
HISTORY = f"(SELECT user_id, status, min(day) AS first_seen, max(day) AS last_seen FROM (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id, status ORDER BY day) AS INT) AS run FROM ({_SNAPSHOTS})) GROUP BY user_id, status, run)"


def _replayed(spark, d):
    first = _snapshot(spark, d, 0)
    history = first.withColumns({"first_seen": F.lit(DAYS[0]).cast("date"), "last_seen": F.lit(DAYS[0]).cast("date")})
    for i in range(1, len(DAYS)):
        history = v.advance(history, _snapshot(spark, d, i), DAYS[i], DAYS[i - 1])
    return history


P["v10_feed_history"] = _replayed
SQL["v10_feed_history"] = f"SELECT * FROM {HISTORY}"
P["v10b_history_at_once"] = lambda s, d: v.history_of(reduce(lambda a, b: a.unionByName(b), [_snapshot(s, d, i).withColumn("day", F.lit(DAYS[i]).cast("date")) for i in range(len(DAYS))]), ["user_id", "status"])
SQL["v10b_history_at_once"] = SQL["v10_feed_history"]
P["v11_carry_last_seen"] = lambda s, d: v.carry_last_seen(P["v10b_history_at_once"](s, d), DAYS[-1], "2024-01-20")
SQL["v11_carry_last_seen"] = f"SELECT user_id, status, first_seen, CASE WHEN last_seen = DATE '{DAYS[-1]}' THEN DATE '2024-01-20' ELSE last_seen END AS last_seen FROM {HISTORY}"
P["v12_revised_since"] = lambda s, d: v.revised_between(_log(s, d).withColumn("revised", F.when(F.col("revised") > 0, F.date_format("day", "yyyy-MM"))).select("dataset", "day", "revised"), _log(s, d).where("dayofmonth(day) = 1").select("dataset", F.col("day").alias("version")))
SQL["v12_revised_since"] = f"WITH f AS (SELECT dataset, day, CASE WHEN revised > 0 THEN strftime(day, '%Y-%m') END AS revised FROM {LOG}), s AS (SELECT dataset, day AS version, lag(day) OVER (PARTITION BY dataset ORDER BY day) AS after FROM {LOG} WHERE day(day) = 1) SELECT s.dataset, s.version, coalesce(string_agg(DISTINCT f.revised, ',' ORDER BY f.revised), '') AS revised FROM s LEFT JOIN f ON f.dataset = s.dataset AND f.day <= s.version AND (s.after IS NULL OR f.day > s.after) GROUP BY 1, 2"
P["v13_revision_flag"] = lambda s, d: v.revisions(v.part_digests(version_a(s, d).where("o_orderkey % 101 <> 0"), "day", "month"), v.part_digests(version_a(s, d), "day", "month"), "month", 2, "1997-03-15")
SQL["v13_revision_flag"] = f"SELECT DISTINCT {_label('month')} AS period FROM {A} WHERE o_orderkey % 101 = 0 AND {_label('month')} < '1997-02'"
P["v15_version_date"] = lambda s, d: v.free_version(_log(s, d).groupBy("dataset").agg(F.min("day").alias("day")), _log(s, d).select("dataset", F.col("day").alias("version")))
SQL["v15_version_date"] = f"WITH RECURSIVE t(dataset, version) AS (SELECT dataset, min(day) FROM {LOG} GROUP BY 1 UNION ALL SELECT t.dataset, CAST(t.version + INTERVAL 1 DAY AS DATE) FROM t WHERE EXISTS (SELECT 1 FROM {LOG} l WHERE l.dataset = t.dataset AND l.day = t.version)) SELECT dataset, max(version) AS version FROM t GROUP BY 1"
_FIELDS = [("orderkey", 1, "bigint"), ("status", 2, "string"), ("price", 3, "double"), ("day", 5, "date")]


def _schemas(spark, d):
    """The fields of each dataset's versions: a field is there where its number divides the version's, and retyped in versions after the third."""
    rows = _log(spark, d).select("dataset", F.col("day").alias("version"), F.dayofmonth("day").alias("_k"))
    field = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(k).alias("k"), F.lit(t).alias("type")) for f, k, t in _FIELDS])).alias("x")
    made = rows.select("dataset", "version", "_k", field).select("dataset", "version", "_k", "x.*").where("_k % k = 0")
    return v.field_changes(made.select("dataset", "version", "field", F.when((F.col("_k") > 15) & (F.col("field") == "price"), "decimal").otherwise(F.col("type")).alias("type")))


P["j04_schema_diff"] = _schemas
_FIELD_ROWS = " UNION ALL ".join(f"SELECT dataset, day AS version, '{f}' AS field, CASE WHEN day(day) > 15 AND '{f}' = 'price' THEN 'decimal' ELSE '{t}' END AS type FROM {LOG} WHERE day(day) % {k} = 0" for f, k, t in _FIELDS)
SQL["j04_schema_diff"] = f"WITH f AS ({_FIELD_ROWS}), s AS (SELECT dataset, version, lag(version) OVER (PARTITION BY dataset ORDER BY version) AS before FROM (SELECT DISTINCT dataset, version FROM f)), n AS (SELECT s.dataset, s.version, field, type FROM s JOIN f USING (dataset, version) WHERE before IS NOT NULL), o AS (SELECT s.dataset, s.version, field, type FROM s JOIN f ON f.dataset = s.dataset AND f.version = s.before) SELECT coalesce(n.dataset, o.dataset) AS dataset, coalesce(n.version, o.version) AS version, coalesce(n.field, o.field) AS field, CASE WHEN o.type IS NULL THEN 'added' WHEN n.type IS NULL THEN 'removed' ELSE 'retyped' END AS change FROM n FULL JOIN o ON n.dataset = o.dataset AND n.version = o.version AND n.field = o.field WHERE n.type IS DISTINCT FROM o.type"
P["v17_grain_check"] = lambda s, d: v.grain_problem(_dated(s, d).where("day is not null").groupBy(v.period(F.col("day"), "quarter").alias("period")).agg((F.count("*") * 100).alias("bytes")), F.substring("period", 1, 4), 60_000)
SQL["v17_grain_check"] = f"SELECT period, CASE WHEN bytes > 60000 THEN 'finer' WHEN sum(bytes) OVER (PARTITION BY substring(period, 1, 4)) <= 60000 THEN 'coarser' END AS problem FROM (SELECT {_label('quarter')} AS period, count(*) * 100 AS bytes FROM {D} WHERE day IS NOT NULL GROUP BY 1)"
P["v19_latest_view"] = lambda s, d: v.latest(_log(s, d).select("dataset", F.col("day").alias("version"), "churn"), _log(s, d).where("revised = 1").select("dataset", F.col("day").alias("version")))
SQL["v19_latest_view"] = f"SELECT dataset, max(day) AS version, arg_max(churn, day) AS churn FROM {LOG} WHERE revised = 0 GROUP BY 1"
P["w03_version_chain"] = lambda s, d: v.version_chain(_log(s, d).select("dataset", F.col("day").alias("version")))
SQL["w03_version_chain"] = f"SELECT dataset, day AS version, lag(day) OVER (PARTITION BY dataset ORDER BY day) AS before FROM {LOG}"
P["a26_period_group_keys"] = lambda s, d: _dated(s, d).groupBy(v.period(F.col("day"), "fiscal").alias("period")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
SQL["a26_period_group_keys"] = f"SELECT {_label('fiscal')} AS period, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {D} GROUP BY 1"
P["g04_parts_cover"] = lambda s, d: v.multiset_difference(_dated(s, d), _dated(s, d).where("day is not null").unionByName(_dated(s, d).where("day is null and o_orderkey % 2 = 0")))
SQL["g04_parts_cover"] = f"SELECT *, 'a' AS side FROM {D} WHERE day IS NULL AND o_orderkey % 2 <> 0"
