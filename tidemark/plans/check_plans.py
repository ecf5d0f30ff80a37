"""Data-quality jobs and written files over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import checks as k
from tidemark.operators import normalise as n
from tidemark.plans.common import lineitem, orders, table
from tidemark.plans.stream_plans import folder
from tidemark.sources import files, sinks

P, SQL = {}, {}
P["g02_int32_fit"] = lambda s, d: n.int_ranges(table(s, d, "events").withColumn("big", F.col("event_id") * 3_000_000_000), ["event_id", "user_id", "big"])
SQL["g02_int32_fit"] = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", min({e}) AS low, max({e}) AS high, max({e}) < 2147483648 AS fits FROM events" for c, e in (("event_id", "event_id"), ("user_id", "user_id"), ("big", "event_id * 3000000000")))


def _trees(spark, d):
    """Two trees of tables: one table dealt anew, one with a row less, one with another value, one in another order of rows, one that only one has."""
    part, o = table(spark, d, "part").withColumn("_pos", F.col("p_partkey")), orders(spark, d)
    one = {"orders": o, "fewer": part, "other": part, "moved": part, "gone": part}
    other = {"orders": o.repartition(3), "fewer": part.where("p_partkey <> 7"), "other": part.withColumn("p_size", F.when(F.col("p_partkey") == 7, -1).otherwise(F.col("p_size"))), "moved": part.withColumn("_pos", F.col("p_partkey") + 1)}
    return k.content_equal(one, other, "_pos")


P["g03_content_equal"] = _trees
_PART = "SELECT *, p_partkey AS _pos FROM part"
_SAME = "SELECT '{}' AS \"table\", NOT EXISTS ({} EXCEPT ALL {}) AND NOT EXISTS ({} EXCEPT ALL {}) AS same"
SQL["g03_content_equal"] = " UNION ALL ".join(_SAME.format(n_, a_, b_, b_, a_) for n_, a_, b_ in (
    ("orders", "SELECT * FROM orders", "SELECT * FROM (SELECT * FROM orders ORDER BY o_custkey)"), ("fewer", _PART, f"{_PART} WHERE p_partkey <> 7"), ("other", _PART, "SELECT * REPLACE (CASE WHEN p_partkey = 7 THEN -1 ELSE p_size END AS p_size), p_partkey AS _pos FROM part"), ("moved", _PART, "SELECT *, p_partkey + 1 AS _pos FROM part")
)) + " UNION ALL SELECT 'gone', false"


def _items(spark, d):
    c = F.col("c_custkey")
    return table(spark, d, "customer").select(c.alias("id"), F.col("c_mktsegment").alias("stratum"), (c % 97 + 1).alias("cost"), (c % 211 == 0).alias("forced"))


P["g07_stratified_sample"] = lambda s, d: k.stratified_sample(_items(s, d), 7, 3000)
SQL["g07_stratified_sample"] = """WITH i AS (SELECT c_custkey AS id, c_mktsegment AS stratum, c_custkey % 97 + 1 AS cost, c_custkey % 211 = 0 AS forced FROM customer), r AS (SELECT *, CASE WHEN forced THEN 0 WHEN row_number() OVER (PARTITION BY stratum ORDER BY cost, id) = 1 THEN 1 ELSE 2 END AS k FROM i),
 h AS (SELECT *, CASE WHEN k = 2 THEN md5('7:' || id) END AS h FROM r), s AS (SELECT *, sum(cost) OVER (ORDER BY k, h NULLS FIRST, cost, id ROWS UNBOUNDED PRECEDING) AS t FROM h) SELECT id, stratum, cost, CASE k WHEN 0 THEN 'forced' WHEN 1 THEN 'stratum' ELSE 'drawn' END AS why FROM s WHERE k < 2 OR t <= 3000"""
P["g08_licence_drift"] = lambda s, d: k.licence_drift(orders(s, d).select(F.col("o_custkey").alias("dataset"), F.to_date("o_orderdate").alias("version"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")).alias("stated")), table(s, d, "customer").select(F.col("c_custkey").alias("dataset"), F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("O").alias("registered")))
SQL["g08_licence_drift"] = "SELECT o_custkey AS dataset, CAST(o_orderdate AS DATE) AS version, o_orderstatus AS stated, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'O' END AS registered FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 5 > 0 AND o_orderstatus <> CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'O' END"
P["g10_pins_complete"] = lambda s, d: k.missing_pins(orders(s, d).select(F.col("o_custkey").alias("dataset"), F.col("o_orderkey").alias("day"), (F.col("o_orderkey") % 7 > 2).alias("pinned")))
SQL["g10_pins_complete"] = "SELECT dataset, day, pinned FROM (SELECT *, max(pinned::INT) OVER (PARTITION BY dataset ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT o_custkey AS dataset, o_orderkey AS day, o_orderkey % 7 > 2 AS pinned FROM orders)) WHERE b = 1 AND NOT pinned"
P["g05_period_required"] = lambda s, d: k.periods_needed(lineitem(s, d).groupBy(F.col("l_suppkey").alias("dataset")).agg(F.count("*").alias("rows"), (F.count("*") * 200).alias("bytes")).withColumns({"dated": F.col("dataset") % 3 > 0, "period": F.when(F.col("dataset") % 5 == 0, "year")}), 120_000, 800)
SQL["g05_period_required"] = "SELECT l_suppkey AS dataset, count(*) AS rows, count(*) * 200 AS bytes, true AS dated, NULL::VARCHAR AS period FROM lineitem WHERE l_suppkey % 3 > 0 AND l_suppkey % 5 <> 0 GROUP BY 1 HAVING count(*) * 200 > 120000 OR count(*) > 800"
P["j22_stale_aggregates"] = lambda s, d: k.stale_aggregates(orders(s, d).where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("hash")), orders(s, d).where("o_orderkey % 5 > 0").select(F.col("o_orderkey").alias("version"), F.when(F.col("o_orderkey") % 4 == 0, "x").otherwise(F.col("o_orderstatus")).alias("hash")))
SQL["j22_stale_aggregates"] = "SELECT o_orderkey AS version, CASE WHEN o_orderkey % 3 = 0 THEN 'delete' ELSE 'rebuild' END AS action FROM orders WHERE (o_orderkey % 3 = 0 AND o_orderkey % 5 > 0) OR (o_orderkey % 3 > 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 4 = 0))"


def _round_trip(name, write, read, columns, sql, select=lambda df: df):
    def query(spark, d):
        path = folder(spark, name)
        write(select(orders(spark, d)), path)
        return read(spark, path).select(*columns)

    P[name] = query
    SQL[name] = sql


_SLIM = lambda df: df.select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit('say "a, b"'), F.col("o_orderpriority"))).alias("note"))
_SLIM_SQL = "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 > 0 THEN 'say \"a, b\"' || o_orderpriority END AS note FROM orders"
_C = ["o_orderkey", "o_orderstatus", "note"]
_read_csv = lambda s, p: s.read.csv(p, header=True, escape='"', schema="o_orderkey bigint, o_orderstatus string, note string")
_round_trip("k01_sink_csv", lambda df, p: sinks.write_csv(df, p), _read_csv, _C, _SLIM_SQL, _SLIM)
_round_trip("k02_sink_csv_gz", lambda df, p: sinks.write_csv(df, p, gzip=True), _read_csv, _C, _SLIM_SQL, _SLIM)
_round_trip("k03_sink_ndjson", sinks.write_ndjson, lambda s, p: s.read.schema("o_orderkey bigint, o_orderstatus string, note string").json(p), _C, _SLIM_SQL, _SLIM)
_round_trip("k04_sink_parquet", sinks.write_parquet, lambda s, p: s.read.parquet(p), _C, _SLIM_SQL, _SLIM)
_round_trip("k05_sink_profile_parquet", lambda df, p: sinks.write_profile(df, p, ["o_orderstatus", "o_orderkey"], ["o_orderkey"], 4), lambda s, p: s.read.parquet(p), _C, _SLIM_SQL, _SLIM)
_round_trip("k08_sink_by_value", lambda df, p: sinks.write_by_value(df, p, "o_orderstatus"), lambda s, p: s.read.schema("o_orderkey bigint, note string, o_orderstatus string").json(p), _C, _SLIM_SQL, _SLIM)


def _parts(spark, d):
    """All parts written, then the newest two again with other rows: the rest stays as it was."""
    path = folder(spark, "parts")
    rows = orders(spark, d).select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    sinks.write_parts(rows, path, "day", "year")
    sinks.write_parts(rows.where("o_orderkey % 2 = 0"), path, "day", "year", only=["1997", "1998"])
    return spark.read.parquet(path).select("o_orderkey", F.col("period").cast("string").alias("period"))


P["k09_sink_parts"] = _parts
SQL["k09_sink_parts"] = "SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS period FROM orders WHERE year(o_orderdate) NOT IN (1997, 1998) OR o_orderkey % 2 = 0"


def _geojson(spark, d):
    """Features written one a line and read back."""
    path = folder(spark, "geojson")
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, (F.col("c_custkey") % 100 + 0.5).cast("double")).alias("lon"), F.lit(-30.25).cast("double").alias("lat"))
    sinks.write_geojson(rows, path, "lon", "lat")
    return spark.read.text(path)


P["k07_sink_geojson_rows"] = _geojson
SQL["k07_sink_geojson_rows"] = "SELECT '{\"type\":\"Feature\",\"geometry\":' || CASE WHEN c_custkey % 2 = 0 THEN '{\"type\":\"Point\",\"coordinates\":[' || (c_custkey % 100) || '.5,-30.25]}' ELSE 'null' END || ',\"properties\":{\"c_custkey\":' || c_custkey || '}}' AS value FROM customer"


def _version(spark, d):
    """A version stored in two parts of differing columns, read as one."""
    path = folder(spark, "version")
    sinks.write_tables({"a": orders(spark, d).where("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus"), "b": orders(spark, d).where("o_orderkey % 2 = 1").select("o_orderkey", "o_custkey")}, path)
    return files.versions_joined(spark, [f"{path}/a", f"{path}/b"])


P["s17_scan_version"] = _version
P["k10_sink_tables"] = lambda s, d: _version(s, d).groupBy("_part").agg(F.count("*").alias("rows"))
SQL["s17_scan_version"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 2 = 1 THEN o_custkey END AS o_custkey, o_orderkey % 2 AS _part FROM orders"
SQL["k10_sink_tables"] = "SELECT o_orderkey % 2 AS _part, count(*) AS rows FROM orders GROUP BY 1"


def _csv_text(spark, d, preamble):
    """Orders landed as delimited text under a preamble, read back."""
    path = folder(spark, "landed")
    line = F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus")
    top = "\n".join([*["A title line"] * preamble, "Key|Status"])
    body = orders(spark, d).groupBy(F.floor(F.col("o_orderkey") / 4000)).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("t"))  # a file for each 4000 keys
    body.select(F.concat(F.lit(top + "\n"), "t").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)
    return files.delimited(spark, path, "|", preamble + 1)


P["s01_scan_delimited"] = lambda s, d: _csv_text(s, d, 2).select("Key", "Status")
SQL["s01_scan_delimited"] = "SELECT CAST(o_orderkey AS VARCHAR) AS \"Key\", o_orderstatus AS \"Status\" FROM orders"


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _cells(spark, d):
    """A grid for each region, from the third row on: a header row of segments (blank over a segment's second and third column), one of measures, of which Share is not read; a column of keys that is blank
    in odd nations, one of names, counts and balances; a note under each nation."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    at, row = F.lit(3), F.col("n_nationkey") * 2 + 5
    for k, s_ in enumerate(SEGMENTS):
        at = F.when(F.col("c_mktsegment") == s_, 3 + 3 * k).otherwise(at)
    sums = c.groupBy("n_regionkey", "n_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.max("c_custkey").alias("last"))
    cell = lambda r, k, t: F.struct(F.lit(r).cast("int").alias("row"), F.lit(k).cast("int").alias("col"), F.lit(t).cast("string").alias("text"))
    grid = lambda df, sheet, cells: df.select(F.col(sheet).alias("sheet"), F.explode(F.array(*cells)).alias("c")).select("sheet", "c.*")
    data = grid(sums, "n_regionkey", [cell(row, at, F.col("n")), cell(row, at + 1, F.when(F.col("n") > 1, F.col("last"))), cell(row, at + 2, "9 %")])
    names = grid(table(spark, d, "nation"), "n_regionkey", [cell(row, 1, F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey"))), cell(row, 2, F.col("n_name")), cell(row + 1, 1, "A note."), cell(row + 1, 2, F.lit(" "))])
    heads = [cell(3, 3 + 3 * k, s_) for k, s_ in enumerate(SEGMENTS)] + [cell(4, 3 + 3 * k + j, m) for k in range(len(SEGMENTS)) for j, m in enumerate(("Count", "Last", "Share"))] + [cell(1, 1, "A title")]
    return data.unionByName(names).unionByName(grid(table(spark, d, "region"), "r_regionkey", heads))


P["s09_wide_grid_unpivot"] = lambda s, d: files.wide_grid(_cells(s, d), 2, 2, header_row=3, fill_down=(1,), measures={"Count": "n", "Last": "last"})[0].select("sheet", "row", "name_1", "name_2", F.col("head_1").alias("segment"), "n", "last")
SQL["s09_wide_grid_unpivot"] = f"""WITH g AS (SELECT n_regionkey AS sheet, n_nationkey AS k, n_name AS name_2, unnest([{', '.join(f"'{s_}'" for s_ in SEGMENTS)}]) AS segment FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)),
 c AS (SELECT c_nationkey AS k, c_mktsegment AS segment, count(*) AS n, CASE WHEN count(*) > 1 THEN max(c_custkey) END AS last FROM customer GROUP BY 1, 2)
 SELECT sheet, CAST(g.k * 2 + 5 AS INT) AS row, coalesce(CAST((SELECT max(h.k) FROM g h WHERE h.sheet = g.sheet AND h.k <= g.k AND h.k % 2 = 0) AS VARCHAR), '') AS name_1, name_2, g.segment, coalesce(CAST(n AS VARCHAR), '') AS n, coalesce(CAST(last AS VARCHAR), '') AS last FROM g LEFT JOIN c ON c.k = g.k AND c.segment = g.segment"""


def _lines(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("_pos", "line"))


_LINES = "(SELECT doc_id AS doc, unnest(range(len(string_split(text, chr(10))))) AS _pos, unnest(string_split(text, chr(10))) AS line FROM documents)"
P["s11_section_stack"] = lambda s, d: files.sections(_lines(s, d), r"^\S{1,12}$")
SQL["s11_section_stack"] = f"SELECT doc, _pos, line, section FROM (SELECT *, last_value(CASE WHEN regexp_matches(line, '^\\S{{1,12}}$') THEN line END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY _pos) AS section FROM {_LINES}) WHERE NOT regexp_matches(line, '^\\S{{1,12}}$')"
P["s12_group_rows"] = lambda s, d: files.group_rows(table(s, d, "events").select("user_id", "event_id", F.col("event_type").alias("first"), F.when(F.col("event_id") % 4 > 0, F.col("value").cast("string")).otherwise(" ").alias("second")), "first", ["second"], "user_id", "event_id").select("event_id", "first", "group")
SQL["s12_group_rows"] = "SELECT event_id, first, \"group\" FROM (SELECT event_id, event_type AS first, last_value(CASE WHEN event_id % 4 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS \"group\" FROM events) WHERE event_id % 4 > 0"


def _series(spark, d):
    stations = table(spark, d, "customer").select(F.col("c_custkey").alias("station"), F.concat(F.col("c_mktsegment"), F.lit(" - "), F.col("c_name")).alias("owner"))
    values = orders(spark, d).groupBy(F.col("o_custkey").alias("station")).agg(F.collect_list(F.struct(F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("quality"))).alias("data"))
    return files.series(stations, values)


P["s19_series_assemble"] = _series
SQL["s19_series_assemble"] = "SELECT o_custkey AS station, c_mktsegment AS state, CAST(o_orderdate AS DATE) AS date, o_totalprice AS value, o_orderstatus AS quality FROM orders LEFT JOIN customer ON c_custkey = o_custkey"
P["s20_pick_newest_file"] = lambda s, d: files.newest_file(table(s, d, "pages").select(F.col("url").alias("path"), (F.col("page_id") * 37 % 1009).alias("modificationTime")), r"/en/")
SQL["s20_pick_newest_file"] = "SELECT url AS path FROM pages WHERE regexp_matches(url, '/en/') ORDER BY page_id * 37 % 1009 DESC, url DESC LIMIT 1"
P["s21_backfill_versions"] = lambda s, d: files.backfill(orders(s, d).select(F.col("o_custkey").alias("dataset"), F.to_date("o_orderdate").alias("version")).distinct(), orders(s, d).where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("dataset"), F.to_date("o_orderdate").alias("version")), "1996-01-01")
SQL["s21_backfill_versions"] = "SELECT DISTINCT o_custkey AS dataset, CAST(o_orderdate AS DATE) AS version FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1996-01-01' EXCEPT SELECT o_custkey, CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 2 = 0"
