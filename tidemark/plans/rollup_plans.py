"""Cubes, series, grids, points in areas and tiles over the given tables, with their SQL."""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import combinations

from pyspark.sql import functions as F

from tidemark.functions.lineage import shared_dir
from tidemark.operators import cube_store as cs
from tidemark.operators import rollup as r
from tidemark.operators import spatial as sp
from tidemark.operators.query import aggregate_query
from tidemark.plans.common import lineitem, orders, table

P, SQL = {}, {}
FIELDS = ["l_returnflag", "l_linestatus", "l_linenumber"]
SETS = [("l_returnflag",), ("l_linestatus", "l_returnflag"), ("l_linenumber", "l_linestatus", "l_returnflag")]


def _rows(spark, d):
    return lineitem(spark, d).withColumns({"l_returnflag": F.when(F.col("l_orderkey") % 29 != 0, F.col("l_returnflag")), "qty": F.col("l_quantity").cast("bigint")})


BASE = "(SELECT * REPLACE (CASE WHEN l_orderkey % 29 <> 0 THEN l_returnflag END AS l_returnflag), CAST(l_quantity AS BIGINT) AS qty FROM lineitem)"
P["a05_distinct_counts"] = lambda s, d: r.distinct_counts(_rows(s, d), FIELDS)
# Of so few values the sketches' counts are exact.
SQL["a05_distinct_counts"] = " UNION ALL ".join(f"SELECT '{f}' AS field, count(DISTINCT {f}) + max(({f} IS NULL)::INT) AS estimate FROM {BASE}" for f in FIELDS)
# An estimate of more values may be off: what is checked is that it lies within 5 % of the exact count, or one.
_PAIRS = [c for k in (1, 2) for c in combinations(FIELDS, k)]
P["a06_group_counts"] = lambda s, d: r.group_counts(_rows(s, d), _PAIRS).join(reduce(lambda a, b: a.unionByName(b), [_rows(s, d).select(*c).distinct().agg(F.count("*").alias("groups")).withColumn("fields", F.lit(",".join(c))) for c in _PAIRS]), "fields").select("fields", "groups", (F.abs(F.col("estimate") - F.col("groups")) <= F.greatest(F.lit(1.0), F.col("groups") * 0.05)).alias("near"))
SQL["a06_group_counts"] = " UNION ALL ".join(f"SELECT '{','.join(c)}' AS fields, count(*) AS groups, true AS near FROM (SELECT DISTINCT {', '.join(c)} FROM {BASE})" for c in _PAIRS)


def _planned(spark, d):
    """The chosen field sets, each with the groups it makes of the table."""
    rows = _rows(spark, d)
    chosen = r.plan(rows, FIELDS, ["qty"], 300, [("l_linestatus", "l_returnflag")])
    return r.cubes(rows, chosen, ["qty"]).groupBy("cube").agg(F.count("*").alias("groups"))


P["a07_cube_plan"] = _planned
P["a08_grouping_sets_cubes"] = lambda s, d: r.cubes(_rows(s, d), SETS, ["qty", "l_extendedprice"]).withColumn("l_extendedprice_sum", F.round("l_extendedprice_sum", 4))
SQL["a08_grouping_sets_cubes"] = " UNION ALL ".join(
    f"SELECT '{','.join(c)}' AS cube, {', '.join((f if f in c else f'NULL') + ' AS ' + f for f in sorted(FIELDS))}, count(*) AS count, count(qty) AS qty_n, sum(qty)::BIGINT AS qty_sum, min(qty) AS qty_min, max(qty) AS qty_max, count(l_extendedprice) AS l_extendedprice_n, round(fsum(l_extendedprice), 4) AS l_extendedprice_sum, min(l_extendedprice) AS l_extendedprice_min, max(l_extendedprice) AS l_extendedprice_max FROM {BASE} GROUP BY {', '.join(c)}" for c in SETS
)
_M = ["count", "sum.qty", "avg.qty", "min.qty", "max.qty"]


def _stored(spark, d):
    """The answer from the stored cubes of lineitem, which are made once for the files that it has; later answers read one cube."""
    store, version, content = f"{shared_dir(spark)}/cube-store", "lineitem-" + hashlib.sha256(d.encode()).hexdigest()[:16], cs.file_hash(spark, f"{d}/lineitem.parquet")
    at = cs.held(spark, store, version)
    if at is None or at.content != content:
        cs.build(spark, store, version, _rows(spark, d), SETS, ["qty"], content)
        at = cs.held(spark, store, version)
    return cs.stored_answer(spark, store, at, ["l_returnflag"], _M, [("l_linenumber", "lte.3")]).withColumn("avg_qty", F.round("avg_qty", 6))


P["a09_answer_from_cube"] = _stored
SQL["a09_answer_from_cube"] = f"SELECT l_returnflag, count(*) AS count, sum(qty) AS sum_qty, round(avg(qty), 6) AS avg_qty, min(qty) AS min_qty, max(qty) AS max_qty FROM {BASE} WHERE l_linenumber <= 3 GROUP BY 1"
P["a10_exactness_gate"] = lambda s, d: r.answer(_rows(s, d), r.cubes(_rows(s, d), SETS, ["qty"]), SETS, ["qty"], ["l_linestatus"], ["count", "sum.l_quantity"], [])
SQL["a10_exactness_gate"] = "SELECT l_linestatus, count(*) AS count, sum(l_quantity) AS sum_l_quantity FROM lineitem GROUP BY 1"
P["a12_field_profile"] = lambda s, d: r.field_profile(_rows(s, d), ["l_returnflag", "l_suppkey"])
SQL["a12_field_profile"] = " UNION ALL ".join(f"SELECT '{f}' AS field, count(DISTINCT {f}) AS \"distinct\", min({f}::VARCHAR) AS low, max({f}::VARCHAR) AS high, CASE WHEN count(DISTINCT {f}) <= 12 THEN string_agg(DISTINCT {f}::VARCHAR, ';' ORDER BY {f}::VARCHAR) END AS \"values\" FROM {BASE}" for f in ("l_returnflag", "l_suppkey"))
P["a13_pick_example"] = lambda s, d: r.pick_example(_rows(s, d), "l_linenumber", "l_returnflag")
SQL["a13_pick_example"] = f"SELECT l_linenumber AS value, count(*) AS rows, count(DISTINCT l_returnflag) AS groups FROM {BASE} GROUP BY 1 HAVING count(*) >= 20 AND count(DISTINCT l_returnflag) > 1 ORDER BY rows DESC, value LIMIT 1"
P["a14_yearly_series"] = lambda s, d: r.yearly_series(orders(s, d), "o_orderdate", "o_orderpriority", F.count("*"))
SQL["a14_yearly_series"] = """SELECT y AS year, o_orderpriority AS category, n AS value, (y = year(lo) AND dayofyear(lo) > 1) OR (y = year(hi) AND strftime(hi, '%m-%d') <> '12-31') AS partial
 FROM (SELECT year(o_orderdate) AS y, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), (SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders)"""
P["a15_top_n_other"] = lambda s, d: r.top_n_other(lineitem(s, d).groupBy("l_suppkey").agg(F.count("*").alias("n")).withColumn("l_suppkey", F.col("l_suppkey").cast("string")), "l_suppkey", "n", 5)
SQL["a15_top_n_other"] = "WITH t AS (SELECT l_suppkey::VARCHAR AS k, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, k) AS r FROM t) SELECT CASE WHEN r <= 5 THEN k ELSE 'Other' END AS l_suppkey, sum(n)::BIGINT AS n FROM r GROUP BY 1"
P["a18_example_topn"] = lambda s, d: aggregate_query(orders(s, d), ["o_custkey"], ["count"], [], "count.desc", 8)
SQL["a18_example_topn"] = "SELECT o_custkey, count(*) AS count FROM orders GROUP BY 1 ORDER BY count DESC, o_custkey LIMIT 9"
P["a19_partition_index"] = lambda s, d: r.partition_index(orders(s, d), ["o_orderstatus", "o_orderpriority"])
SQL["a19_partition_index"] = "SELECT 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2"
P["a27_place_summary"] = lambda s, d: r.place_summary(table(s, d, "customer"), "c_nationkey").withColumn("share", F.round("share", 9))
SQL["a27_place_summary"] = "SELECT c_nationkey, count(*) AS rows, round(count(*) / (SELECT count(*) FROM customer), 9) AS share FROM customer GROUP BY 1"
P["a29_coverage_span"] = lambda s, d: orders(s, d).groupBy("o_orderstatus").agg(F.min(F.year("o_orderdate")).alias("first"), F.max(F.year("o_orderdate")).alias("last"), F.min(F.to_date("o_orderdate")).alias("low"), F.max(F.to_date("o_orderdate")).alias("high"))
SQL["a29_coverage_span"] = "SELECT o_orderstatus, min(year(o_orderdate)) AS first, max(year(o_orderdate)) AS last, CAST(min(o_orderdate) AS DATE) AS low, CAST(max(o_orderdate) AS DATE) AS high FROM orders GROUP BY 1"

# Places: a point for each customer, a rectangle for each nation on a lattice; neighbours share edges.
def points(spark, d):
    k = F.col("c_custkey")
    lon, lat = F.lit(112) + (k * 7919 % 4200) / 100.0, F.lit(-44) + (k * 104729 % 3400) / 100.0
    return table(spark, d, "customer").select("c_custkey", F.when(k % 41 != 0, lon).alias("lon"), F.when(k % 41 != 0, lat).alias("lat"))


PTS = "(SELECT c_custkey, CASE WHEN c_custkey % 41 <> 0 THEN 112 + (c_custkey * 7919 % 4200) / 100.0 END AS lon, CASE WHEN c_custkey % 41 <> 0 THEN -44 + (c_custkey * 104729 % 3400) / 100.0 END AS lat FROM customer)"


def areas(spark, d):
    k = F.col("n_nationkey")
    x, y = F.lit(112.0) + (k % 5) * 8, F.lit(-44.0) + F.floor(k / 5) * 6
    corner = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    ring = F.array(corner(x, y), corner(x + 8, y), corner(x + 8, y + 6), corner(x, y + 6), corner(x, y))
    return table(spark, d, "nation").select(F.lpad(k.cast("string"), 3, "0").alias("code"), F.col("n_name").alias("name"), F.array(ring).alias("rings"))


BOXES = "(SELECT lpad(n_nationkey::VARCHAR, 3, '0') AS code, n_name AS name, 112 + n_nationkey % 5 * 8 AS x, -44 + n_nationkey // 5 * 6 AS y FROM nation)"
INSIDE = f"(SELECT c_custkey, arg_min(b.code, b.code) AS code, arg_min(b.name, b.code) AS name FROM {PTS} p LEFT JOIN {BOXES} b ON lon BETWEEN x AND x + 8 AND lat BETWEEN y AND y + 6 GROUP BY 1)"
P["j07_point_in_area"] = lambda s, d: sp.point_in_area(points(s, d), areas(s, d)).select("c_custkey", "code", "name")
SQL["j07_point_in_area"] = f"SELECT * FROM {INSIDE}"
P["j09_boundary_code_join"] = lambda s, d: table(s, d, "customer").withColumn("code", F.lpad((F.col("c_nationkey") * 2).cast("string"), 3, "0")).join(areas(s, d).select("code", "name"), "code", "left").select("c_custkey", "code", "name")
SQL["j09_boundary_code_join"] = f"SELECT c_custkey, lpad((c_nationkey * 2)::VARCHAR, 3, '0') AS code, b.name FROM customer LEFT JOIN {BOXES} b ON b.code = lpad((c_nationkey * 2)::VARCHAR, 3, '0')"
P["j08_pinned_layer"] = lambda s, d: sp.pinned_layer(orders(s, d).select(F.col("o_orderpriority").alias("layer"), F.to_date("o_orderdate").alias("day"), "o_orderkey"), orders(s, d).where("o_orderkey % 50 = 0").select(F.col("o_orderpriority").alias("layer"), F.to_date("o_orderdate").alias("version")))
SQL["j08_pinned_layer"] = "SELECT f.o_orderpriority AS layer, CAST(f.o_orderdate AS DATE) AS day, f.o_orderkey, (SELECT max(CAST(l.o_orderdate AS DATE)) FROM orders l WHERE l.o_orderkey % 50 = 0 AND l.o_orderpriority = f.o_orderpriority AND CAST(l.o_orderdate AS DATE) <= CAST(f.o_orderdate AS DATE)) AS pinned FROM orders f"
P["a16_grid_heat"] = lambda s, d: r.grid(points(s, d), "lon", "lat", (115.0, -40.0, 150.0, -12.0), 0.5)
_GRID = f"SELECT CAST(floor((lon - 115.0) / 0.5) AS INT) AS i, CAST(floor((lat + 40.0) / 0.5) AS INT) AS j, count(*) AS n FROM {PTS} WHERE lon BETWEEN 115 AND 150 AND lat BETWEEN -40 AND -12"
SQL["a16_grid_heat"] = f"{_GRID} GROUP BY 1, 2"
P["a17_grid_merge"] = lambda s, d: r.grid_merge([r.grid(points(s, d).where(f"c_custkey % 2 = {k}"), "lon", "lat", (115.0, -40.0, 150.0, -12.0), 0.5) for k in (0, 1)])
SQL["a17_grid_merge"] = f"{_GRID} GROUP BY 1, 2"


def _boxes(spark, d):
    return points(spark, d).where("lon is not null").select(F.col("lon").alias("west"), F.col("lat").alias("south"), (F.col("lon") + 1.5).alias("east"), (F.col("lat") + 1).alias("north"))


def _tile_sql(lon, lat):
    x = f"CAST(floor(({lon} + 180) / 360 * pow(2, z)) AS INT)"
    y = f"CAST(floor((1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * pow(2, z)) AS INT)"
    return x, y


P["k12_tile_bins"] = lambda s, d: sp.tile_bins(_boxes(s, d), [3, 6, 8])
_X0, _Y0 = _tile_sql("lon", "(lat + 1)")
_X1, _Y1 = _tile_sql("(lon + 1.5)", "lat")
SQL["k12_tile_bins"] = f"SELECT z AS zoom, x, y, count(*) AS n FROM (SELECT z, x, unnest(generate_series(y0, y1)) AS y FROM (SELECT z, unnest(generate_series(x0, x1)) AS x, y0, y1 FROM (SELECT z, {_X0} AS x0, {_X1} AS x1, {_Y0} AS y0, {_Y1} AS y1 FROM {PTS}, (VALUES (3), (6), (8)) t(z) WHERE lon IS NOT NULL))) GROUP BY 1, 2, 3"
