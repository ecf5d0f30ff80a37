"""Filters, row queries and aggregates over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import query as q
from tidemark.operators.exact import exact_sums
from tidemark.operators.checks import running_total
from tidemark.plans.common import lineitem, orders, table

LI = "(SELECT *, l_orderkey * 10 + l_linenumber AS _pos FROM lineitem)"
KEYS = ["l_orderkey", "l_linenumber", "l_quantity"]
P, SQL = {}, {}


def _where(name, conditions, sql, keys=KEYS):
    P[name] = lambda spark, d: q.where(lineitem(spark, d), conditions).select(*keys)
    SQL[name] = f"SELECT {', '.join(keys)} FROM lineitem WHERE {sql}"


_where("f01_compare", [("l_quantity", "gte.10"), ("l_quantity", "lt.20.5"), ("l_returnflag", "neq.N"), ("l_shipdate", "gt.1995-01-01")], "l_quantity >= 10 AND l_quantity < 20.5 AND l_returnflag <> 'N' AND l_shipdate > TIMESTAMP '1995-01-01'")
_where("f02_in_list", [("l_returnflag", "in.(A,R)"), ("l_linenumber", "in.(1,3)")], "l_returnflag IN ('A','R') AND l_linenumber IN (1,3)")
_where("f06_and_all", [("l_quantity", "gte.5"), ("l_quantity", "lte.9"), ("l_linestatus", "eq.O")], "l_quantity >= 5 AND l_quantity <= 9 AND l_linestatus = 'O'")

_NULLED = "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderstatus END"


def _nulled(spark, d):
    return orders(spark, d).withColumn("status", F.when(F.col("o_orderkey") % 19 != 0, F.col("o_orderstatus")))


P["f03_is_null"] = lambda s, d: q.where(_nulled(s, d), [("status", "is.null")]).select("o_orderkey")
SQL["f03_is_null"] = f"SELECT o_orderkey FROM orders WHERE ({_NULLED}) IS NULL"
P["f04_like"] = lambda s, d: q.where(table(s, d, "part"), [("p_name", "like.*A*"), ("p_type", "not.ilike.*_x*")]).select("p_partkey", "p_name")
SQL["f04_like"] = r"SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%a%' AND NOT lower(p_type) LIKE '%\_x%' ESCAPE '\'"
P["f05_not"] = lambda s, d: q.where(_nulled(s, d), [("status", "not.eq.F")]).select("o_orderkey", "status")
SQL["f05_not"] = f"SELECT o_orderkey, status FROM (SELECT *, {_NULLED} AS status FROM orders) WHERE NOT status = 'F'"
P["f07_where_map"] = lambda s, d: q.where_map(_nulled(s, d), {"status": ["F", "O"], "o_totalprice": {"min": 1000, "max": 200000}, "o_orderpriority": {"like": "*H*"}}).select("o_orderkey")
SQL["f07_where_map"] = f"SELECT o_orderkey FROM (SELECT *, {_NULLED} AS status FROM orders) WHERE status IN ('F','O') AND o_totalprice BETWEEN 1000 AND 200000 AND lower(o_orderpriority) LIKE '%h%'"
P["f08_newest_value"] = lambda s, d: q.newest(orders(s, d).withColumn("year", F.when(F.col("o_orderkey") % 7 == 0, F.lit("unknown")).otherwise(F.year("o_orderdate").cast("string"))), "year").select("o_orderkey", "year")
_YEAR = "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS year FROM orders)"
SQL["f08_newest_value"] = f"SELECT o_orderkey, year FROM {_YEAR} WHERE year = (SELECT coalesce(max(year) FILTER (regexp_matches(year, '^[0-9]')), max(year)) FROM {_YEAR})"
P["f09_typed_param"] = lambda s, d: q.where(table(s, d, "customer"), [("c_custkey", "lt.100"), ("c_name", "gt.C")]).select("c_custkey", "c_name")
SQL["f09_typed_param"] = "SELECT c_custkey, c_name FROM customer WHERE c_custkey < 100 AND c_name > 'C'"

P["q01_rows_query"] = lambda s, d: q.rows_query(lineitem(s, d), [("l_returnflag", "eq.R")], KEYS, "", 500, 100)
SQL["q01_rows_query"] = f"SELECT {', '.join(KEYS)} FROM {LI} WHERE l_returnflag = 'R' ORDER BY _pos LIMIT 501 OFFSET 100"
P["q02_order_spec"] = lambda s, d: q.rows_query(_nulled(s, d), [], ["o_orderkey", "status"], "status.asc,o_totalprice.desc", 300)
SQL["q02_order_spec"] = f"SELECT o_orderkey, status FROM (SELECT *, {_NULLED} AS status FROM orders) ORDER BY status ASC NULLS FIRST, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 301"
P["q03_page"] = lambda s, d: q.page(orders(s, d).orderBy("o_orderkey"), 50, 200).select("o_orderkey", "o_totalprice")
SQL["q03_page"] = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 51 OFFSET 200"
P["q04_top_k"] = lambda s, d: q.rows_query(lineitem(s, d), [], KEYS, "l_extendedprice.desc", 100)
SQL["q04_top_k"] = f"SELECT {', '.join(KEYS)} FROM {LI} ORDER BY l_extendedprice DESC NULLS LAST, _pos LIMIT 101"
P["q05_matched_count"] = lambda s, d: q.matched(lineitem(s, d), [("l_quantity", "gt.25")])
SQL["q05_matched_count"] = "SELECT count(*) AS total FROM lineitem WHERE l_quantity > 25"
P["q06_first_matches"] = lambda s, d: q.rows_query(lineitem(s, d), [("l_linestatus", "eq.F"), ("l_quantity", "eq.7")], KEYS, "", 20)
SQL["q06_first_matches"] = f"SELECT {', '.join(KEYS)} FROM {LI} WHERE l_linestatus = 'F' AND l_quantity = 7 ORDER BY _pos LIMIT 21"
P["q07_profile_sort"] = lambda s, d: running_total(_nulled(s, d).withColumn("one", F.lit(1)), "one", q.profile_order(["status"], ["o_orderkey"])).select("o_orderkey", "status", F.col("_s").alias("place"))
SQL["q07_profile_sort"] = f"SELECT o_orderkey, status, row_number() OVER (ORDER BY status NULLS LAST, o_orderkey NULLS LAST) AS place FROM (SELECT *, {_NULLED} AS status FROM orders)"
P["q08_spread_sample"] = lambda s, d: q.spread_sample(orders(s, d), 40, "o_orderpriority").select("o_orderkey", "o_orderpriority", "turn")
SQL["q08_spread_sample"] = "SELECT o_orderkey, o_orderpriority, turn FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS turn FROM orders) ORDER BY turn, o_orderkey LIMIT 40"
P["w01_row_number"] = lambda s, d: lineitem(s, d).withColumn("n", F.expr("row_number() over (partition by l_suppkey order by l_shipdate, _pos)")).select("_pos", "n")
SQL["w01_row_number"] = f"SELECT _pos, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, _pos) AS n FROM {LI}"


def _money(df, *names):
    return df.withColumns({n: F.round(n, 2) for n in names})


P["a01_group_aggregate"] = lambda s, d: _money(q.aggregate_query(lineitem(s, d), ["l_returnflag", "l_linestatus"], ["count", "sum.l_quantity", "avg.l_extendedprice", "min.l_discount", "max.l_tax"]), "avg_l_extendedprice")
SQL["a01_group_aggregate"] = "SELECT l_returnflag, l_linestatus, count(*) AS count, sum(l_quantity) AS sum_l_quantity, round(avg(l_extendedprice), 2) AS avg_l_extendedprice, min(l_discount) AS min_l_discount, max(l_tax) AS max_l_tax FROM lineitem GROUP BY ALL"
P["a02_metric_spec"] = lambda s, d: q.aggregate_query(_nulled(s, d).withColumn("big", F.col("o_totalprice") > 150000), ["o_orderpriority"], ["count.status", "sum.big", "max.o_orderdate"])
SQL["a02_metric_spec"] = f"SELECT o_orderpriority, count({_NULLED}) AS count_status, sum(CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END)::BIGINT AS sum_big, max(o_orderdate) AS max_o_orderdate FROM orders GROUP BY 1"
P["a03_aggregate_order"] = lambda s, d: q.aggregate_query(lineitem(s, d), ["l_suppkey"], ["count"], [("l_quantity", "gte.30")], "count.desc", 25)
SQL["a03_aggregate_order"] = "SELECT l_suppkey, count(*) AS count FROM lineitem WHERE l_quantity >= 30 GROUP BY 1 ORDER BY count DESC, l_suppkey LIMIT 26"
# Sizes from 1e-9 to 1e12 and both signs, so that neither decimals nor a plain sum of doubles would do.
_WIDE = "l_extendedprice / (1 + l_orderkey % 7) * CASE l_linenumber WHEN 1 THEN 1e-9 WHEN 2 THEN -1e6 ELSE 0.1 END"
P["a04_exact_sum"] = lambda s, d: exact_sums(lineitem(s, d).withColumn("wide", F.expr(_WIDE.replace("1e-9", "1e-9D").replace("-1e6", "-1e6D").replace("0.1", "0.1D"))), ["l_returnflag"], {"total": F.col("l_extendedprice"), "wide_total": F.col("wide")}).select("l_returnflag", F.round("total", 4).alias("total"), F.round("wide_total", 0).alias("wide_total"))
SQL["a04_exact_sum"] = f"SELECT l_returnflag, round(fsum(l_extendedprice), 4) AS total, round(fsum(({_WIDE})::DOUBLE), 0) AS wide_total FROM lineitem GROUP BY 1"
