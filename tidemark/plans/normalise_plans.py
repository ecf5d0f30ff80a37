"""Typing, cleaning and stacking over text derived from the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import normalise as n
from tidemark.plans.common import lineitem, orders, table

P, SQL = {}, {}
#: Messy text made of lineitem by arithmetic, the same in both engines.
MESSY = """SELECT l_orderkey * 10 + l_linenumber AS _pos, CAST(l_orderkey AS {s}) AS " Id ",
 CASE WHEN l_linenumber % 7 = 0 THEN '  ' WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN '<5' WHEN l_orderkey % 5 = 0 THEN '1,234' WHEN l_orderkey % 13 = 0 THEN 'n/a' ELSE CAST(l_partkey AS {s}) END AS "Count",
 CASE WHEN l_linestatus = 'O' THEN ' Yes' WHEN l_orderkey % 3 = 0 THEN '' ELSE 'No ' END AS "Flag",
 CASE WHEN l_orderkey % 4 = 0 THEN '30/06/2021' WHEN l_orderkey % 4 = 1 THEN '2020-01-31' WHEN l_orderkey % 4 = 2 THEN '' ELSE '1/2/2019' END AS "When", 'held' AS "Extra" FROM lineitem"""
ENTRY = n.Entry(
    key=("id",),
    fields=(n.Field("id", "Id", "integer"), n.Field("count", "Count", "integer", nulls=("n/a",)), n.Field("flag", "Flag", "boolean", ("Yes",), ("No",)), n.Field("when", "When", "date", formats=("d/M/yyyy", "yyyy-MM-dd"))),
    suppression=("<5",),
    omit=("Extra",),
)


def messy(spark, d):
    li = lineitem(spark, d)
    k, i = F.col("l_orderkey"), F.col("l_linenumber")
    count = F.when(i % 7 == 0, "  ").when((k + i) % 11 == 0, "<5").when(k % 5 == 0, "1,234").when(k % 13 == 0, "n/a").otherwise(F.col("l_partkey").cast("string"))
    flag = F.when(F.col("l_linestatus") == "O", " Yes").when(k % 3 == 0, "").otherwise("No ")
    when = F.when(k % 4 == 0, "30/06/2021").when(k % 4 == 1, "2020-01-31").when(k % 4 == 2, "").otherwise("1/2/2019")
    return li.select("_pos", k.cast("string").alias(" Id "), count.alias("Count"), flag.alias("Flag"), when.alias("When"), F.lit("held").alias("Extra"))


M = "(" + MESSY.format(s="VARCHAR") + ")"
_COUNT = "nullif(nullif(trim(\"Count\"), ''), 'n/a')"
_INT = f"TRY_CAST(CASE WHEN regexp_matches({_COUNT}, '^-?[0-9]{{1,3}}(,[0-9]{{3}})+(\\.[0-9]+)?$') THEN replace({_COUNT}, ',', '') ELSE nullif({_COUNT}, '<5') END AS BIGINT)"
_DATE = "CASE \"When\" WHEN '30/06/2021' THEN DATE '2021-06-30' WHEN '2020-01-31' THEN DATE '2020-01-31' WHEN '1/2/2019' THEN DATE '2019-02-01' END"

P["p01_allowlist_project"] = lambda s, d: n.allowlist(messy(s, d), ENTRY)[0]
SQL["p01_allowlist_project"] = f"SELECT _pos, \" Id \" AS id, \"Count\" AS count, \"Flag\" AS flag, \"When\" AS \"when\" FROM {M}"
P["p02_renamed_source"] = lambda s, d: n.allowlist(messy(s, d).select("_pos", F.col("Count").alias("Old count")), n.Entry(("c",), (n.Field("c", "Number", was=("Total", "Old count")),)))[0]
SQL["p02_renamed_source"] = f'SELECT _pos, "Count" AS c FROM {M}'
P["p03_since_null"] = lambda s, d: n.normalise(messy(s, d).select("_pos", " Id "), n.Entry(("id",), (n.Field("id", "Id", "integer"), n.Field("grade", "Grade", "number", since="2024-01-01"))), "2023-06-30").drop("suppressed")
SQL["p03_since_null"] = f'SELECT _pos, CAST(" Id " AS BIGINT) AS id, CAST(NULL AS DOUBLE) AS grade FROM {M}'
P["p04_blank_to_null"] = lambda s, d: messy(s, d).select("_pos", n.blank_to_null(F.col("Flag")).alias("flag"))
SQL["p04_blank_to_null"] = f"SELECT _pos, nullif(trim(\"Flag\"), '') AS flag FROM {M}"
P["p05_null_markers"] = lambda s, d: messy(s, d).select("_pos", n.null_markers(n.blank_to_null(F.col("Count")), ("n/a",)).alias("count"))
SQL["p05_null_markers"] = f"SELECT _pos, {_COUNT} AS count FROM {M}"
P["p06_suppression_flags"] = lambda s, d: n.normalise(messy(s, d), ENTRY).select("_pos", "count", F.array_join("suppressed", ";").alias("suppressed"))
SQL["p06_suppression_flags"] = f"SELECT _pos, {_INT} AS count, CASE WHEN {_COUNT} = '<5' THEN 'count' ELSE '' END AS suppressed FROM {M}"
P["p07_marker_json"] = lambda s, d: messy(s, d).select("_pos", n.markers({"count": n.blank_to_null(F.col("Count")), "flag": n.blank_to_null(F.col("Flag"))}, ("<5", "n/a")).alias("markers"))
SQL["p07_marker_json"] = f"""SELECT _pos, CASE WHEN trim("Count") IN ('<5','n/a') THEN '{{"count":"' || trim("Count") || '"}}' END AS markers FROM {M}"""
P["p08_thousands_number"] = lambda s, d: messy(s, d).select("_pos", n.plain_number(F.col("Count")).alias("count"))
SQL["p08_thousands_number"] = f"SELECT _pos, CASE WHEN \"Count\" = '1,234' THEN '1234' ELSE \"Count\" END AS count FROM {M}"
P["p09_strict_cast"] = lambda s, d: n.misfits(messy(s, d), n.Entry(("c",), (n.Field("c", "Count", "integer"), n.Field("f", "Flag", "boolean", ("Yes",), ()))))
SQL["p09_strict_cast"] = f"""SELECT field, count(*) AS n, string_agg(DISTINCT cell, ' | ' ORDER BY cell) AS examples FROM (
 SELECT 'c' AS field, trim("Count") AS cell FROM {M} WHERE trim("Count") IN ('<5', 'n/a') UNION ALL SELECT 'f', trim("Flag") FROM {M} WHERE trim("Flag") = 'No') GROUP BY 1"""
P["p10_boolean_sets"] = lambda s, d: messy(s, d).select("_pos", n.boolean(n.blank_to_null(F.col("Flag")), ("Yes",), ("No",)).alias("flag"))
SQL["p10_boolean_sets"] = f"SELECT _pos, CASE trim(\"Flag\") WHEN 'Yes' THEN true WHEN 'No' THEN false END AS flag FROM {M}"
P["p11_multi_format_date"] = lambda s, d: messy(s, d).select("_pos", n.multi_format(n.blank_to_null(F.col("When")), ("d/M/yyyy", "yyyy-MM-dd"), "date").alias("at"))
SQL["p11_multi_format_date"] = f"SELECT _pos, {_DATE} AS at FROM {M}"
P["p12_infer_field"] = lambda s, d: n.infer(messy(s, d).withColumns({"Code": F.lpad(F.col(" Id "), 9, "0"), "Price": F.concat(F.col(" Id "), F.lit(".5"))}), [" Id ", "Count", "Flag", "When", "Code", "Price", "Extra"])
SQL["p12_infer_field"] = "SELECT * FROM (VALUES (' Id ', 'integer'), ('Count', 'string'), ('Flag', 'boolean'), ('When', 'string'), ('Code', 'string'), ('Price', 'number'), ('Extra', 'string')) t(\"column\", type) WHERE (SELECT count(*) FROM lineitem) > 0"
P["p14_narrow_int32"] = lambda s, d: n.int_ranges(lineitem(s, d).withColumn("wide", F.col("_pos") * 100_000), ["l_orderkey", "l_partkey", "wide"])
SQL["p14_narrow_int32"] = "SELECT c AS \"column\", low, high, high < 2147483648 AS fits FROM (SELECT 'l_orderkey' AS c, min(l_orderkey) AS low, max(l_orderkey) AS high FROM lineitem UNION ALL SELECT 'l_partkey', min(l_partkey), max(l_partkey) FROM lineitem UNION ALL SELECT 'wide', min((l_orderkey * 10 + l_linenumber) * 100000), max((l_orderkey * 10 + l_linenumber) * 100000) FROM lineitem)"
P["p15_widen"] = lambda s, d: n.widen(table(s, d, "events").select("event_id", "ts").withColumn("small", (F.col("event_id") % 100).cast("int")))
SQL["p15_widen"] = "SELECT event_id, date_trunc('second', ts) AS ts, event_id % 100 AS small FROM events"
P["p16_iso_view"] = lambda s, d: n.iso_view(orders(s, d).select("o_orderkey", "o_orderdate", F.to_date("o_orderdate").alias("day")))
SQL["p16_iso_view"] = "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders"
P["p17_slugify_value"] = lambda s, d: table(s, d, "part").select("p_partkey", n.slug(F.when(F.col("p_partkey") % 9 == 0, None).when(F.col("p_partkey") % 7 == 0, " ").otherwise(F.col("p_type"))).alias("slug"))
SQL["p17_slugify_value"] = "SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '_null' WHEN p_partkey % 7 = 0 THEN '_blank' ELSE regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END AS slug FROM part"
_WORDS = {"30 June 2025": "2025-06-30", "June 3, 2024": "2024-06-03", "5/7/2023": "2023-07-05", "2022-02-28": "2022-02-28", "February 2024": "2024-02-29", "someday": None}


def _worded(spark, d, words):
    names = F.array(*[F.lit(w) for w in words])
    return orders(spark, d).select("o_orderkey", F.get(names, (F.col("o_orderkey") % len(words)).cast("int")).alias("wording"))


def _sql_case(words, kind):
    return " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else kind.format(v)) for i, v in enumerate(words))


P["p18_as_at_date"] = lambda s, d: _worded(s, d, list(_WORDS)).select("o_orderkey", n.as_at(F.col("wording")).alias("at"))
SQL["p18_as_at_date"] = f"SELECT o_orderkey, CASE o_orderkey % {len(_WORDS)} {_sql_case(_WORDS.values(), chr(68) + 'ATE ' + chr(39) + '{}' + chr(39))} END AS at FROM orders"
_FISCAL = {"2011-12": 2011, "2008/09": 2008, "FY2010": 2009, "FY12-13": 2012, "2014-2015": 2014, "2010": None, "Total": None}
P["p19_fiscal_start"] = lambda s, d: _worded(s, d, list(_FISCAL)).select("o_orderkey", n.fiscal_start(F.col("wording")).alias("year"))
SQL["p19_fiscal_start"] = f"SELECT o_orderkey, CASE o_orderkey % {len(_FISCAL)} {_sql_case(_FISCAL.values(), '{}')} END AS year FROM orders"
P["p20_code_zero_pad"] = lambda s, d: n.zero_pad(table(s, d, "nation").select("n_name", F.col("n_nationkey").alias("code")), "code", table(s, d, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("ref")), "ref")
SQL["p20_code_zero_pad"] = "SELECT n_name, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code FROM nation"
_NATURAL = {"January": 1, "Dec": 12, "Tuesday": 2, "10-19 years": 10, "Under 5": 5, "other": None}
P["p21_natural_order"] = lambda s, d: _worded(s, d, list(_NATURAL)).select("o_orderkey", n.natural_rank(F.col("wording")).cast("bigint").alias("rank"))
SQL["p21_natural_order"] = f"SELECT o_orderkey, CASE o_orderkey % {len(_NATURAL)} {_sql_case(_NATURAL.values(), '{}')} END AS rank FROM orders"


def _shown(spark, d):
    rows = orders(spark, d).select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("order_year"), F.when(F.col("o_orderkey") % 11 > 0, F.col("o_totalprice") > 100000).alias("large"), (F.col("o_orderkey") * 3_000_000_000).alias("big"))
    fits = [r.column for r in n.int_ranges(rows, ["o_custkey", "big"]).where("fits").collect()]  # one row a column
    return n.display(rows, {"order_year": "year", "large": "large order"}, tuple(fits)).select("*", F.typeof("big").alias("big_kind"))


P["p22_display_cast"] = _shown
SQL["p22_display_cast"] = "SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS VARCHAR) AS year, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_totalprice > 100000 THEN 'Yes' ELSE 'No' END AS \"large order\", o_orderkey * 3000000000 AS big, CASE WHEN (SELECT max(o_orderkey) * 3000000000 FROM orders) < 2147483648 THEN 'int' ELSE 'bigint' END AS big_kind FROM orders"
_NUMBER = "page_id / 7.0e0 * power(10, page_id % 25 - 8)"
P["p23_preview_cell"] = lambda s, d: table(s, d, "pages").select("page_id", n.preview(F.col("html")).alias("preview"), n.preview_number(F.expr(_NUMBER)).alias("number"))
SQL["p23_preview_cell"] = rf"SELECT page_id, CASE WHEN length(t) <= 120 THEN t ELSE rtrim(substring(t, 1, 119)) || '…' END AS preview, printf('%.12g', {_NUMBER}) AS number FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g')) AS t FROM pages)"
P["s03_drop_blank_rows"] = lambda s, d: n.drop_blank_rows(messy(s, d).select("_pos", F.when(F.col("_pos") % 3 == 0, " ").otherwise(F.col("Flag")).alias("a"), F.when(F.col("_pos") % 2 == 0, "").otherwise(F.col("Flag")).alias("b")))
SQL["s03_drop_blank_rows"] = f"SELECT * FROM (SELECT _pos, CASE WHEN _pos % 3 = 0 THEN ' ' ELSE \"Flag\" END AS a, CASE WHEN _pos % 2 = 0 THEN '' ELSE \"Flag\" END AS b FROM {M}) WHERE trim(a) <> '' OR trim(b) <> ''"
P["s08_explode_list"] = lambda s, d: table(s, d, "documents").select("doc_id", F.explode(F.filter(F.split("lang", ""), lambda x: x != "")).alias("letter"))
SQL["s08_explode_list"] = "SELECT doc_id, unnest(string_split(lang, '')) AS letter FROM documents"
_MONTHS = ["1995-01-01", "1995-02-01", "1995-03-01"]


def _wide(spark, d):
    made = {m: F.sum(F.when(F.date_trunc("month", "o_orderdate") == F.lit(m).cast("timestamp_ntz"), 1)).cast("string") for m in _MONTHS}
    return orders(spark, d).groupBy("o_orderpriority").agg(*[c.alias(m) for m, c in made.items()])


P["s10_dated_unpivot"] = lambda s, d: n.dated_unpivot(_wide(s, d), ["o_orderpriority"])
SQL["s10_dated_unpivot"] = "SELECT p.o_orderpriority, m.date, CAST(n AS VARCHAR) AS cell FROM (SELECT DISTINCT o_orderpriority FROM orders) p CROSS JOIN (VALUES " + ", ".join(f"(DATE '{m}')" for m in _MONTHS) + ") m(date) LEFT JOIN (SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1, 2) c ON c.o_orderpriority = p.o_orderpriority AND c.date = m.date"
P["s13_footnote_marks"] = lambda s, d: table(s, d, "part").select("p_partkey", *[c.alias(a) for c, a in zip(n.footnote(F.concat("p_brand", F.when(F.col("p_partkey") % 3 == 0, F.lit(" 12")).otherwise(F.lit("")))), ("cell", "note"))])
SQL["s13_footnote_marks"] = "SELECT p_partkey, p_brand AS cell, CASE WHEN p_partkey % 3 = 0 THEN '12' END AS note FROM part"


def _stacked(spark, d):
    """Rows of two files under the labels in their names, each with how many rows were read and how many of them repeat one."""
    o = table(spark, d, "orders")
    rows, counts = n.stacked_files({"file-2023.csv": o.where("o_orderkey % 2 = 0").select("o_custkey", "o_orderpriority"), "file-2024.csv": o.where("o_orderkey % 3 = 0").select("o_orderpriority", "o_custkey")}, r"-(\d{4})\.", "file")
    return rows.crossJoin(F.broadcast(counts))  # one row


P["s14_stack_files"] = _stacked
_FILES = "(SELECT o_custkey, o_orderpriority, '2023' AS file FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderpriority, '2024' FROM orders WHERE o_orderkey % 3 = 0)"
SQL["s14_stack_files"] = f"SELECT DISTINCT *, (SELECT count(*) FROM {_FILES}) AS read, (SELECT count(*) FROM {_FILES}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {_FILES})) AS repeated FROM {_FILES}"
P["s18_records_view"] = lambda s, d: n.records_view(orders(s, d).select("o_orderkey", (F.col("o_orderkey") % 2 == 0).alias("even"), F.when(F.col("o_orderkey") % 5 == 0, float("nan")).otherwise(F.col("o_totalprice")).alias("price"), F.to_date("o_orderdate").alias("day"), F.array(F.lit("a"), F.lit("b")).alias("suppressed")))
SQL["s18_records_view"] = "SELECT o_orderkey, CAST(o_orderkey % 2 = 0 AS INT) AS even, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price, strftime(o_orderdate, '%Y-%m-%d') AS day, 'a;b' AS suppressed FROM orders"
P["w02_forward_fill"] = lambda s, d: n.forward_fill(table(s, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise("").alias("head")), "head", ["user_id"], "event_id")
SQL["w02_forward_fill"] = "SELECT user_id, event_id, last_value(head IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS head FROM (SELECT user_id, event_id, CASE WHEN event_id % 3 = 1 THEN event_type END AS head FROM events)"
