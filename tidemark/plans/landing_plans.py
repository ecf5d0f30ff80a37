"""Files landed from the given tables and read again, answers with provenance, integrity of stored files, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidemark.operators import checks as k
from tidemark.operators import catalogue as c
from tidemark.operators import query as q
from tidemark.operators import versions as v
from tidemark.plans.common import orders, table
from tidemark.plans.stream_plans import folder
from tidemark.plans.version_plans import A, version_a
from tidemark.sources import described, files, sinks

P, SQL = {}, {}


def _text(df, path):
    """One value a line into the shared folder."""
    df.write.text(path)
    return path


def _short(spark, d):
    line = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey").cast("string")).otherwise(F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus"))
    path = _text(orders(spark, d).select(line.alias("value")), folder(spark, "short"))
    return spark.read.csv(path, schema="key string, status string", mode="PERMISSIVE").fillna("")


P["s02_pad_short_rows"] = _short
SQL["s02_pad_short_rows"] = "SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS status FROM orders"


def _bytes(spark, d):
    """Documents as UTF-8, as Windows-1252 with its own quotes and euro sign, and as Latin-1 with a byte that Windows-1252 leaves undefined."""
    k_, one = F.col("doc_id") % 3, F.regexp_replace("text", "[^\\x00-\\x7F\\xA0-\\xFF]", "?")
    windows = F.encode(F.concat(F.lit("\x93"), one, F.lit("\x94 \x80")), "ISO-8859-1")
    return table(spark, d, "documents").select("doc_id", F.when(k_ == 0, F.encode("text", "UTF-8")).when(k_ == 1, windows).otherwise(F.encode(F.concat(F.lit("é\x81"), one), "ISO-8859-1")).alias("content"))


P["s04_decode_text"] = lambda s, d: _bytes(s, d).select("doc_id", files.decoded(F.col("content")).alias("text"))
_ONE = r"regexp_replace(text, '[^\x{00}-\x{7F}\x{A0}-\x{FF}]', '?', 'g')"
SQL["s04_decode_text"] = f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN '“' || {_ONE} || '” €' ELSE 'é' || chr(129) || {_ONE} END AS text FROM documents"


def _geo(spark, d):
    k_ = F.col("c_custkey")
    geometry = F.when(k_ % 5 == 0, F.lit("null")).when(k_ % 5 == 1, F.format_string('{"type":"MultiPoint","coordinates":[[%d,1.5]]}', k_)).when(k_ % 5 == 2, F.lit('{"type":"MultiPoint","coordinates":[[1,2],[3,4]]}')).otherwise(F.format_string('{"type":"Point","coordinates":[%d,2.5]}', k_))
    feature = F.format_string('{"type":"Feature","properties":{"key":"%d"},"geometry":%s}', k_, geometry)
    some = table(spark, d, "customer").groupBy(F.floor(k_ / 500)).agg(F.array_join(F.collect_list(feature), ",").alias("f"))  # a file for each 500 keys
    path = folder(spark, "geo")
    some.select(F.concat(F.lit('{"features":['), "f", F.lit("]}")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    got = files.geojson_points(spark, path)
    return got.select(got.properties["key"].alias("key"), "lon", "lat")


P["s05_scan_geojson_points"] = _geo
SQL["s05_scan_geojson_points"] = "SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 5 IN (1, 3, 4) THEN c_custkey::DOUBLE END AS lon, CASE c_custkey % 5 WHEN 1 THEN 1.5 WHEN 3 THEN 2.5 WHEN 4 THEN 2.5 END AS lat FROM customer"


def _xml(spark, d):
    line = F.format_string("<rec><key>%d</key><tag>%s</tag><tag>%s</tag></rec>", "o_orderkey", "o_orderstatus", "o_orderpriority")
    some = orders(spark, d).groupBy(F.floor(F.col("o_orderkey") / 2000)).agg(F.array_join(F.collect_list(line), "").alias("r"))  # a file for each 2000 keys
    path = folder(spark, "xml")
    some.select(F.concat(F.lit("<all>"), "r", F.lit("</all>")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return files.xml_records(spark, path, "rec").select("key", "tag")


P["s06_scan_xml_records"] = _xml
SQL["s06_scan_xml_records"] = "SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus || ' | ' || o_orderpriority AS tag FROM orders"


def _json(spark, d):
    one = F.to_json(F.struct(F.struct(F.col("o_orderkey").alias("key")).alias("id"), F.array("o_orderstatus", "o_orderpriority").alias("tags")))
    some = orders(spark, d).groupBy(F.floor(F.col("o_orderkey") / 2000)).agg(F.array_join(F.collect_list(one), ",").alias("r"))  # a file for each 2000 keys
    path = folder(spark, "json")
    some.select(F.concat(F.lit('{"data":{"list":['), "r", F.lit("]}}")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return files.json_records(spark, path, "data.list").select(F.col("`id.key`").alias("key"), "tags")


P["s07_scan_json_records"] = _json
SQL["s07_scan_json_records"] = "SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus || ' | ' || o_orderpriority AS tags FROM orders"


def _members(spark, d):
    """Files of several tables in one folder, told apart by a pattern on their path."""
    path = folder(spark, "members")
    orders(spark, d).select("o_orderkey", F.col("o_orderstatus").alias("t")).write.partitionBy("t").json(path)
    return files.member_tables(spark, path, r"/t=([^/]+)/", "o_orderkey bigint")


P["s16_member_tables"] = _members
SQL["s16_member_tables"] = 'SELECT o_orderstatus AS "table", o_orderkey FROM orders'


def _described(spark, d):
    """Two versions of orders with their provenance, and what the manifest and the rows say of them."""
    path = folder(spark, "described")
    for version, k_ in (("2024-01-01", 5), ("2024-02-01", 3)):
        sinks.write_described(orders(spark, d).where(F.col("o_orderkey") % k_ > 0).select("o_orderkey", "o_orderstatus"), path, "orders", version, {"source": "file", "modulus": k_})
    counted = described.described(spark, path).groupBy("dataset", "version").agg(F.count("*").alias("found"), F.max("o_orderkey").alias("last"))
    said = described.manifest(spark, path).select("dataset", "version", "rows", F.get_json_object("provenance", "$.modulus").alias("modulus"), F.array_join("fields", ",").alias("fields"))
    return said.join(counted, ["dataset", "version"])


P["p32_provenance_columns"] = _described
SQL["p32_provenance_columns"] = " UNION ALL ".join(f"SELECT 'orders' AS dataset, '{v_}' AS version, count(*) AS rows, '{k_}' AS modulus, 'o_orderkey,o_orderstatus' AS fields, count(*) AS found, max(o_orderkey) AS last FROM orders WHERE o_orderkey % {k_} > 0" for v_, k_ in (("2024-01-01", 5), ("2024-02-01", 3)))


def _geo_parquet(spark, d):
    path = folder(spark, "geo-parquet")
    points = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lit(1.0)).alias("lon"), F.lit(2.0).alias("lat"))
    sinks.write_geo_parquet(points, path, "customers", "2024-01-01", "lon", "lat", {"source": "file"})
    return described.described(spark, path).select("c_custkey", "dataset", F.lower(F.hex("geometry")).alias("wkb"))


P["k06_sink_geo_parquet"] = _geo_parquet
SQL["k06_sink_geo_parquet"] = "SELECT c_custkey, 'customers' AS dataset, CASE WHEN c_custkey % 2 = 0 THEN '0101000000000000000000f03f0000000000000040' END AS wkb FROM customer"


def _answers(spark, d):
    """One answer in every format: the lines of each."""
    made = q.aggregate_query(orders(spark, d).withColumn("o_orderpriority", F.when(F.col("o_orderpriority") != "5-LOW", F.concat("o_orderpriority", F.lit(', "x"')))), ["o_orderpriority"], ["count"], order="count.desc", limit=20)
    return reduce(lambda a, b: a.unionByName(b), [sinks.answer_text(made, f, {"version": "2024-01-01"}).select(F.lit(f).alias("format"), "value") for f in ("csv", "ndjson", "json")])


P["k13_answer_formats"] = _answers
_ANSWER = "(SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority || ', \"x\"' END AS p, count(*) AS n FROM orders GROUP BY 1)"
_ROW = "'{\"o_orderpriority\":' || coalesce('\"' || replace(p, '\"', '\\\"') || '\"', 'null') || ',\"count\":' || n || '}'"
SQL["k13_answer_formats"] = f"""SELECT 'csv' AS format, 'o_orderpriority,count' AS value UNION ALL SELECT 'csv', coalesce('"' || replace(p, '"', '""') || '"', '') || ',' || n FROM {_ANSWER} UNION ALL SELECT 'ndjson', {_ROW} FROM {_ANSWER}
 UNION ALL SELECT 'json', '{{"provenance":{{"version":"2024-01-01"}},"rows":[' || string_agg({_ROW}, ',' ORDER BY n DESC, p NULLS FIRST) || ']}}' FROM {_ANSWER}"""


def _stored(spark, d, changed):
    path = folder(spark, "stored")
    text = F.concat(F.col("n_name"), F.when(F.col("n_nationkey") % 5 == 0, F.lit(changed)).otherwise(F.lit("")))
    table(spark, d, "nation").select("n_nationkey", text.alias("value")).write.partitionBy("n_nationkey").option("lineSep", "\n").text(path)
    got = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("path like '%part-%'")
    return got.select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).alias("file"), F.sha2("content", 256).alias("sha256"))


P["g11_checksum_list"] = lambda s, d: _stored(s, d, "")
SQL["g11_checksum_list"] = "SELECT CAST(n_nationkey AS VARCHAR) AS file, sha256(n_name || chr(10)) AS sha256 FROM nation"
P["g06_version_immutability"] = lambda s, d: k.changed_files(_stored(s, d, "!"), _stored(s, d, ""))
SQL["g06_version_immutability"] = "SELECT CAST(n_nationkey AS VARCHAR) AS file, 'changed' AS state FROM nation WHERE n_nationkey % 5 = 0"
EXAMPLES = {"by status": (["o_orderstatus"], ["count"], []), "large": ([], ["max.o_totalprice"], [("o_totalprice", "gt.1000")]), "none": ([], ["count"], [("o_orderkey", "lt.0")]), "broken": (["nowhere"], ["count"], [])}
P["g09_example_answers"] = lambda s, d: k.example_answers(orders(s, d), EXAMPLES)
SQL["g09_example_answers"] = "SELECT 'by status' AS example, true AS valid, count(*) AS rows FROM orders UNION ALL SELECT 'large', true, count(*) FROM orders WHERE o_totalprice > 1000 UNION ALL SELECT 'none', true, 0 UNION ALL SELECT 'broken', false, 0"
P["v14_same_content"] = lambda s, d: v.same_content(version_a(s, d), version_a(s, d).where("o_orderkey % 3000 <> 1 or o_orderstatus = 'O'"), ["o_orderstatus"])
SQL["v14_same_content"] = f"SELECT o_orderstatus, count(*) FILTER (o_orderkey % 3000 = 1 AND o_orderstatus <> 'O') = 0 AS same FROM {A} GROUP BY 1"


def _chain(spark, d):
    """Three versions, each compared with the one before."""
    every = orders(spark, d).select("o_orderkey", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("n")).where((F.col("o_orderkey") % 7) != F.col("n") % 7)
    return v.changes_list(every, ["o_orderkey"], "n")


P["v16_changes_list"] = _chain
SQL["v16_changes_list"] = "SELECT n::INT AS n, count(*) FILTER (o_orderkey % 7 = n - 1) AS added, count(*) FILTER (o_orderkey % 7 = n) AS removed, count(*) FILTER (o_orderkey % 7 <> n AND o_orderkey % 7 <> n - 1) AS kept FROM orders, (VALUES (1), (2)) t(n) GROUP BY 1"
P["v18_whole_or_parts"] = lambda s, d: v.whole_or_parts(table(s, d, "documents").groupBy(F.col("source").alias("dataset")).agg(F.count("*").alias("rows"), F.sum("n_chars").alias("bytes")), 45, 150_000)
SQL["v18_whole_or_parts"] = "SELECT source AS dataset, count(*) <= 45 AND sum(n_chars) <= 150000 AS whole FROM documents GROUP BY 1"


def _states(spark, d):
    """Each catalogue record's state: served, chosen, closed with a reason, or votable."""
    k_ = F.col("doc_id")
    r = table(spark, d, "documents").select(F.concat(F.lit("r"), k_.cast("string")).alias("id"), F.get(F.array(F.lit("CC BY 4.0"), F.lit("All rights reserved"), F.lit(None).cast("string")), (k_ % 3).cast("int")).alias("licence"), (F.col("n_chars") > 0).alias("has_files"))
    entries = table(spark, d, "documents").where("doc_id % 7 = 0").select(F.concat(F.lit("r"), k_.cast("string")).alias("id"), (k_ % 14 == 0).alias("live"))
    return c.record_states(r, entries)


P["j15_record_state"] = _states
SQL["j15_record_state"] = "SELECT 'r' || doc_id AS id, CASE WHEN doc_id % 14 = 0 THEN 'served' WHEN doc_id % 7 = 0 THEN 'chosen' WHEN doc_id % 3 = 1 THEN 'closed: licence' WHEN NOT n_chars > 0 THEN 'closed: no files' WHEN doc_id % 3 = 2 THEN 'closed: licence unknown' ELSE 'votable' END AS state FROM documents"


def _suggested(spark, d):
    k_ = F.col("c_custkey")
    word = F.get(F.array(F.lit("Department of Health (NSW)"), F.lit("City of Perth Council"), F.lit("Bureau of Statistics"), F.lit("Shire of Ararat"), F.lit("Acme Pty Ltd")), (k_ % 5).cast("int"))
    orgs = table(spark, d, "customer").select(F.concat(word, F.lit(" "), k_.cast("string")).alias("org"))
    old = table(spark, d, "customer").where("c_custkey % 5 = 4 or c_custkey % 35 in (3, 10)").select(F.concat(word, F.lit(" "), k_.cast("string")).alias("org"), F.when(k_ % 35 == 10, "NSW").when(k_ % 35 == 3, "VIC").alias("jurisdiction"))
    return c.suggest_publishers(orgs, old)


P["j17_publisher_suggest"] = _suggested
_NAME = "CASE c_custkey % 5 WHEN 0 THEN 'Department of Health (NSW) ' WHEN 1 THEN 'City of Perth Council ' WHEN 2 THEN 'Bureau of Statistics ' ELSE 'Shire of Ararat ' END || c_custkey"
SQL["j17_publisher_suggest"] = f"""WITH n AS (SELECT min({_NAME}) AS health FROM customer WHERE c_custkey % 35 = 10), v AS (SELECT min({_NAME}) AS shire FROM customer WHERE c_custkey % 35 = 3)
 SELECT {_NAME} AS org, CASE c_custkey % 5 WHEN 0 THEN 'NSW' END AS jurisdiction, CASE c_custkey % 5 WHEN 0 THEN 'state' WHEN 1 THEN 'local' WHEN 2 THEN 'national' ELSE 'local' END AS level, CASE c_custkey % 5 WHEN 0 THEN health END AS merge,
 CASE c_custkey % 5 WHEN 0 THEN 'names NSW; a name of state bodies' || coalesce('; same body as ' || health, '') WHEN 1 THEN 'a name of local bodies' WHEN 2 THEN 'a name of national bodies' ELSE 'a name of local bodies' || coalesce('; same name as ' || shire || ', not merged', '') END AS why
 FROM customer, n, v WHERE c_custkey % 5 <> 4 AND c_custkey % 35 NOT IN (3, 10)"""
