"""A record catalogue made of documents and pages, votes and logs made of events, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.lineage import shared_dir
from tidemark.operators import catalogue as c
from tidemark.operators import postings
from tidemark.operators.cube_store import exists, file_hash
from tidemark.plans.common import orders, table

P, SQL = {}, {}
#: Titles as portals state them; a part of the documents' own source follows some, so that rules and not whole titles decide.
WORDING = [
    "Creative Commons Attribution 3.0 Australia", "Creative Commons Attribution 4.0 International", "Creative Commons Non-Commercial 3.0 Australia", "CC-BY-ND-4.0", "Other (Open)", "Other (Not Open)", "Access on request",
    "Closed licence, Creative Commons excluded", "CC-BY-SA-4.0", "Attribution 3.0 Australia (CC BY 3.0 AU)", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International", "ODBL-1",
    "Open Data Commons Public Domain Dedication and License (PDDL)", "PDDL", "cc-zero", "CC Zero", "Public Domain", "notspecified", "  CC   BY 2.5 AU ", "Creative Commons Attribution", "Custom (Active Acceptance)", "", None,
]
FORMAT = ["csv, XLSX", "json;CSV", "Excel (.xlsx) / Geo JSON", "Esri Shapefile", ".csv,CSV", "", "WFS;ESRI REST", "SHP, TAB, KMZ", "MS Excel/xlsm", "..zip; .Zip"]


def _pick(values, k):
    return F.get(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int"))


def _case(values, k, quote="'{}'"):
    return f"CASE {k} % {len(values)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else str(v).upper() if isinstance(v, bool) else quote.format(v)) for i, v in enumerate(values)) + " END"


def _licence_sql(w):
    t = rf"lower(trim(regexp_replace(coalesce({w}, ''), '\s+', ' ', 'g')))"
    keep = f"trim({w})"
    whole = " ".join(f"WHEN {t} = '{k}' THEN '{v}'" for k, v in c.TITLES.items())
    worded = " ".join(f"WHEN regexp_matches({t}, '{p}') THEN " + (keep if v is None else f"'{v}'") for p, v in c.WORDINGS)
    term = " || ".join(f"CASE WHEN regexp_matches({t}, '{p}') THEN '{x}' ELSE '' END" for p, x in c.TERMS)
    v = rf"regexp_extract({t}, '\d\.\d')"
    tail = f"CASE WHEN {v} = '' THEN '' WHEN {v} IN ('2.5', '3.0') AND regexp_matches({t}, '{c.AUSTRALIAN}') THEN '-' || {v} || '-AU' ELSE '-' || {v} END"
    return f"CASE WHEN {t} = '' THEN '' {whole} {worded} WHEN regexp_matches({t}, '{c.COMMONS}') THEN 'CC-BY' || {term} || {tail} ELSE {keep} END"


def _open_sql(x):
    ids = ", ".join(f"'{i}'" for i in c.OPEN_IDS)
    return f"CASE WHEN {x} = '' THEN NULL ELSE {x} IN ({ids}) OR (starts_with({x}, 'CC-BY') AND NOT contains({x}, '-NC') AND NOT contains({x}, '-ND')) END"


def _formats_sql(f):
    alias = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in c.FORMATS.items())
    bare = rf"list_filter(list_transform(regexp_split_to_array(upper({f}), '[,/;]'), lambda x: regexp_replace(trim(x), '^\.+', '')), lambda x: x <> '')"
    return f"list_sort(list_distinct(list_transform({bare}, lambda x: CASE x {alias} ELSE x END)))"


_AFTER = "CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE ' (' || source || ')' END"


def records(spark, d):
    k = F.col("doc_id")
    title = F.split("text", "\n")[0]
    name = lambda x: F.concat_ws("-", "source", x.cast("string"))
    return table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("r"), k.cast("string")).alias("id"), title.alias("title"), F.col("source").alias("org"), F.upper("source").alias("org_title"), F.col("lang").alias("state"),
        F.concat(_pick(WORDING, k), F.when(k % 3 == 0, "").when(k % 3 == 1, " ").otherwise(F.concat(F.lit(" ("), "source", F.lit(")")))).alias("licence"), _pick(FORMAT, k).alias("format"), F.when(k % 20 == 10, F.concat(F.lit("gone"), k.cast("string"))).when(k % 10 == 0, F.concat(F.lit("r"), (k - 1).cast("string"))).alias("copy_of"), F.concat(F.lit("data."), "source", F.lit(".example")).alias("source_host"), name(k).alias("name"), F.array("lang", "source").alias("topics"),
    )


R = f"""(SELECT doc_id, 'r' || doc_id AS id, split_part(text, chr(10), 1) AS title, source AS org, upper(source) AS org_title, lang AS state, {_case(WORDING, 'doc_id')} || {_AFTER} AS licence, {_case(FORMAT, 'doc_id')} AS format,
 CASE WHEN doc_id % 20 = 10 THEN 'gone' || doc_id WHEN doc_id % 10 = 0 THEN 'r' || (doc_id - 1) END AS copy_of, 'data.' || source || '.example' AS source_host, source || '-' || doc_id AS name FROM documents)"""
_TKEY = "regexp_replace(lower(title), '[^a-z0-9]+', '', 'g')"

P["p24_licence_id"] = lambda s, d: records(s, d).select("id", c.licence_id(F.col("licence")).alias("licence_id"))
SQL["p24_licence_id"] = f"SELECT id, {_licence_sql('licence')} AS licence_id FROM {R}"
P["p25_licence_open"] = lambda s, d: records(s, d).select("id", c.licence_open(c.licence_id(F.col("licence"))).alias("open"))
SQL["p25_licence_open"] = f"SELECT id, {_open_sql('l')} AS open FROM (SELECT id, {_licence_sql('licence')} AS l FROM {R})"
P["p26_format_list"] = lambda s, d: records(s, d).select("id", F.array_join(c.formats(F.col("format")), ";").alias("formats"))
SQL["p26_format_list"] = f"SELECT id, array_to_string({_formats_sql('format')}, ';') AS formats FROM {R}"
P["p27_plain_summary"] = lambda s, d: table(s, d, "pages").select("page_id", c.summary(F.col("html")).alias("summary"))
# The references that the pages hold; an ampersand comes last.
_NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "''", "nbsp": " ", "copy": "©", "reg": "®", "hellip": "…", "mdash": "—", "ndash": "–", "laquo": "«", "raquo": "»", "bull": "•", "middot": "·", "#39": "''", "#34": '"', "#169": "©", "#160": " ", "#x27": "''", "amp": "&"}
_PLAIN = "regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g')"
for _k, _v in _NAMED.items():
    _PLAIN = f"replace({_PLAIN}, '&{_k};', '{_v}')"
_FLAT = rf"trim(regexp_replace(regexp_replace(regexp_replace({_PLAIN}, '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[*_#`>|]+', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"
SQL["p27_plain_summary"] = rf"SELECT page_id, CASE WHEN length(t) <= 280 THEN t ELSE regexp_replace(regexp_replace(substring(t, 1, 280), ' [^ ]*$', ''), '[,;:.]+$', '') || '…' END AS summary FROM (SELECT page_id, {_FLAT} AS t FROM pages)"
P["p28_record_key"] = lambda s, d: table(s, d, "pages").select("page_id", c.record_key(F.lit("portal"), F.col("url")).alias("key"), c.bare_url(F.col("url")).alias("bare"))
_BARE = r"regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z]+://(www\.)?', ''), '[?#].*$', ''), '/+$', '')"
SQL["p28_record_key"] = f"SELECT page_id, substring(regexp_replace(regexp_replace(lower('portal-' || url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64) AS key, {_BARE} AS bare FROM pages"
CADENCE = [
    "Updated daily (no new data on weekends)", "weekly", "hourly, checked weekly", "every 30 minutes", "delivered quarterly", "extended monthly release", "irregular, several times a year", "Twice a year", "half-yearly", "annually, in March", "one file a year",
    "closed", "Historical, closed year", "historical, not updated since 2019", "no new readings since April 2025", "weekly, with historical records from 1990", "monthly as contracts are disclosed", "fortnightly", "a census every five years", "live", "as required", "weekly until further notice", None,
]
UNTIL = ["", "June ", "December ", "july ", "summer "]
TODAY = "2024-07-15"


def _cadence(spark, d):
    """Wordings spread over orders; every fourth ends with a date of its own."""
    k = F.col("o_orderkey")
    until = F.concat(F.lit(" until "), _pick(UNTIL, k % 11), (2019 + k % 9).cast("string"))
    text = F.concat(_pick(CADENCE, k % 1009), F.when(k % 4 == 0, until).otherwise(""))
    return orders(spark, d).select("o_orderkey", c.per_year(text, F.lit(TODAY).cast("date")).alias("rate"))


P["p29_cadence_rate"] = _cadence
_WORDED = f"lower(trim({_case(CADENCE, '(o_orderkey % 1009)')} || CASE WHEN o_orderkey % 4 = 0 THEN ' until ' || {_case(UNTIL, '(o_orderkey % 11)')} || (2019 + o_orderkey % 9) ELSE '' END))"
_MONTH = f"coalesce(nullif(list_position({c.MONTHS}, substring(regexp_extract(t, '{c.UNTIL}', 1), 1, 3)), 0), 12)"
_OVER = f"regexp_matches(t, '{c.UNTIL}') AND make_date(regexp_extract(t, '{c.UNTIL}', 2)::INT, {_MONTH}::INT, 1) < date_trunc('month', DATE '{TODAY}')"
SQL["p29_cadence_rate"] = f"SELECT o_orderkey, CASE WHEN regexp_matches(t, '{c.ENDED}') OR ({_OVER}) THEN 0.0 " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN {n}" for p, n in c.RATES) + f" END::DOUBLE AS rate FROM (SELECT o_orderkey, {_WORDED} AS t FROM orders)"
P["p30_url_locate"] = lambda s, d: table(s, d, "pages").select("page_id", c.locate(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://www.Data.example/dataset/d"), F.col("page_id").cast("string"), F.lit("/resource?x=1"))).otherwise(F.col("url"))).alias("p")).select("page_id", "p.*")
SQL["p30_url_locate"] = r"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'data.example' ELSE regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]+)', 1), '^www\.', '') END AS host, CASE WHEN page_id % 2 = 0 THEN 'dataset' ELSE 'page' END AS kind, CASE WHEN page_id % 2 = 0 THEN 'd' || page_id ELSE regexp_extract(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '[?#].*$', ''), '([^/]+)/*$', 1) END AS value FROM pages"
P["f10_catalogue_filter"] = lambda s, d: c.catalogue_filter(records(s, d), "rc1", "en", ("en", "de")).select("id")
SQL["f10_catalogue_filter"] = f"SELECT id FROM {R} WHERE contains(lower(org_title), 'rc1') AND state = 'en'"
COPIES = f"""(WITH r AS {R}, own AS (SELECT id, {_TKEY} AS t FROM r WHERE copy_of IS NULL), uniq AS (SELECT t, min(id) AS id FROM own WHERE t <> '' GROUP BY t HAVING count(*) = 1)
 SELECT k.id, coalesce(o.id, i.id, u.id) AS original, CASE WHEN o.id IS NOT NULL THEN 'id' WHEN i.id IS NOT NULL THEN 'item' WHEN u.id IS NOT NULL THEN 'title' WHEN source_host IN ('data.src1.example', 'data.src2.example') THEN 'host' END AS how
 FROM (SELECT *, {_TKEY} AS t FROM r WHERE copy_of IS NOT NULL) k LEFT JOIN own o ON o.id = k.copy_of LEFT JOIN own i ON doc_id % 3 = 0 AND i.id = 'r' || (doc_id - 2) LEFT JOIN uniq u ON u.t = k.t)"""


def _copies(spark, d):
    k = F.col("doc_id")
    items = table(spark, d, "documents").where("doc_id % 3 = 0").select(F.concat(F.lit("r"), k.cast("string")).alias("id"), F.concat(F.lit("r"), (k - 2).cast("string")).alias("item"))
    hosts = table(spark, d, "documents").where("source in ('src1', 'src2')").select(F.concat(F.lit("data."), "source", F.lit(".example")).alias("host"))
    return c.copies(records(spark, d), items, hosts)


P["j10_copy_match"] = _copies
SQL["j10_copy_match"] = f"SELECT * FROM {COPIES}"
P["j12_unmatched_copies"] = lambda s, d: c.unmatched_copies(records(s, d).select("id", "title", "org", "copy_of"), _copies(s, d)).select("id")
SQL["j12_unmatched_copies"] = f"SELECT id FROM {R} WHERE copy_of IS NULL OR id IN (SELECT id FROM {COPIES} WHERE how IS NULL)"


def _pages(spark, d):
    return table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), "url")


P["j11_original_match"] = lambda s, d: c.resolve_urls(table(s, d, "pages").select(F.concat(F.lit("HTTP://"), c.bare_url(F.col("url")), F.lit("/?from=copy")).alias("asked")), _pages(s, d))
SQL["j11_original_match"] = f"SELECT 'HTTP://' || {_BARE} || '/?from=copy' AS asked, m.id AS record FROM pages JOIN (SELECT {_BARE} AS u, min('p' || page_id) AS id FROM pages GROUP BY 1) m ON m.u = {_BARE}"
P["r04_resolve_url"] = lambda s, d: c.resolve_urls(table(s, d, "pages").select(F.concat(F.lit("https://portal.example/dataset/p"), F.col("page_id").cast("string")).alias("asked")), _pages(s, d))
SQL["r04_resolve_url"] = "SELECT 'https://portal.example/dataset/p' || page_id AS asked, 'p' || page_id AS record FROM pages"


def _aliases(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").where("c_custkey % 5 <> 0").select(k.alias("old"), (k + 1).alias("new"))


P["j13_alias_closure"] = lambda s, d: c.alias_roots(_aliases(s, d))
SQL["j13_alias_closure"] = "SELECT c_custkey AS key, (c_custkey // 5 + 1) * 5 AS root FROM customer WHERE c_custkey % 5 <> 0"


def _votes(spark, d):
    return table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("key"))


V = "(SELECT user_id AS key, count(*) AS votes FROM events WHERE event_type = 'purchase' GROUP BY 1)"
P["a21_vote_tally"] = lambda s, d: c.tally(_votes(s, d), c.alias_roots(_aliases(s, d)), table(s, d, "customer").where("c_custkey % 35 = 0").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") + 1000000).alias("root")))
_TO = "CASE WHEN user_id % 5 <> 0 AND user_id IN (SELECT c_custkey FROM customer) THEN (user_id // 5 + 1) * 5 ELSE user_id END"
SQL["a21_vote_tally"] = f"SELECT CASE WHEN k % 35 = 0 AND k IN (SELECT c_custkey FROM customer) THEN k + 1000000 ELSE k END AS key, count(*) AS votes FROM (SELECT {_TO} AS k FROM events WHERE event_type = 'purchase') GROUP BY 1"


def _register(spark, d):
    return table(spark, d, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 8 == 0).alias("live"))


P["j19_candidate_tasks"] = lambda s, d: c.candidate_tasks(c.tally(_votes(s, d)), table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title")), _register(s, d), 2)
SQL["j19_candidate_tasks"] = f"SELECT key, c_name AS title, votes FROM {V} JOIN customer ON c_custkey = key WHERE votes >= 2 AND key % 4 <> 0"
P["j20_backlog_votes"] = lambda s, d: c.backlog_votes(_register(s, d), c.tally(_votes(s, d)))
SQL["j20_backlog_votes"] = f"SELECT c_custkey AS key, coalesce(votes, 0) AS votes, true AS owned FROM customer LEFT JOIN {V} ON key = c_custkey WHERE c_custkey % 8 = 4 UNION ALL SELECT key, votes, false FROM {V} WHERE key NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0)"


def _tasks(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").where("c_custkey % 3 = 0").select(k.alias("key"), (k % 9 != 0).alias("open"), (k % 2 == 0).alias("done"))


P["j21_reconcile_actions"] = lambda s, d: c.reconcile(c.tally(_votes(s, d)), _tasks(s, d), 150)
SQL["j21_reconcile_actions"] = f"""SELECT key, action FROM (SELECT coalesce(w.key, t.key) AS key, CASE WHEN t.key IS NULL AND r <= 150 THEN 'create' WHEN t.key IS NULL OR NOT open THEN NULL WHEN done THEN 'close: done' WHEN r IS NULL THEN 'close: gone' WHEN r <= 150 THEN 'update' ELSE 'close: over the cap' END AS action
 FROM (SELECT key, row_number() OVER (ORDER BY votes DESC, key) AS r FROM {V}) w FULL JOIN (SELECT c_custkey AS key, c_custkey % 9 <> 0 AS open, c_custkey % 2 = 0 AS done FROM customer WHERE c_custkey % 3 = 0) t ON t.key = w.key) WHERE action IS NOT NULL"""
P["j14_dataset_to_record"] = lambda s, d: c.dataset_to_record(_entries(s, d), records(s, d).select("id", "name", F.concat(F.lit("page"), "doc_id").alias("page"), F.concat(F.lit("url"), "doc_id").alias("url")))


def _entries(spark, d):
    k = F.col("doc_id")
    return table(spark, d, "documents").where("doc_id % 2 = 0").select(F.when(k % 3 == 0, F.concat_ws("-", "source", "doc_id")).otherwise(F.concat(F.lit("entry"), k)).alias("name"), F.when(k % 5 == 0, F.concat(F.lit("page"), k + 1)).alias("page"), F.when(k % 7 == 0, F.concat(F.lit("url"), k)).alias("url"))


SQL["j14_dataset_to_record"] = "SELECT CASE WHEN doc_id % 3 = 0 THEN source || '-' || doc_id ELSE 'entry' || doc_id END AS name, CASE WHEN doc_id % 3 = 0 THEN 'r' || doc_id WHEN doc_id % 5 = 0 AND doc_id + 1 IN (SELECT doc_id FROM documents) THEN 'r' || (doc_id + 1) WHEN doc_id % 7 = 0 THEN 'r' || doc_id END AS record, CASE WHEN doc_id % 3 = 0 THEN 'name' WHEN doc_id % 5 = 0 AND doc_id + 1 IN (SELECT doc_id FROM documents) THEN 'page' WHEN doc_id % 7 = 0 THEN 'url' END AS how FROM documents WHERE doc_id % 2 = 0"
P["j16_publisher_resolve"] = lambda s, d: c.resolve_publishers(records(s, d).withColumn("org", F.concat(F.lit("The "), "org_title")), table(s, d, "documents").where("source in ('src1', 'src2')").select(F.concat(F.lit("The "), F.upper("source")).alias("org"), F.concat(F.lit("dept-"), "source").alias("publisher")).distinct())
SQL["j16_publisher_resolve"] = "SELECT DISTINCT 'The ' || upper(source) AS org, CASE WHEN source IN ('src1','src2') THEN 'dept-' || source ELSE lower(source) END AS publisher, CASE WHEN source IN ('src1','src2') THEN 'curated' ELSE 'name' END AS how FROM documents"
_SUBJECT = "list_distinct(list_filter(list_transform(regexp_extract_all(lower(text), '[a-z][a-z'']+'), lambda x: regexp_replace(x, 's$', '')), lambda x: length(x) >= 3 AND x NOT IN (" + ", ".join(f"'{w}'" for w in c.COMMON) + ")))"


def _subjects(spark, d):
    k = F.col("item_id")
    return table(spark, d, "benchmark").select(k.alias("id"), F.concat(F.lit("o"), (k % 7).cast("string")).alias("org"), F.when(k % 5 > 0, k % 3).alias("collection"), F.array(k % 2, 2 + k % 3).alias("topics"), c.subject_words(F.col("text")).alias("words"))


P["j18_related_by_words"] = lambda s, d: c.related(_subjects(s, d))
SQL["j18_related_by_words"] = f"""WITH s AS (SELECT item_id AS id, item_id % 7 AS org, CASE WHEN item_id % 5 > 0 THEN item_id % 3 END AS collection, item_id % 2 AS one, item_id % 3 AS two, {_SUBJECT} AS w FROM benchmark),
 z AS (SELECT a.id, b.id AS other, len(list_intersect(a.w, b.w)) AS shared FROM s a JOIN s b ON a.org <> b.org AND a.id <> b.id AND (a.one = b.one OR a.two = b.two) AND coalesce(a.collection <> b.collection, true))
 SELECT id, other, shared FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shared DESC, other) AS r FROM z WHERE shared > 0) WHERE r <= 12"""
P["w04_rank_top"] = lambda s, d: c.top_formats(records(s, d).select("org", c.formats(F.col("format")).alias("formats")), 5)
SQL["w04_rank_top"] = f"SELECT org, format, n, rank FROM (SELECT org, format, count(*) AS n, row_number() OVER (PARTITION BY org ORDER BY count(*) DESC, format) AS rank FROM (SELECT org, unnest({_formats_sql('format')}) AS format FROM {R}) GROUP BY 1, 2) WHERE rank <= 5"
P["a20_publisher_stats"] = lambda s, d: c.publisher_stats(records(s, d).select("org", c.licence_open(c.licence_id(F.col("licence"))).alias("open"), c.formats(F.col("format")).alias("formats")))
SQL["a20_publisher_stats"] = f"""WITH r AS (SELECT org, {_open_sql('l')} AS open, {_formats_sql('format')} AS f FROM (SELECT *, {_licence_sql('licence')} AS l FROM {R})), e AS (SELECT org, format, count(*) AS n FROM (SELECT org, unnest(f) AS format FROM r) WHERE format <> '' GROUP BY 1, 2),
 t AS (SELECT *, row_number() OVER (PARTITION BY org ORDER BY n DESC, format) AS k FROM e) SELECT b.org, b.records, b.open, x.formats FROM (SELECT org, count(*) AS records, count(*) FILTER (open) AS open FROM r GROUP BY 1) b LEFT JOIN (SELECT org, string_agg(format, ';' ORDER BY k) AS formats FROM t WHERE k <= 3 GROUP BY 1) x USING (org)"""
P["a22_usage_counts"] = lambda s, d: c.usage_counts(table(s, d, "events").select(F.when(F.col("event_id") % 50 == 0, F.lit('{"event": "cut')).otherwise(F.to_json(F.struct(F.col("event_type").alias("event"), "user_id"))).alias("line")))
SQL["a22_usage_counts"] = "SELECT CASE WHEN event_id % 50 = 0 THEN 'unreadable' ELSE event_type END AS class, count(*) AS n FROM events GROUP BY 1"


def _files(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("dataset"), F.col("n_chars").alias("size"), F.sha2("text", 256).alias("sha"))


P["a24_shared_content"] = lambda s, d: c.shared_content(_files(s, d))
SQL["a24_shared_content"] = "SELECT dataset, sum(n)::BIGINT AS files, count(*) AS \"distinct\", sum((n - 1) * size)::BIGINT AS saved FROM (SELECT source AS dataset, n_chars AS size, text, count(*) AS n FROM documents GROUP BY 1, 2, 3) GROUP BY 1"


def _versions(spark, d):
    return orders(spark, d).select(F.col("o_orderpriority").alias("dataset"), F.to_date("o_orderdate").alias("version"), F.floor("o_totalprice").alias("bytes"))


P["a23_growth_projection"] = lambda s, d: c.growth(orders(s, d).groupBy(F.col("o_orderpriority").alias("dataset")).agg(F.lit(12).alias("declared")), _versions(s, d), "1996-06-30").select("dataset", F.round("per_version", 4).alias("per_version"), "per_year", F.round("yearly_bytes", 0).alias("yearly_bytes"))
P["a25_version_rates"] = lambda s, d: c.growth(orders(s, d).groupBy(F.col("o_orderpriority").alias("dataset")).agg(F.lit(1_000_000).alias("declared")), _versions(s, d), "1996-06-30").select("dataset", "per_year")
_G = "SELECT o_orderpriority AS dataset, avg(floor(o_totalprice)) AS p, greatest(count(*) FILTER (CAST(o_orderdate AS DATE) > DATE '1996-06-30' - 365), {}) AS y FROM orders GROUP BY 1"
SQL["a23_growth_projection"] = f"SELECT dataset, round(p, 4) AS per_version, y AS per_year, round(p * y, 0) AS yearly_bytes FROM ({_G.format(12)})"
SQL["a25_version_rates"] = f"SELECT dataset, y AS per_year FROM ({_G.format(1000000)})"
P["a28_weekly_activity"] = lambda s, d: c.weekly_activity(orders(s, d).select(F.col("o_custkey").alias("dataset"), F.to_date("o_orderdate").alias("day")))
SQL["a28_weekly_activity"] = "SELECT count(*) FILTER (f >= m) AS first, count(*) FILTER (f < m AND l >= m) AS again FROM (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS f, max(CAST(o_orderdate AS DATE)) AS l FROM orders GROUP BY 1), (SELECT max(CAST(o_orderdate AS DATE)) - 6 AS m FROM orders)"


def _searched(spark, d):
    whole = records(spark, d).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    known = whole.withColumn("_licence", c.licence_id(F.col("licence")))  # a step of its own: told once a row, not wherever it is used
    return known.withColumn("votable", F.coalesce(c.licence_open(F.col("_licence")), F.lit(False))).drop("_licence")


def _ranked_sql(rows, words, fields, first=None, limit=20):
    """BM25 as columns: term counts weighted by field, lengths alike, one row of totals."""
    tokens = lambda f: f"list_filter(regexp_split_to_array(lower(coalesce({f}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    counts = ", ".join(" + ".join(f"{w} * len(list_filter(_{f}, lambda x: x = '{x}'))" for f, w in fields.items()) + f" AS t{i}" for i, x in enumerate(words))
    length = " + ".join(f"{w} * len(_{f})" for f, w in fields.items())
    idf = lambda i: f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5))"
    score = " + ".join(f"{idf(i)} * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * l / a))" for i in range(len(words)))
    found = " AND ".join(f"t{i} > 0" for i in range(len(words)))
    return f"""WITH r AS (SELECT id, {first or 'true'} AS first, {', '.join(f'{tokens(f)} AS _{f}' for f in fields)} FROM {rows}), c AS (SELECT id, first, {length} AS l, {counts} FROM r),
 s AS (SELECT count(*) AS n, avg(l) AS a, {', '.join(f'count(*) FILTER (t{i} > 0) AS d{i}' for i in range(len(words)))} FROM c)
 SELECT id, {score} AS score FROM c, s WHERE {found} ORDER BY first DESC, score DESC, id LIMIT {limit}"""


P["r01_ranked_search"] = lambda s, d: c.ranked_search(c.catalogue_filter(_searched(s, d), states=("en", "de")), "the that", {"title": 8.0, "text": 1.0, "org": 3.0}, first="votable")
SQL["r01_ranked_search"] = _ranked_sql(f"(SELECT *, coalesce({_open_sql('l')}, false) AS votable FROM (SELECT r.*, text, {_licence_sql('licence')} AS l FROM {R} r JOIN documents d ON d.doc_id = r.doc_id) WHERE state IN ('en', 'de'))", ["the", "that"], {"title": 8.0, "text": 1.0, "org": 3.0}, "votable")


def _indexed(spark, d):
    """The same search from an index of all records, made once for the files it is made of."""
    path = f"{shared_dir(spark)}/segments-{file_hash(spark, f'{d}/documents.parquet')}"
    if not exists(spark, f"{path}/totals/_SUCCESS"):
        postings.build_index(_searched(spark, d), path, ["title", "text", "org"], ["state", "votable"])
    return postings.search_index(spark, path, "the that", {"title": 8.0, "text": 1.0, "org": 3.0}, {"state": ["en", "de"]}, first="votable")


P["r01b_postings_search"] = _indexed
SQL["r01b_postings_search"] = SQL["r01_ranked_search"]
P["r02_served_search"] = lambda s, d: c.ranked_search(records(s, d).where("copy_of is null"), "the of", {"title": 8.0, "org": 3.0})
SQL["r02_served_search"] = _ranked_sql(f"(SELECT * FROM {R} WHERE copy_of IS NULL)", ["the", "of"], {"title": 8.0, "org": 3.0})
P["r03_scan_search"] = lambda s, d: c.scan_search(records(s, d), "SRC1", ["title", "org"]).select("id")
SQL["r03_scan_search"] = f"SELECT id FROM {R} WHERE contains(lower(title || ' ' || org), 'src1')"
