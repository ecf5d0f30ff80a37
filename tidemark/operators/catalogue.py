"""Record catalogues: cleaning of licences, formats and keys, copies and originals, aliases, publishers, votes, tasks and usage."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions.lineage import checkpointed

# Whole licence titles of a portal's register and the ids they stand for.
TITLES = {
    "other (open)": "other-open",
    "other (not open)": "other-closed",
    "other (public domain)": "PDM",
    "other (attribution)": "other-at",
    "other (non-commercial)": "other-nc",
    "open data commons attribution license": "ODC-BY-1.0",
    "open data commons open database license (odbl)": "ODBL-1.0",
    "open data commons public domain dedication and license (pddl)": "PDDL-1.0",
    "license not specified": "",
    "licence not specified": "",
    "notspecified": "",
}
# Wordings inside a title and the ids they stand for, first match wins; None keeps the title as it is.
WORDINGS = [
    (r"\bnot open\b|\bclosed\b", None),
    (r"\bodbl\b|odc-odbl|open database licen[cs]e", "ODBL-1.0"),
    (r"\bodc-by\b|open data commons attribution", "ODC-BY-1.0"),
    (r"\bpddl\b", "PDDL-1.0"),
    (r"zero|^(?:cc0|cc-zero|cc0-1\.0)$", "CC0-1.0"),
    (r"public domain|^pdm$", "PDM"),
]
# What a Creative Commons title is known by, the terms its id lists, the versions with an Australian port.
COMMONS = r"creative commons|\bcc\b|^cc-"
TERMS = [(r"non[- ]?commercial|\bnc\b", "-NC"), (r"no[ -]?deriv|\bnd\b", "-ND"), (r"share[ -]?alike|\bsa\b", "-SA")]
AUSTRALIAN, PORTED = r"australia|-au$| au", ["2.5", "3.0"]
# Ids, besides those of the CC-BY family, that let anyone publish again with changes.
OPEN_IDS = ["CC0-1.0", "PDM", "PDDL-1.0", "ODC-BY-1.0", "ODBL-1.0", "other-open", "other-at"]
# Format aliases.
FORMATS = {
    "EXCEL": "XLSX", "MS EXCEL": "XLSX", "EXCEL (.XLSX)": "XLSX", "XLSM": "XLSX", "ESRI SHAPEFILE": "SHP", "SHAPEFILE": "SHP", "SHZ": "SHP", "GEO JSON": "GEOJSON",
    "ESRI REST": "API", "REST": "API", "ARCGIS REST": "API", "ARCGIS_REST": "API", "WFS": "API", "ESRI FILE GEODATABASE": "FGDB", "ESRI_SHP": "SHP",
}
# Wordings that say a table has ended, of the month and year it goes until, and of versions in a year, first match wins.
ENDED = r"^(historical, )?(closed|no longer updated|not updated)\b|\bno new readings\b"
UNTIL = r"\buntil (?:([a-z]+) )?(\d{4})\b"
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
RATES = [
    (r"\bchecked weekly\b", 52.0),
    (r"every \d+ minutes|\bhourly\b|\bcontinual\b|\blive\b|\bdaily\b", 365.0),
    (r"\bweekly\b", 52.0),
    (r"\bfortnightly\b", 26.0),
    (r"\bmonthly\b|\bthrough the year\b", 12.0),
    (r"\bquarterly\b|several times a year", 4.0),
    (r"twice a year|half-yearly", 2.0),
    (r"\byearly\b|\bannually\b|\ba year\b|school year|one or two years", 1.0),
    (r"\bcensus\b", 0.2),
    (r"\bclosed\b|\bhistorical\b|\bno longer\b|\bnot updated\b", 0.0),
]


def first_match(c: Column, table: list[tuple[str, object]]) -> Column:
    made = None
    for pattern, value in table:
        value = value if isinstance(value, Column) else F.lit(value)
        made = F.when(c.rlike(pattern), value) if made is None else made.when(c.rlike(pattern), value)
    return made


def licence_id(c: Column) -> Column:
    """A licence's id from its title; the title itself where nothing tells an id; empty where none is stated."""
    title = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    low = F.lower(title)
    version = F.regexp_extract(low, r"(\d\.\d)", 1)
    terms = [F.when(low.rlike(pattern), F.lit(term)).otherwise(F.lit("")) for pattern, term in TERMS]
    port = F.when(low.rlike(AUSTRALIAN) & version.isin(PORTED), F.lit("-AU")).otherwise(F.lit(""))
    commons = F.concat(F.lit("CC-BY"), *terms, F.when(version != "", F.concat(F.lit("-"), version)).otherwise(F.lit("")), port)
    whole = F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv])
    worded = first_match(low, [(p, F.trim(c) if v is None else v) for p, v in WORDINGS] + [(COMMONS, commons)])
    return F.when(low == "", F.lit("")).otherwise(F.coalesce(whole[low], worded, F.trim(c)))


def licence_open(c: Column) -> Column:
    """Whether a licence id lets anyone publish again with changes; NULL where no licence is stated."""
    family = c.startswith("CC-BY")
    return F.when(F.coalesce(c, F.lit("")) == "", None).otherwise(c.isin(OPEN_IDS) | (family & ~c.contains("-NC") & ~c.contains("-ND")))


def formats(c: Column) -> Column:
    """Format names of a wording: split, upper case, no dots before them, aliases, once each, sorted."""
    bare = F.transform(F.split(F.upper(c), "[,/;]"), lambda x: F.regexp_replace(F.trim(x), r"^\.+", ""))
    alias = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    return F.array_sort(F.array_distinct(F.transform(F.filter(bare, lambda x: x != ""), lambda x: F.coalesce(alias[x], x))))


def unescaped(c: Column) -> Column:
    """Text with its character references (named or numbered, ended by ;) decoded, each once; unknown ones stay."""
    named = F.create_map(*[F.lit(x) for name, code in sorted({**name2codepoint, "apos": 39}.items()) for x in (f"&{name};", chr(code))])
    seen = F.array_distinct(F.regexp_extract_all(c, F.lit(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);"), F.lit(0)))
    ampersand = lambda x: F.lower(x).isin("&amp;", "&#38;", "&#x26;")
    # Ampersands last, so that what they bring together is not decoded again.
    order = F.concat(F.filter(seen, lambda x: ~ampersand(x)), F.filter(seen, ampersand))

    def decoded(x: Column) -> Column:
        hexadecimal = F.regexp_extract(x, r"^&#[xX]([0-9a-fA-F]+);$", 1)
        code = F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10).cast("int")).otherwise(F.try_to_number(F.regexp_extract(x, r"^&#([0-9]+);$", 1), F.lit("9999999")).cast("int"))
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.coalesce(named[x], F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")), x)

    return F.aggregate(order, c, lambda text, x: F.replace(text, x, decoded(x)))


def summary(c: Column, most: int = 280) -> Column:
    """Mark-up and Markdown as one line of text, links by their words, cut after a word with an ellipsis."""
    text = unescaped(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "))
    text = F.regexp_replace(F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1"), "[*_#`>|]+", " ")
    line = F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))
    short = F.regexp_replace(F.regexp_replace(F.substring(line, 1, most), " [^ ]*$", ""), "[,;:.]+$", "")
    return F.when(F.length(line) <= most, line).otherwise(F.concat(short, F.lit("…")))


def record_key(*parts: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws("-", *parts)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 64)


def bare_url(c: Column) -> Column:
    """Host and path alone: no scheme, www., query, fragment or slash at the end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), r"^[a-z]+://(www\.)?", ""), r"[?#].*$", ""), "/+$", "")


def title_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def per_year(c: Column, today: Column | None = None) -> Column:
    """Versions a year that a wording names: 0 where it says that they have ended (or goes until a month before today's), NULL where it names no rate."""
    text = F.lower(F.trim(c))
    today = F.current_date() if today is None else today
    year = F.regexp_extract(text, UNTIL, 2)
    named = F.array_position(F.lit(MONTHS), F.substring(F.regexp_extract(text, UNTIL, 1), 1, 3)).cast("int")
    month = F.when(named > 0, named).otherwise(12)
    over = (year != "") & (F.try_to_number(year, F.lit("9999")).cast("int") * 12 + month < F.year(today) * 12 + F.month(today))
    return F.when(text.rlike(ENDED) | F.coalesce(over, F.lit(False)), F.lit(0.0)).otherwise(first_match(text, RATES))


def locate(c: Column) -> Column:
    """(host, kind, value) a portal's URL names: a dataset, an organisation, or the last part of its path."""
    path = F.regexp_replace(F.regexp_replace(c, r"^[a-z]+://[^/]+", ""), r"[?#].*$", "")
    named = F.regexp_extract(path, r"/(dataset|organization)/([^/]+)", 1)
    value = F.when(named != "", F.regexp_extract(path, r"/(dataset|organization)/([^/]+)", 2)).otherwise(F.regexp_extract(path, r"([^/]+)/*$", 1))
    return F.struct(F.regexp_replace(F.regexp_extract(F.lower(c), r"^[a-z]+://([^/?#]+)", 1), r"^www\.", "").alias("host"), F.when(named == "", "page").otherwise(named).alias("kind"), value.alias("value"))


def catalogue_filter(df: DataFrame, publisher: str | None = None, topic: str | None = None, states: tuple[str, ...] = ()) -> DataFrame:
    if publisher:
        df = df.where(F.contains(F.lower("org_title"), F.lit(publisher.lower())))
    if topic:
        df = df.where(F.array_contains("topics", topic))
    return df.where(F.col("state").isin(*states)) if states else df


def copies(records: DataFrame, items: DataFrame | None = None, hosts: DataFrame | None = None) -> DataFrame:
    """id, original, how for records that copy another: by the id they name, by the item map, by a title that one original has, or by their source's host.

    records: id, title, org, copy_of, and source_host where hosts are given. items (id, item) maps copies to originals; hosts (host) lists the portals
    that are read directly: a copy from one of them is a copy though its original is not told. Titles that several originals
    share decide nothing; a copy that nothing tells has no original and no how.
    """
    own = records.where("copy_of is null").select(F.col("id").alias("_id"), title_key(F.col("title")).alias("_t"))
    unique = own.groupBy("_t").agg(F.count("*").alias("_n"), F.min("_id").alias("by_title")).where("_n = 1 and _t <> ''").drop("_n")
    host = F.col("source_host") if hosts is not None else F.lit(None).cast("string")
    made = records.where("copy_of is not null").select("id", "copy_of", title_key(F.col("title")).alias("_t"), host.alias("host"))
    known = lambda name, by: own.select(F.col("_id").alias(name), F.col("_id").alias(by))
    made = made.join(known("copy_of", "by_id"), "copy_of", "left").join(unique, "_t", "left")
    made = made.join(items.select("id", "item"), "id", "left").join(known("item", "by_item"), "item", "left") if items is not None else made.withColumn("by_item", F.lit(None).cast("string"))
    made = made.join(hosts.select("host").distinct().withColumn("by_host", F.lit(True)), "host", "left") if hosts is not None else made.withColumn("by_host", F.lit(None).cast("boolean"))
    how = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_item").isNotNull(), "item").when(F.col("by_title").isNotNull(), "title").when(F.col("by_host"), "host")
    return made.select("id", F.coalesce("by_id", "by_item", "by_title").alias("original"), how.alias("how"))


def unmatched_copies(records: DataFrame, found: DataFrame) -> DataFrame:
    """Copies that nothing tells go back to the records."""
    lost = found.where("how is null").select("id")
    return records.where("copy_of is null").unionByName(records.join(lost, "id", "left_semi"))


def alias_roots(aliases: DataFrame) -> DataFrame:
    """key, root: where each chain of aliases (old, new) ends, by pointer doubling; a chain into a cycle ends at the cycle's least key.

    Each round doubles the links a row has followed, so the rounds are at most the logarithm of the number of aliases; a root
    that is still an alias then is in a cycle. Of several new keys for one old key the least counts.
    """
    step = aliases.groupBy(F.col("old").alias("key")).agg(F.min("new").alias("root")).withColumn("least", F.col("key"))
    for _ in range(max(1, step.count().bit_length())):
        step = checkpointed(step)
        ahead = step.select(F.col("key").alias("root"), F.col("root").alias("_next"), F.col("least").alias("_least"))
        joined = step.join(ahead, "root", "left")
        step = joined.select("key", F.coalesce("_next", "root").alias("root"), F.least("least", "_least").alias("least"))
        if not joined.where("_next is not null").head(1):
            break
    step = checkpointed(step)
    cycle = step.select(F.col("key").alias("root"), F.col("least").alias("_cycle"))
    return step.select("key", "root").join(cycle, "root", "left").select("key", F.coalesce("_cycle", "root").alias("root"))


def tally(votes: DataFrame, aliases: DataFrame | None = None, dropped: DataFrame | None = None) -> DataFrame:
    """key, votes with aliases (key, root) and dropped copies (key, root) counted for the key they stand for."""
    folds = [f for f in (aliases, dropped) if f is not None]
    counted = votes.groupBy("key").agg(F.count("*").alias("votes"))  # before the joins, so each key is one row
    for f in folds:
        counted = counted.join(f.select("key", F.col("root").alias("_to")), "key", "left").withColumn("key", F.coalesce("_to", "key")).drop("_to")
    return counted.groupBy("key").agg(F.sum("votes").alias("votes"))


def top_formats(records: DataFrame, k: int = 3) -> DataFrame:
    """org, format, n, rank: the k commonest formats of each publisher, ties by name."""
    each = records.select("org", F.explode("formats").alias("format")).groupBy("org", "format").agg(F.count("*").alias("n"))
    return each.withColumn("rank", F.row_number().over(W.partitionBy("org").orderBy(F.desc("n"), "format"))).where(F.col("rank") <= k)


def publisher_stats(records: DataFrame) -> DataFrame:
    """org, records, open, formats: counts by publisher and its three commonest formats."""
    base = records.groupBy("org").agg(F.count("*").alias("records"), F.count_if(F.col("open")).alias("open"))
    named = top_formats(records).groupBy("org").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "format"))), lambda x: x["format"]), ";").alias("formats"))
    return base.join(named, "org", "left")


def resolve_publishers(records: DataFrame, curated: DataFrame) -> DataFrame:
    """org, publisher, how: curated first, else the organisation's own cleaned name."""
    orgs = records.select("org").distinct()
    own = F.regexp_replace(F.regexp_replace(F.lower("org"), "[^a-z0-9]+", "-"), "^(the-)?|-+$", "")
    return orgs.join(curated.select("org", F.col("publisher").alias("_p")), "org", "left").select("org", F.coalesce("_p", own).alias("publisher"), F.when(F.col("_p").isNotNull(), "curated").otherwise("name").alias("how"))


# Words that name a place, a time or the shape of a table, which say nothing of its subject.
COMMON = """a an and as at by data dataset each for from in into its of on or per the to with every
all latest year years yearly month monthly daily weekly quarter quarterly annual since onwards
australia australian national state states territory nsw new south wales qld queensland vic
victoria victorian sa south wa western tas tasmania tasmanian act capital nt northern
government council councils area areas region regions number numbers list register
records table""".split()


def subject_words(c: Column) -> Column:
    """The words of a title that tell its subject: of three or more letters, without a last s, not COMMON, once each."""
    words = F.transform(F.regexp_extract_all(F.lower(c), F.lit("[a-z][a-z']+"), F.lit(0)), lambda w: F.regexp_replace(w, "s$", ""))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(COMMON)))


#: Records that meet in pairs under one topic and word; a word of more is common: it is counted where records meet by another, and never brings them together itself.
MEET = 100


def _apart() -> Column:
    return (F.col("org") != F.col("_org")) & (F.col("id") != F.col("other")) & ~F.coalesce(F.col("collection") == F.col("_collection"), F.lit(False))


def _other(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({"id": "other", "org": "_org", "collection": "_collection"})


def met_by_rare_words(each: DataFrame) -> DataFrame:
    """id, other, shared of all pairs that share a topic and a word of at most MEET records under it; shared counts all their words, common ones too."""
    rare = each.where(F.col("n") <= MEET).select("topic", "word", "id", "org", "collection", "words")
    pairs = rare.join(_other(rare).withColumnRenamed("words", "_words"), ["topic", "word"]).where(_apart())
    return pairs.select("id", "other", F.size(F.array_intersect("words", "_words")).cast("long").alias("shared")).groupBy("id", "other").agg(F.max("shared").alias("shared"))


def met_by_common_words(each: DataFrame, bar: DataFrame, k: int) -> DataFrame:
    """id, other, shared: pairs by common words alone, all that may be among a record's k best where its bar (id, bar: its k-th best by rare words) leaves room.

    Records of one topic and the same common words are one group, which shows at most 5k of its own: the least ids, enough of them whatever one publisher and one collection a reader leaves out.
    A group with `bar` words in common holds one of a record's rarer common words (all but bar - 1), so the commonest words bring nobody together where the bar is higher.
    """
    common = each.where(F.col("n") > MEET).groupBy("topic", "id", "org", "collection").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("_c")).withColumn("group", F.col("_c.word")).drop("_c")
    shown = common
    first = lambda by: F.row_number().over(W.partitionBy("topic", "group", *by).orderBy("id"))
    for by, most, where in ((("org", "collection"), k, F.col("collection").isNotNull()), (("org",), 2 * k, F.lit(True)), (("collection",), 2 * k, F.col("collection").isNotNull()), ((), 5 * k, F.lit(True))):
        shown = shown.withColumn("_r", first(by)).where((F.col("_r") <= most) | ~where).drop("_r")
    known = common.select("topic", "group").distinct().select("topic", F.col("group").alias("_group"), F.explode("group").alias("word"))
    bars = common.join(bar, "id", "left").withColumn("bar", F.greatest(F.coalesce("bar", F.lit(0)), F.lit(1))).where(F.col("bar") <= F.size("group"))
    asks = bars.select("topic", "group", "bar").distinct().withColumn("word", F.explode(F.slice("group", F.lit(1), F.size("group") - F.col("bar") + 1)))
    near = asks.join(known, ["topic", "word"]).select("topic", "group", "bar", "_group").distinct().withColumn("shared", F.size(F.array_intersect("group", "_group")).cast("long")).where(F.col("shared") >= F.col("bar"))
    seen = bars.join(near, ["topic", "group", "bar"]).select("topic", "_group", "id", "org", "collection", "shared")
    pairs = seen.join(_other(shown).withColumnRenamed("group", "_group"), ["topic", "_group"]).where(_apart())
    return pairs.groupBy("id", "other").agg(F.max("shared").alias("shared"))


def related(records: DataFrame, k: int = 12) -> DataFrame:
    """id, other, shared: the k records that share most subject words with a record, a topic too, but neither publisher nor collection; ties by other.

    records: id, org, collection (may be null), topics, words. A top-k join of sets: records meet in pairs by their rarer words only, and what those leave open is answered from
    groups of records of the same common words, so a word in every record costs each record a few rows times k and no pairs.
    """
    each = records.select("id", "org", "collection", F.explode(F.array_distinct("topics")).alias("topic"), F.array_distinct("words").alias("words")).withColumn("word", F.explode("words"))
    often = each.groupBy("topic", "word").agg(F.count("*").alias("n"))
    each = checkpointed(each.join(often, ["topic", "word"]))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("shared"), "other"))
    best = checkpointed(met_by_rare_words(each).withColumn("r", rank).where(F.col("r") <= k))
    bar = best.where(F.col("r") == k).select("id", F.col("shared").alias("bar"))
    every = best.drop("r").unionByName(met_by_common_words(each, bar, k)).groupBy("id", "other").agg(F.max("shared").alias("shared"))
    return every.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def dataset_to_record(entries: DataFrame, records: DataFrame) -> DataFrame:
    """name, record, how: an entry's record by its name, its page, its file's URL, in that order."""
    by = lambda c, to: records.where(F.col(c).isNotNull()).groupBy(F.col(c).alias(to)).agg(F.min("id").alias(f"_{to}"))
    made = entries.join(by("name", "name"), "name", "left").join(by("page", "page"), "page", "left").join(by("url", "url"), "url", "left")
    how = F.when(F.col("_name").isNotNull(), "name").when(F.col("_page").isNotNull(), "page").when(F.col("_url").isNotNull(), "url")
    return made.select("name", F.coalesce("_name", "_page", "_url").alias("record"), how.alias("how"))


def candidate_tasks(votes: DataFrame, records: DataFrame, register: DataFrame, threshold: int) -> DataFrame:
    """key, title, votes of records over a threshold that no entry serves yet, by votes."""
    wanted = votes.where(F.col("votes") >= threshold).join(records.select(F.col("id").alias("key"), "title"), "key")
    return wanted.join(register.select(F.col("id").alias("key")), "key", "left_anti").orderBy(F.desc("votes"), "key")


def backlog_votes(register: DataFrame, votes: DataFrame) -> DataFrame:
    """key, votes, owned: waiting entries with their votes (0 if none), and voted keys that no entry owns."""
    waiting = register.where("not live").select(F.col("id").alias("key")).join(votes, "key", "left").select("key", F.coalesce("votes", F.lit(0)).alias("votes"), F.lit(True).alias("owned"))
    return waiting.unionByName(votes.join(register.select(F.col("id").alias("key")), "key", "left_anti").select("key", "votes", F.lit(False).alias("owned")))


def reconcile(wanted: DataFrame, existing: DataFrame, cap: int) -> DataFrame:
    """key, action: create, update or close of wanted tasks (key, votes) against existing ones (key, open, done).

    The `cap` most wanted keys may be open; a key that ever had a task never gets another.
    """
    first = wanted.orderBy(F.desc("votes"), "key").limit(cap).select("key", F.lit(True).alias("_first"))
    both = wanted.select("key", F.lit(True).alias("_wanted")).join(first, "key", "left").join(existing, "key", "full_outer")
    within = F.coalesce("_first", F.lit(False))
    action = (
        F.when(F.col("open").isNull() & within, "create").when(F.col("open").isNull(), None).when(~F.col("open"), None)
        .when(F.col("done"), "close: done").when(F.col("_wanted").isNull(), "close: gone").when(within, "update").otherwise("close: over the cap")
    )
    return both.select("key", action.alias("action")).where("action is not null")


def usage_counts(lines: DataFrame, column: str = "line", kind: str = "event") -> DataFrame:
    """class, n of log lines of JSON; lines that cannot be read are counted as unreadable."""
    parsed = F.try_parse_json(F.col(column))
    name = F.when(parsed.isNull(), "unreadable").otherwise(F.coalesce(F.try_variant_get(parsed, f"$.{kind}", "string"), F.lit("none")))
    return lines.select(name.alias("class")).groupBy("class").agg(F.count("*").alias("n"))


def growth(entries: DataFrame, versions: DataFrame, today: str) -> DataFrame:
    """dataset, per_version, per_year, yearly_bytes: mean bytes of a version times versions a year (stored in the last year, or declared)."""
    recent = F.count_if(F.col("version") > F.date_sub(F.lit(today).cast("date"), 365))
    made = versions.groupBy("dataset").agg(F.avg("bytes").alias("per_version"), recent.alias("_recent"))
    rate = F.greatest("_recent", F.coalesce("declared", F.lit(0)))
    return entries.join(made, "dataset").select("dataset", "per_version", rate.alias("per_year"), (F.col("per_version") * rate).alias("yearly_bytes"))


def shared_content(files: DataFrame) -> DataFrame:
    """dataset, files, distinct, saved: what keeping each distinct file (size, sha) once would save."""
    per = files.groupBy("dataset", "size", "sha").agg(F.count("*").alias("n"))
    return per.groupBy("dataset").agg(F.sum("n").alias("files"), F.count("*").alias("distinct"), F.sum((F.col("n") - 1) * F.col("size")).alias("saved"))


def weekly_activity(fetches: DataFrame) -> DataFrame:
    """first, again: datasets first fetched in the seven days to the newest fetch, and others with a fetch in them."""
    per = fetches.groupBy("dataset").agg(F.min("day").alias("_first"), F.max("day").alias("_last"))
    newest = fetches.agg(F.date_sub(F.max("day"), 6).alias("_from"))
    week = per.crossJoin(F.broadcast(newest))  # one row
    return week.agg(F.count_if(F.col("_first") >= F.col("_from")).alias("first"), F.count_if((F.col("_first") < F.col("_from")) & (F.col("_last") >= F.col("_from"))).alias("again"))


# Search.


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def ranked_search(docs: DataFrame, query: str, fields: dict[str, float], limit: int = 20, k1: float = 1.2, b: float = 0.75, first: str | None = None) -> DataFrame:
    """id, score: BM25 with a weight for each field over rows in which all query words (12 at most) occur; rows where `first` holds come first.

    Term counts are taken inside each row; only totals of a word (rows, lengths) are aggregated, so nothing but the top is shuffled.
    Filters (`catalogue_filter`) come before: totals are those of the rows given.
    """
    words = list(dict.fromkeys(w for w in query.lower().split() if w))[:12]
    rows = docs.select("id", (F.col(first) if first else F.lit(True)).alias("_first"), *[tokens(F.coalesce(F.col(f), F.lit(""))).alias(f"_{f}") for f in fields])
    count = lambda f, w: F.size(F.filter(f"_{f}", lambda x: x == w))
    tf = {w: sum((weight * count(f, w) for f, weight in fields.items()), F.lit(0.0)) for w in words}
    length = sum((weight * F.size(f"_{f}") for f, weight in fields.items()), F.lit(0.0))
    rows = rows.select("id", "_first", length.alias("_len"), *[tf[w].alias(f"_t{i}") for i, w in enumerate(words)])
    stats = rows.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_t{i}") > 0).alias(f"_df{i}") for i in range(len(words))])
    joined = rows.crossJoin(F.broadcast(stats))  # one row
    score, every = F.lit(0.0), F.lit(True)
    for i in range(len(words)):
        t = F.col(f"_t{i}")
        idf = F.log(1 + (F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
        score = score + idf * t * (k1 + 1) / (t + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))
        every = every & (t > 0)
    return joined.where(every).select("_first", "id", score.alias("score")).orderBy(F.desc("_first"), F.desc("score"), "id").limit(limit).drop("_first")


def scan_search(docs: DataFrame, query: str, columns: list[str]) -> DataFrame:
    return docs.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.lower())))


def resolve_urls(asked: DataFrame, records: DataFrame) -> DataFrame:
    """asked, record: the record a pasted URL names: its id, its name, then its address."""
    place = locate(F.col("asked"))
    q = asked.select("asked", place["value"].alias("_v"), bare_url(F.col("asked")).alias("_u"))
    by_id = records.select(F.col("id").alias("_v"), F.col("id").alias("_by_id"))
    by_url = records.groupBy(bare_url(F.col("url")).alias("_u")).agg(F.min("id").alias("_by_url"))
    return q.join(by_id, "_v", "left").join(by_url, "_u", "left").select("asked", F.coalesce("_by_id", "_by_url").alias("record"))


def record_states(records: DataFrame, entries: DataFrame) -> DataFrame:
    """id, state: served or chosen where an entry has the record, else closed with the reason, else votable."""
    licence = licence_id(F.col("licence"))
    open_ = licence_open(licence)
    state = (
        F.when(F.col("live"), "served").when(F.col("live").isNotNull(), "chosen").when(open_ == F.lit(False), "closed: licence")
        .when(~F.col("has_files"), "closed: no files").when(licence == "", "closed: licence unknown").otherwise("votable")
    )
    return records.join(entries, "id", "left").select("id", state.alias("state"))


# Abbreviations of jurisdictions, and words that tell a level of government.
JURISDICTIONS = ["NSW", "VIC", "QLD", "WA", "SA", "TAS", "ACT", "NT"]
LEVELS = [(r"\b(?:city|shire|town|council|municipality)\b", "local"), (r"\b(?:bureau|commonwealth|federal|national|australian)\b", "national"), (r"\b(?:department|ministry|authority)\b", "state")]


def suggest_publishers(orgs: DataFrame, placed: DataFrame) -> DataFrame:
    """org, jurisdiction, level, merge, why proposed by its name for organisations that are not placed yet.

    placed: org, jurisdiction. A body of the same name (letters alone) and jurisdiction is proposed for a merge, the first by
    name; one of another jurisdiction is only named among the reasons. why lists the reasons; proposals are for review.
    """
    named = F.nullif(F.regexp_extract("org", r"\b(" + "|".join(JURISDICTIONS) + r")\b", 1), F.lit(""))
    letters = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    left = orgs.select("org").distinct().join(placed.select("org"), "org", "left_anti")
    made = left.select("org", letters("org").alias("_name"), named.alias("jurisdiction"), first_match(F.lower("org"), LEVELS).alias("level"))
    same = placed.groupBy(letters("org").alias("_name"), F.col("jurisdiction").alias("_j")).agg(F.min("org").alias("_org"))
    one = same.groupBy("_name").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("_j", F.lit("")), "_org"))).alias("_by"), F.min("_org").alias("_first"))  # a jurisdiction each
    made = made.join(one, "_name", "left").withColumn("merge", F.try_element_at("_by", F.coalesce("jurisdiction", F.lit(""))))
    why = F.array(
        F.when(F.col("jurisdiction").isNotNull(), F.concat(F.lit("names "), "jurisdiction")), F.when(F.col("level").isNotNull(), F.concat(F.lit("a name of "), "level", F.lit(" bodies"))),
        F.when(F.col("merge").isNotNull(), F.concat(F.lit("same body as "), "merge")).when(F.col("_first").isNotNull(), F.concat(F.lit("same name as "), "_first", F.lit(", not merged"))),
    )
    return made.select("org", "jurisdiction", "level", "merge", F.array_join(F.array_compact(why), "; ").alias("why"))
