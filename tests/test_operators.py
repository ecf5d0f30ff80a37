"""Operators on small tables made by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import catalogue, normalise, query, rollup, spatial, versions
from tidemark.sources import files, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_refusals(spark):
    df = spark.createDataFrame([(1, "a", True)], "n int, t string, b boolean")
    for bad in (("x", "eq.1"), ("n", "eq.one"), ("n", "in.()"), ("n", "about.1"), ("b", "eq.maybe")):
        with pytest.raises(query.QueryError):
            query.condition(df, *bad)
    for bad in ("sum.t", "median.n", "avg.t"):
        with pytest.raises(query.QueryError):
            query.metric(df, bad)
    with pytest.raises(query.QueryError):
        query.page(df, 10_001)


def test_like_folds_ascii_alone(spark):
    df = spark.createDataFrame([("ÉCOLE",), ("école",), ("a_b%",), ("A_B%",), ("axb%",)], "t string")
    assert rows(df.where(query.like(F.col("t"), "*cole"))) == [("ÉCOLE",), ("école",)]
    assert rows(df.where(query.like(F.col("t"), "é*"))) == [("école",)]
    assert rows(df.where(query.like(F.col("t"), "A_B*"))) == [("A_B%",), ("a_b%",)]


def test_no_group_is_one_row(spark):
    df = spark.createDataFrame([], "n int")
    assert [tuple(r) for r in query.aggregate_query(df, [], ["count", "sum.n"]).collect()] == [(0, None)]


def test_messy_table_is_typed(spark):
    raw = spark.createDataFrame([("1", " x ", "1,234", "Yes", "30/06/2020", "e"), ("2", "", "<5", "No", "", "e"), ("3", "y", "np", " Yes", "1/2/2021", "e")], "Id string, Name string, Count string, Flag string, When string, Extra string")
    entry = normalise.Entry(("id",), (normalise.Field("id", "Id", "integer"), normalise.Field("name", "Name"), normalise.Field("count", "Count", "integer", nulls=("np",)), normalise.Field("flag", "Flag", "boolean", ("Yes",), ("No",)), normalise.Field("when", "When", "date", formats=("d/M/yyyy",))), ("<5",))
    got = [tuple(r) for r in normalise.normalise(raw, entry).orderBy("id").select("id", "name", "count", "flag", F.col("when").cast("string"), "suppressed").collect()]
    assert got == [(1, "x", 1234, True, "2020-06-30", []), (2, None, None, False, None, ["count"]), (3, "y", None, True, "2021-02-01", [])]
    assert normalise.allowlist(raw, entry)[1] == ["Extra"]
    with pytest.raises(normalise.SchemaError):
        normalise.strict(raw.withColumn("Id", F.lit("one")), entry)
    with pytest.raises(normalise.SchemaError):
        normalise.allowlist(raw.drop("Flag"), entry)


def brute_diff(a, b):
    keys = set(a) | set(b)
    return {k: "added" if k not in a else "removed" if k not in b else "changed" if a[k] != b[k] else "unchanged" for k in keys}


def test_random_versions(spark):
    r = random.Random(3)
    for _ in range(4):
        side = lambda: {k: (r.choice(["N", "S", None]), r.choice([1.0, 2.0, None])) for k in r.sample(range(12), r.randint(0, 10))}  # noqa: E731,B023
        a, b = side(), side()
        table = lambda t: spark.createDataFrame([(k, *v) for k, v in t.items()], "id int, region string, x double")
        assert dict(rows(versions.diff(table(a), table(b), ["id"]))) == brute_diff(a, b)
        assert not rows(versions.diff(table(a), table(a), ["id"]).where("state <> 'unchanged'"))


def test_schema_diff_and_added_field(spark):
    a = spark.createDataFrame([(1, "x")], "id int, v string")
    b = spark.createDataFrame([(1, "x", 2)], "id bigint, v string, w int")
    assert rows(versions.schema_diff(a, b)) == [("id", "retyped"), ("w", "added")]
    assert rows(versions.diff(a, a.withColumn("w", F.lit(1)), ["id"])) == [(1, "changed")]


def test_example_answers_of_an_empty_table(spark):
    from tidemark.operators import checks

    df = spark.createDataFrame([], "n int")
    assert rows(checks.example_answers(df, {"good": ([], ["count"], []), "broken": (["nowhere"], ["count"], [])})) == [("broken", False, 0), ("good", True, 0)]


def test_digest_sees_repeats_not_order(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "n int")
    d = lambda df: rows(versions.digest(df))
    assert d(a) == d(a.orderBy(F.desc("n"))) and d(a) != d(a.distinct()) and d(a.unionByName(a.where("n = 2")).unionByName(a.where("n = 2"))) != d(a)


def test_history_leaves_and_returns(spark):
    days = {"2026-10-01": "AB", "2026-10-02": "A", "2026-10-03": "AB", "2026-10-04": "", "2026-10-05": "A", "2026-10-06": "A"}
    history, last = None, None
    for day, ids in days.items():
        snapshot = spark.createDataFrame([(x, "open") for x in ids], "id string, status string")
        history = snapshot.withColumns({"first_seen": F.lit(day).cast("date"), "last_seen": F.lit(day).cast("date")}) if history is None else versions.advance(history, snapshot, day, last)
        last = day
    got = sorted((r.id, str(r.first_seen)[-2:], str(r.last_seen)[-2:]) for r in history.collect())
    assert got == [("A", "01", "03"), ("A", "05", "06"), ("B", "01", "01"), ("B", "03", "03")]


def test_alias_chains_and_cycles(spark):
    links = [(k, k + 1) for k in range(1, 60)] + [(100, 101), (101, 102), (102, 100), (200, 101), (300, 301)]
    got = dict(rows(catalogue.alias_roots(spark.createDataFrame(links, "old int, new int"))))
    assert all(got[k] == 60 for k in range(1, 60)) and [got[k] for k in (100, 101, 102, 200, 300)] == [100, 100, 100, 100, 301]


def test_points_holes_edges(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    areas = spark.createDataFrame([("02", "ring", [square(0.0, 0.0, 4.0), square(1.0, 1.0, 2.0)]), ("01", "right", [square(4.0, 0.0, 4.0)])], "code string, name string, rings array<array<struct<x:double,y:double>>>")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 4.0, 1.0), (4, None, 1.0), (5, 9.0, 9.0), (6, 1.0, 2.0)], "id int, lon double, lat double")
    got = {r.id: r.code for r in spatial.point_in_area(points, areas).collect()}
    assert got == {1: "02", 2: None, 3: "01", 4: None, 5: None, 6: "02"}


def test_cube_answers_are_base_answers(spark):
    r = random.Random(9)
    df = spark.createDataFrame([(r.choice(["a", "b", None]), r.choice(["x", "y"]), r.randint(0, 5)) for _ in range(400)], "k string, g string, n int")
    sets = rollup.plan(df, ["k", "g"], ["n"], 10_000)
    assert sets
    cube = rollup.cubes(df, sets, ["n"])
    for groups, conditions in ((["k"], []), (["g"], [("k", "neq.a")]), ([], [("g", "eq.x")]), (["k", "g"], [])):
        metrics = ["count", "sum.n", "min.n", "max.n"]
        assert rows(rollup.answer(df, cube, sets, ["n"], groups, metrics, conditions).select(F.to_json(F.struct("*")))) == rows(query.aggregate_query(df, groups, metrics, conditions).select(F.to_json(F.struct("*"))))


def test_cube_plan_by_bytes(spark):
    df = spark.range(2000).selectExpr("id % 2 a", "id % 40 b", "id % 41 c", "id d", "1 e")
    sets = rollup.plan(df, ["a", "b", "c", "d", "e"], ["d"], 1_000_000, [("c", "b")])
    assert sets[0] == ("a", "b") or set(sets[0]) <= {"a", "b", "c"}
    assert not any("d" in s or "e" in s or s == ("b", "c") for s in sets)  # as many values as rows, one value, too many groups
    few = rollup.plan(df, ["a", "b", "c"], ["d"], 600)
    groups = {("a",): 2, ("b",): 40, ("c",): 41, ("a", "b"): 40, ("a", "c"): 82, ("b", "c"): 1640}
    assert few[0] == ("a",) and sum(groups[s] * (1.2 + 0.9 * len(s) + 6.0) for s in few) <= 650  # group counts are estimates


def test_landed_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Id,Name\n1,"a, ""b""\nc"\n2\n')
    assert rows(files.delimited(spark, str(tmp_path / "a.csv")).fillna("")) == [("1", 'a, "b"\nc'), ("2", "")]
    assert rows(files.short_rows(spark, str(tmp_path / "a.csv")))[0][1] >= 1
    (tmp_path / "p.json").write_text(json.dumps({"features": [{"properties": {"n": "a"}, "geometry": {"type": "Point", "coordinates": [1.5, 2]}}, {"properties": {"n": "b"}, "geometry": {"type": "MultiPoint", "coordinates": [[3, 4]]}}, {"properties": {"n": "c"}, "geometry": {"type": "MultiPoint", "coordinates": [[3, 4], [5, 6]]}}, {"properties": {"n": "d"}, "geometry": None}]}))
    got = {r.properties["n"]: (r.lon, r.lat) for r in files.geojson_points(spark, str(tmp_path / "p.json")).collect()}
    assert got == {"a": (1.5, 2.0), "b": (3.0, 4.0), "c": (None, None), "d": (None, None)}
    (tmp_path / "r.json").write_text(json.dumps({"data": {"list": [{"a": {"b": 1}, "c": [1, 2]}, {"a": {"b": 2}, "c": []}]}}))
    assert rows(files.json_records(spark, str(tmp_path / "r.json"), "data.list")) == [("1", "1 | 2"), ("2", "")]
    (tmp_path / "x.xml").write_text("<all><rec><n>1</n><t>a</t><t>b</t></rec><rec><n>2</n><t>c</t></rec></all>")
    assert rows(files.xml_records(spark, str(tmp_path / "x.xml"), "rec")) == [("1", "a | b"), ("2", "c")]
    (tmp_path / "y.xml").write_text('<all><rec id="7"><n u="m">1</n><t k="p">a</t><t k="q">b</t></rec><rec id="8"><n u="s">2</n><t k="r">c</t></rec></all>')
    got = files.xml_records(spark, str(tmp_path / "y.xml"), "rec").select("`@id`", "n", "`n@u`", "t", "`t@k`")
    assert rows(got) == [("7", "1", "m", "a | b", "p | q"), ("8", "2", "s", "c", "r")]


def test_decoding(spark):
    df = spark.createDataFrame([("é".encode(),), (b"\xef\xbb\xbfx",), ("é".encode("latin-1"),), (b"\x93quoted\x94 \x80",), (b"\x81\xe9",)], "b binary")
    assert sorted(r[0] for r in df.select(files.decoded(F.col("b"))).collect()) == sorted(["x", "é", "é", "“quoted” €", "\x81é"])


def one(spark, values, made):
    """What a column function makes of each text."""
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string")
    return [r[1] for r in rows.select("k", made(F.col("t"))).orderBy("k").collect()]


def test_licence_titles(spark):
    want = {
        "Creative Commons Attribution 3.0 Australia": ("CC-BY-3.0-AU", True), "Creative Commons Attribution 4.0 International": ("CC-BY-4.0", True), "Creative Commons Attribution 2.5 Australia": ("CC-BY-2.5-AU", True),
        "Creative Commons Non-Commercial 3.0 Australia": ("CC-BY-NC-3.0-AU", False), "CC-BY-ND-4.0": ("CC-BY-ND-4.0", False), "Other (Open)": ("other-open", True), "Other (Not Open)": ("other-closed", False), "Other (Non-Commercial)": ("other-nc", False),
        "Open Data Commons Attribution License": ("ODC-BY-1.0", True), "Access on request": ("Access on request", False), "Closed licence, Creative Commons excluded": ("Closed licence, Creative Commons excluded", False), "PDDL": ("PDDL-1.0", True),
        "Attribution 3.0 Australia (CC BY 3.0 AU)": ("CC-BY-3.0-AU", True), "Creative Commons Attribution | Share Alike 4.0 International": ("CC-BY-SA-4.0", True), "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International": ("CC-BY-NC-ND-4.0", False),
        "ODBL-1": ("ODBL-1.0", True), "Creative Commons Attribution": ("CC-BY", True), "Licence Specified by Agency": ("Licence Specified by Agency", False), "notspecified": ("", None), " cc-zero ": ("CC0-1.0", True), "": ("", None), None: ("", None),
    }
    got = one(spark, list(want), lambda t: F.struct(catalogue.licence_id(t), catalogue.licence_open(catalogue.licence_id(t))))
    assert [tuple(x) for x in got] == list(want.values())


def test_cadences(spark):
    want = {
        "weekly": 52, "monthly": 12, "annually, in March": 1, "one file a year": 1, "half-yearly": 2, "irregular, several times a year": 4, "hourly, checked weekly": 52, "every 30 minutes": 365, "weekly, with historical records from 1990": 52,
        "weekly until further notice": 52, "monthly as contracts are disclosed": 12, "closed": 0, "closed year": 0, "historical, not updated since 2019": 0, "monthly until June 2024": 0, "no new readings since April 2025": 0, "weekly until 2030": 52,
        "weekly until October 2026": 52, "weekly until September 2026": 0, "delivered quarterly": 4, "extended monthly release": 12, "Twice a year": 2, "a census": 0.2, "as required": None, "": None, None: None,
    }
    assert one(spark, list(want), lambda t: catalogue.per_year(t, F.lit("2026-10-06").cast("date"))) == list(want.values())


def test_formats_and_summaries(spark):
    assert one(spark, ["csv, Excel (.xlsx)/SHP; .shz", "WFS,,rest", ""], lambda t: F.array_join(catalogue.formats(t), ";")) == ["CSV;SHP;XLSX", "API", ""]
    texts = ["<p>**Crash** data. See [the guide](https://example.org) &amp; <b>more</b>&#33;&nbsp;&eacute;&#x1F600;", "&amp;lt; &lt; &nosuch; &#0;", "word, " * 100, None]
    made = one(spark, texts, catalogue.summary)
    assert made[:2] == ["Crash data. See the guide & more ! é\U0001f600", "&lt; < &nosuch; & 0;"] and made[3] == ""
    assert made[2].endswith("word…") and 270 < len(made[2]) <= 281


def test_related_records(spark):
    rows_ = [(1, "a", 1, ["x"], "Road crash sites"), (2, "b", 2, ["x", "y"], "Crashes of roads by site"), (3, "b", 1, ["x"], "road crash"), (4, "c", None, ["z"], "road crash"), (5, "c", None, ["x"], "the annual list"), (6, "c", None, ["y", "x"], "Crash numbers")]
    df = spark.createDataFrame(rows_, "id int, org string, collection int, topics array<string>, t string").withColumn("words", catalogue.subject_words(F.col("t")))
    assert rows(catalogue.related(df.drop("t"))) == [(1, 2, 2), (1, 6, 1), (2, 1, 2), (3, 6, 1), (6, 1, 1), (6, 3, 1)]


def test_state_by_key_over_batches(spark, tmp_path):
    """The state of each key over several batches, in which some keys do not come."""
    from tidemark.plans.stream_plans import _final
    from tidemark.streaming import feeds

    for n, part in enumerate([[(1, "a", 1), (1, "b", 2), (2, "a", 3)], [(1, "b", 4), (3, "c", 5)], [(2, "b", 6), (2, "a", 7)]]):
        spark.createDataFrame(part, "k long, s string, t long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, s string, t long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert rows(_final(spark, feeds.state_by_key(stream, "k", "s", "t"), "update", "k")) == [(1, "b", 2, 4), (2, "a", 7, 7), (3, "c", 5, 5)]


def test_state_by_key_in_any_order(spark, tmp_path):
    """A key's rows come in several parts and batches of no order; late rows cut the current run or begin it earlier."""
    import random

    from tidemark.plans.stream_plans import _final
    from tidemark.streaming import feeds

    rng = random.Random(5)
    told = [(k, rng.choice([*"aaaab", None]), t) for k in range(6) for t in rng.sample(range(2**60, 2**60 + 5000), 400)] + [(9, "a", 2), (9, "b", None)]
    rng.shuffle(told)
    want = []
    for k in sorted({r[0] for r in told}):
        own = sorted((r for r in told if r[0] == k), key=lambda r: (r[2] is None, r[2] or 0))
        n = next((n for n in range(1, len(own)) if own[-1 - n][1] != own[-1][1]), len(own))
        want.append((k, own[-1][1], own[-n][2], own[-1][2]))
    for n in range(0, len(told), 800):
        spark.createDataFrame(told[n : n + 800], "k long, s string, t long").repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        for files in (2, 100):
            stream = spark.readStream.schema("k long, s string, t long").option("maxFilesPerTrigger", files).parquet(str(tmp_path / "in"))
            assert rows(_final(spark, feeds.state_by_key(stream, "k", "s", "t"), "update", "k")) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_inferred_cells(spark):
    """What a cast or parse takes has the shape asked for before it, so shapes change no answer; and most cells that fail are never put to one."""
    cells = ["1", "-1", "+7", "007", "1.5", ".5", "5.", "1e5", "-2E-3", "1d", "2f", "0x1p3", "NaN", "nan", "-Infinity", "inf", "+INF", "1_0", "1,234", "1,23", "\x0112", "12\x7f", "9" * 30, "", "yes", "held", "2020-01-31", "12020-01-31", "+12020-01-31", "2020-1-31", "31/1/2020", "031/01/2020", "1-2", "20200131", "Jan 5, 2020", "5 Jan 2020", "2020-01-31T10:11:12", "2020-01-31T10:11:12.5", "a-b/c", "<5"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    formats = ("yyyy-MM-dd", "d/M/yyyy", "yyyyMMdd", "MMM d, yyyy", "d MMM yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-M-d[ H:m]", "dd.MM.yy")
    c, fails = F.col("c"), 0
    for shape, x in [(normalise.INTEGRAL, c.try_cast("bigint")), (normalise.NUMERAL, c.try_cast("double")), *[(normalise.date_shape(f), F.try_to_timestamp(c, F.lit(f))) for f in formats]]:
        got = df.select("c", x.isNotNull().alias("ok"), (c.rlike(shape) if shape else F.lit(True)).alias("fits")).collect()
        assert [r.c for r in got if r.ok and not r.fits] == [], shape
        fails += sum(r.fits and not r.ok for r in got) if shape else 0
    assert fails < 12
    kind = lambda *cells: [r.type for r in normalise.infer(spark.createDataFrame([(c,) for c in cells], "`a.b` string"), ["a.b"]).collect()]
    assert [kind("1", None, "2"), kind("1", "1.5", "<5"), kind("01", "x"), kind("Y", "no "), kind("2020-01-31", ""), kind("2020-01-31", "1/2/2020"), kind(None, " "), kind("NaN", "1e5"), kind("1,234", "5")] == [["integer"], ["number"], ["string"], ["boolean"], ["date"], ["string"], ["string"], ["number"], ["integer"]]


def test_provenance_and_points(spark):
    df = sinks.with_provenance(spark.createDataFrame([(1.0, 2.0), (None, 1.0)], "lon double, lat double"), {"source": "file", "version": "2024-01-01"})
    assert df.schema["lon"].metadata == {"source": "file", "version": "2024-01-01"}
    got = [r[0] for r in df.select(sinks.wkb_point(F.col("lon"), F.col("lat"))).collect()]
    assert got[0] is not None and bytes(got[0])[:5] == b"\x01\x01\x00\x00\x00" and got[1] is None
