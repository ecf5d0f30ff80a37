"""What is written with its description: footers that other readers know, a manifest row a version, nothing of a job that failed."""

import json
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.operators import normalise, versions
from tidemark.sources import described, files, sinks


def parts(folder):
    return [os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")]


def test_footers_and_manifest(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = spark.range(100).selectExpr("id", "if(id % 10 = 0, null, id / 2.0) lon", "-id / 4.0 lat").repartition(3)
    sinks.write_geo_parquet(rows, table, "sites", "2024-01-01", "lon", "lat", {"source": "a file", "sha256": "00ff"})
    made = parts(table)
    assert len(made) == 3 and sum(pq.read_metadata(f).num_rows for f in made) == 100
    boxes = []
    for f in made:
        said = pq.read_metadata(f).metadata
        geo = json.loads(said[b"geo"])
        assert geo["version"] == "1.1.0" and geo["primary_column"] == "geometry" and geo["columns"]["geometry"]["encoding"] == "WKB" and geo["columns"]["geometry"]["geometry_types"] == ["Point"]
        assert json.loads(said[b"provenance"]) == {"source": "a file", "sha256": "00ff"}
        boxes.append(geo["columns"]["geometry"]["bbox"])
        assert pq.read_schema(f).names == ["id", "geometry"]
    assert (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)) == (0.5, -24.75, 49.5, -0.25)
    row = described.manifest(spark, table).collect()
    assert len(row) == 1 and (row[0].dataset, row[0].version, row[0].rows, row[0].files, row[0].fields) == ("sites", "2024-01-01", 100, 3, ["id", "geometry"])
    assert row[0].bytes == sum(os.path.getsize(f) for f in made)
    joined = described.described(spark, table).join(described.manifest(spark, table), ["dataset", "version"]).groupBy("version", "rows").count().collect()
    assert [tuple(r) for r in joined] == [("2024-01-01", 100, 100)]


def test_versions_do_not_change(spark, tmp_path):
    table = str(tmp_path / "t")
    one, two = spark.range(5), spark.range(7)
    described.write_described(one, table, "d", "1", {})
    with pytest.raises(Exception, match="versions do not change"):
        described.write_described(two, table, "d", "1", {})
    assert described.described(spark, table).count() == 5 and not parts(f"{table}/_staging")
    described.write_described(two, table, "d", "1", {}, replace=True)
    described.write_described(one, table, "d", "2", {})
    described.write_described(one.limit(0), table, "d", "3", {})
    assert {r.version: r.rows for r in described.manifest(spark, table).collect()} == {"1": 7, "2": 5, "3": 0}
    assert described.described(spark, table).count() == 12


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    table = str(tmp_path / "t")
    described.write_described(spark.range(5), table, "d", "1", {})
    broken = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 80, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception):
        described.write_described(broken, table, "d", "2", {})
    assert not os.path.exists(f"{table}/d/2") and not parts(f"{table}/_staging") and described.manifest(spark, table).count() == 1
    # What a driver that died before the manifest row left is not read, and the next job takes its place.
    os.makedirs(f"{table}/d/2")
    pq.write_table(pq.read_table(parts(f"{table}/d/1")[0]), f"{table}/d/2/part-0.parquet")
    assert described.described(spark, table).count() == 5
    described.write_described(spark.range(3), table, "d", "2", {})
    assert described.described(spark, table).count() == 8


def test_boxes_of_shapes():
    import struct

    point = lambda x, y: struct.pack("<2d", x, y)
    line = struct.pack("<BII", 1, 2, 2) + point(1, 2) + point(-3, 5)
    polygon = struct.pack("<BII", 1, 3, 2) + struct.pack("<I", 3) + point(0, 0) + point(9, 0) + point(0, 9) + struct.pack("<I", 1) + point(1, 1)
    many = struct.pack("<BII", 1, 7, 3) + line + polygon + struct.pack("<BI", 1, 1) + point(20, -7)
    assert described._numbers(line).tolist() == [[1, 2], [-3, 5]]
    assert described._numbers(polygon).tolist() == [[0, 0], [9, 0], [0, 9], [1, 1]]
    assert described._numbers(many).max(0).tolist() == [20, 9] and len(described._numbers(many)) == 7


def test_answers_as_text(spark):
    df = spark.createDataFrame([("a, b", 1.5, ["x", "y"]), (None, None, []), ('say "x"\nnow', 2.0, None)], "t string, n double, l array<string>").coalesce(1)
    csv = [r.value for r in sinks.answer_text(df, "csv").orderBy("line").collect()]
    assert csv == ["t,n,l", '"a, b",1.5,x;y', ",,", '"say ""x""\nnow",2.0,']
    lines = [json.loads(r.value) for r in sinks.answer_text(df, "ndjson").orderBy("line").collect()]
    assert lines == [{"t": "a, b", "n": 1.5, "l": ["x", "y"]}, {"t": None, "n": None, "l": []}, {"t": 'say "x"\nnow', "n": 2.0, "l": None}]
    assert json.loads(sinks.answer_text(df, "json", {"version": "1"}).first().value) == {"provenance": {"version": "1"}, "rows": lines}
    assert json.loads(sinks.answer_text(df.limit(0), "json").first().value) == {"provenance": {}, "rows": []}
    with pytest.raises(ValueError):
        sinks.answer_text(df, "xlsx")


def test_geojson_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.5, 2.0), (2, None, 2.0)], "id int, lon double, lat double")
    sinks.write_geojson(df, str(tmp_path / "g"), "lon", "lat")
    got = sorted((json.loads(r.value) for r in spark.read.text(str(tmp_path / "g")).collect()), key=lambda f: f["properties"]["id"])
    assert got == [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.5, 2.0]}, "properties": {"id": 1}}, {"type": "Feature", "geometry": None, "properties": {"id": 2}}]


def test_stacked_files(spark):
    a, b = spark.createDataFrame([("1", "x"), ("2", "y"), ("2", "y")], "k string, v string"), spark.createDataFrame([("x", "1"), ("z", "3")], "v string, k string")
    rows, counts = normalise.stacked_files({"a-2023.csv": a, "b-2024.csv": b})
    assert sorted(map(tuple, rows.collect())) == [("1", "x"), ("2", "y"), ("3", "z")] and tuple(counts.first()) == (5, 2)
    rows, counts = normalise.stacked_files({"a-2023.csv": a, "b-2024.csv": b}, r"-(\d+)\.", "file")
    assert sorted(map(tuple, rows.collect())) == [("1", "x", "2023"), ("1", "x", "2024"), ("2", "y", "2023"), ("3", "z", "2024")] and tuple(counts.first()) == (5, 1)
    with pytest.raises(normalise.SchemaError):
        normalise.stacked_files({"a.csv": a}, r"-(\d+)\.", "file")
    with pytest.raises(normalise.SchemaError):
        normalise.stacked_files({"a": a, "b": b.withColumnRenamed("v", "w")})


def test_members_share_a_header(spark, tmp_path):
    for name, text in {"x/orders_1.csv": "id, v\n1,a\n", "x/orders_2.csv": "id, v\n2,\"b\nc\"\n", "x/parts_1.csv": "p\n7\n", "x/readme.txt": "none\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = files.delimited_members(spark, str(tmp_path / "x"), r"/(\w+)_\d\.csv$")
    assert {k: sorted(map(tuple, d.collect())) for k, d in got.items()} == {"orders": [("1", "a"), ("2", "b\nc")], "parts": [("7",)]} and got["orders"].columns == ["id", "v"]
    (tmp_path / "x/orders_3.csv").write_text("v,id\nq,3\n")
    with pytest.raises(ValueError, match="different headers"):
        files.delimited_members(spark, str(tmp_path / "x"), r"/(\w+)_\d\.csv$")


def test_nested_records_are_refused(spark, tmp_path):
    (tmp_path / "n.xml").write_text("<all><rec><key>1</key><rec><key>2</key></rec></rec></all>")
    (tmp_path / "m.xml").write_text("<all><rec><a><rec><k>3</k></rec></a></rec><rec><a><b>4</b></a></rec></all>")
    for name in ("n.xml", "m.xml"):
        with pytest.raises(ValueError, match="name the outer one"):
            files.xml_records(spark, str(tmp_path / name), "rec")


def test_field_changes(spark):
    rows = [("a", v, f, t) for v, fields in (("1", {"x": "int", "y": "int"}), ("2", {"x": "long", "z": "int"}), ("4", {"x": "long", "z": "int"}), ("5", {"y": "int"})) for f, t in fields.items()] + [("b", "1", "x", "int")]
    got = sorted(map(tuple, versions.field_changes(spark.createDataFrame(rows, "dataset string, version string, field string, type string")).collect()))
    assert got == [("a", "2", "x", "retyped"), ("a", "2", "y", "removed"), ("a", "2", "z", "added"), ("a", "5", "x", "removed"), ("a", "5", "y", "added"), ("a", "5", "z", "removed")]
