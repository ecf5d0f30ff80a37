"""Delimited files in blocks smaller than their records, against the csv module."""

import csv
import io
import random

import pytest

from tidemark.sources import files


@pytest.fixture
def blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_quoted_new_lines_under_a_preamble(spark, tmp_path):
    (tmp_path / "a.csv").write_text('first "line\nsecond\nId,Name\n1,"a\nb"\n2,\n3\n\n4,"say ""x"", y"\n')
    got = sorted((tuple(r) for r in files.delimited(spark, str(tmp_path / "a.csv"), header_row=3).collect()), key=str)
    assert got == [("1", "a\nb"), ("2", None), ("3", None), ("4", 'say "x", y')]


def test_many_blocks(spark, tmp_path, blocks):
    rng = random.Random(2)
    cells = ["plain", "a, b", 'say "x"', "two\nlines", 'one\n"quoted"\n\nfour\n', "long " * 60, "é\nü"]
    rows = [[str(k), rng.choice(cells), rng.choice(cells)] for k in range(120)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([["Key ", "One", 'Two "2"'], *rows])
    text = out.getvalue()
    (tmp_path / "a.csv").write_text("a \"note\nof two lines\n" + text)
    df = files.delimited(spark, str(tmp_path / "a.csv"), header_row=3)
    assert df.columns == ["Key ", "One", 'Two "2"']
    assert sorted(map(list, df.collect())) == sorted(rows)
    assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 20
    (tmp_path / "b.csv").write_text("﻿" + text.replace("\n", "\r\n"), newline="")
    assert sorted(map(list, files.delimited(spark, str(tmp_path / "b.csv")).collect())) == sorted(rows)


def test_headers_by_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\ty\n1\t2\n")
    (tmp_path / "b.csv").write_text("y\tx\tz\n3\t4\t5\n")
    (tmp_path / "c.csv").write_text("x\ty\n")
    df = files.delimited(spark, str(tmp_path / "*.csv"), "tab")
    assert sorted((r.x, r.y, r.z) for r in df.collect()) == [("1", "2", None), ("4", "3", "5")]


def test_free_version_after_many_taken(spark):
    from tidemark.operators.versions import free_version

    taken = spark.range(10_000).selectExpr("'a' dataset", "date_add(date '1990-01-01', cast(id as int)) version").unionByName(spark.sql("select 'a' dataset, date '1989-12-30' version union all select 'b', date '2000-01-02' union all select 'b', null"))
    changed = spark.sql("select 'a' dataset, date '1995-01-01' day union all select 'b', date '2000-01-01' union all select 'c', date '2000-01-01'")
    assert sorted((r.dataset, str(r.version)) for r in free_version(changed, taken).collect()) == [("a", "2017-05-19"), ("b", "2000-01-01"), ("c", "2000-01-01")]


def test_field_profile_gathers_only_few(spark):
    from tidemark.operators.rollup import field_profile

    df = spark.range(1000).selectExpr("id", "id % 3 a", "if(id % 2 = 0, null, 'x') b", "cast(null as string) c", "id % 13 d")
    got = {r.field: (r.distinct, r.low, r.high, r["values"]) for r in field_profile(df, ["id", "a", "b", "c", "d"]).collect()}
    assert got == {"id": (1000, "0", "999", None), "a": (3, "0", "2", "0;1;2"), "b": (1, "x", "x", "x"), "d": (13, "0", "9", None)}
    plan = field_profile(df, ["id", "a"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
