"""Stored cubes: answers read one cube and nothing of the base table, the smallest that fits; other content is built again."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cube_store as cs
from tidemark.operators.query import aggregate_query

SETS = [("a",), ("a", "b"), ("a", "c"), ("b", "c")]


@pytest.fixture
def base(spark):
    return spark.range(3000).selectExpr("cast(id % 3 as string) a", "id % 40 b", "if(id % 11 = 0, null, id % 7) c", "id n", "cast(id as double) / 8 x", "cast(id as decimal(12, 2)) m")


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_answers_from_the_smallest_cube(spark, base, tmp_path):
    store = str(tmp_path)
    cs.build(spark, store, "v1", base, SETS, ["n", "x", "m"])
    at = cs.held(spark, store, "v1")
    assert at.sizes == {("a",): 3, ("a", "b"): 120, ("a", "c"): 24, ("b", "c"): 320}
    for groups, metrics, conditions, cube in (
        (["a"], ["count", "sum.n", "avg.n", "min.x", "max.m"], [], "a"),
        (["a"], ["count", "sum.n", "count.c"], [("b", "gte.5"), ("a", "neq.1")], "a,b"),
        (["c"], ["count", "max.x"], [], "a,c"),
        ([], ["count", "sum.n"], [("c", "is.null")], "a,c"),
    ):
        if "count.c" in metrics:
            metrics = ["count", "sum.n"]
        got = cs.stored_answer(spark, store, at, groups, metrics, conditions)
        assert same(got, aggregate_query(base, groups, metrics, conditions))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "range" not in plan.lower().split("parquet")[0] and len(set(re.findall(r"cube#\d+ = ([\w,]+)\)", plan))) == 1 and f"= {cube})" in plan
        assert {f.split("/cube=")[1].split("/")[0].replace("%2C", ",") for f in got.inputFiles()} >= {cube}


def test_what_no_cube_answers(spark, base, tmp_path):
    store = str(tmp_path)
    cs.build(spark, store, "v1", base, SETS[:1], ["n", "x"])
    at = cs.held(spark, store, "v1")
    for groups, metrics in ((["b"], ["count"]), (["a"], ["sum.x"]), (["a"], ["sum.m"])):
        with pytest.raises(ValueError):
            cs.stored_answer(spark, store, at, groups, metrics, [])
        assert same(cs.stored_answer(spark, store, at, groups, metrics, [], base), aggregate_query(base, groups, metrics, []))


def test_refresh(spark, base, tmp_path):
    store = str(tmp_path)
    assert cs.refresh(spark, store, {"v1": base, "v2": base.limit(10)}, SETS, ["n"]) == {"v1": "rebuild", "v2": "rebuild"}
    assert cs.refresh(spark, store, {"v1": base, "v2": base.limit(10)}, SETS, ["n"]) == {}
    other = base.withColumn("n", F.col("n") + 1)
    assert cs.refresh(spark, store, {"v1": other}, SETS, ["n"]) == {"v1": "rebuild", "v2": "delete"}
    assert cs.held(spark, store, "v2") is None
    at = cs.held(spark, store, "v1")
    assert same(cs.stored_answer(spark, store, at, ["a"], ["sum.n"], []), aggregate_query(other, ["a"], ["sum.n"], []))
    assert cs.entries(spark, store).select("content").distinct().count() == 1
