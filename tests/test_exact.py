"""Sums of doubles against math.fsum, in any partitioning."""

import math
import random

from pyspark.sql import functions as F

from tidemark.operators import exact

SCHEMA = "g long, x double, y double"


def groups():
    rng = random.Random(11)
    wide = [math.ldexp(rng.random() - 0.5, rng.randint(-1070, 1000)) for _ in range(400)]
    money = [round(rng.uniform(-1e6, 1e6), 2) for _ in range(500)]
    cancel = [x for v in wide[:100] for x in (v, -v)] + [5e-324, 1e-300]
    ends = [1.7976931348623157e308, -1.7976931348623157e308, 1e292, 3.0]
    halves = [1.0, 2.0**-53, 2.0**-1074]
    return [wide, money, cancel, ends, halves, [1.0, 2.0**-53], [-1.0, -(2.0**-53), -(2.0**-54)], [1e-9] * 1000, [1e25, 1.0, -1e25], [0.0, -0.0], [5e-324] * 3, [2.0**k for k in range(-1074, 1000, 7)], [-(2.0**k) for k in range(-40, 90)], [0.1] * 10]


def test_as_fsum_in_any_partitioning(spark):
    cases = groups()
    rows = [(g, x, None if k % 3 else x) for g, case in enumerate(cases) for k, x in enumerate(case)]
    random.Random(5).shuffle(rows)
    for parts in (1, 7):
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        got = {r.g: (r.a, r.b, r.a_n, r.rows) for r in exact.exact_sums(df, ["g"], {"a": F.col("x"), "b": F.col("y")}, {"rows": (F.count("*"), F.sum)}).collect()}
        for g, case in enumerate(cases):
            assert got[g] == (math.fsum(case), math.fsum(case[::3]), len(case), len(case)), g


def test_flags(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, inf, 1.0), (0, 1.0, None), (1, -inf, None), (1, 2.0, None), (2, inf, 0.0), (2, -inf, None), (3, nan, 1e308), (3, 1.0, 1e308), (4, None, None), (None, 2.0, 2.0)]
    got = {r.g: (r.a, r.b) for r in exact.exact_sums(spark.createDataFrame(rows, SCHEMA), ["g"], {"a": F.col("x"), "b": F.col("y")}).collect()}
    assert got[0] == (inf, 1.0) and got[1] == (-inf, None) and math.isnan(got[2][0]) and math.isnan(got[3][0]) and got[3][1] == inf and got[4] == (None, None) and got[None] == (2.0, 2.0)
    assert exact.exact_sums(spark.createDataFrame([], SCHEMA), ["g"], {"a": F.col("x")}).collect() == []


def test_partial_sums_merge(spark):
    cases = groups()
    rows = [(g, x, None) for g, case in enumerate(cases) for x in case]
    parts = [exact.partials(spark.createDataFrame(rows[k::3], SCHEMA), ["g"], {"a": F.col("x")}) for k in range(3)]
    got = {r.g: r.a for r in exact.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["g"], ["a"]).collect()}
    assert got == {g: math.fsum(case) for g, case in enumerate(cases)}
