"""Points in areas by quadtree cells against a ray cast over all edges: holes, shared borders, corners, and one area of many edges."""

import math
import random

from pyspark.sql import functions as F

from tidemark.operators import spatial as sp

AREAS = "code string, name string, rings array<array<struct<x: double, y: double>>>"
POINTS = "id long, lon double, lat double"


def brute(spark, points, areas):
    p, a = spark.createDataFrame(points, POINTS), spark.createDataFrame(areas, AREAS).select("code", sp.edges(F.col("rings")).alias("e"))
    hit = p.join(F.broadcast(a), sp.contains(F.col("lon"), F.col("lat"), F.col("e")), "left")
    return {r.id: r.code for r in hit.groupBy("id").agg(F.min("code").alias("code")).collect()}


def star(rng, x, y, r, n):
    return [(x + rng.uniform(0.3, 1) * r * math.cos(2 * math.pi * k / n), y + rng.uniform(0.3, 1) * r * math.sin(2 * math.pi * k / n)) for k in range(n)]


def test_as_a_ray_cast(spark):
    rng = random.Random(6)
    box = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    areas = [("010", "a", [box(0.0, 0.0, 8.0), box(2.0, 2.0, 1.0)]), ("005", "b", [box(8.0, 0.0, 8.0), box(30.0, 30.0, 0.5)]), ("020", "c", [star(rng, -7.0, 3.0, 6.0, 90)]), ("021", "d", [star(rng, 3.0, -9.0, 5.0, 7), star(rng, 3.0, -9.0, 1.0, 40)]), ("022", "e", [box(2.0, 2.0, 1.0)]), ("099", "f", []), ("098", "g", None)]
    areas += [(f"1{k:02}", "s", [box(-20.0 + k / 4, -20.0, 0.25)]) for k in range(12)]
    corners = [p for _, _, rings in areas for ring in rings or [] for p in ring]
    middles = [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for _, _, rings in areas[:2] + areas[4:5] + areas[7:] for ring in rings for a, b in zip(ring, ring[1:] + ring[:1])]
    places = corners + middles + [(rng.uniform(-22, 18), rng.uniform(-22, 12)) for _ in range(1500)] + [(rng.randint(-21, 17) / 1.0, rng.randint(-21, 10) / 1.0) for _ in range(200)] + [(30.25, 30.25), (None, 1.0), (1.0, None), (float("nan"), 1.0), (1e300, 1.0)]
    points = [(k, x, y) for k, (x, y) in enumerate(places)]
    got = {r.id: r.code for r in sp.point_in_area(spark.createDataFrame(points, POINTS), spark.createDataFrame(areas, AREAS)).collect()}
    want = brute(spark, points, areas)
    assert len(got) == len(points) and {k: (v, want[k], places[k]) for k, v in got.items() if v != want[k]} == {}
    assert set(want.values()) >= {"005", "010", "020", "021", "022", None, "100", "111"}


def test_one_area_of_many_edges(spark):
    """100,000 edges and points crowded on the border: no row carries more than a few edges, and all together little more than the area has."""
    n = 100_000
    ring = [((r := 20 + math.sin(k / 9)) * math.cos(2 * math.pi * k / n), r * math.sin(2 * math.pi * k / n)) for k in range(n)]
    area = spark.createDataFrame([("1", "one", [ring])], AREAS)
    size = sp.cover(area).select(F.size("edges").alias("n")).agg(F.max("n"), F.sum("n"), F.count("*")).first()
    assert size[0] <= sp.CELL_EDGES and size[1] < 3 * n and size[2] < n
    inside = lambda x, y: math.hypot(x, y)
    rng = random.Random(8)
    points = [(k, d * math.cos(a), d * math.sin(a)) for k in range(3000) for d, a in [(rng.choice([rng.uniform(0, 18.9), rng.uniform(21.1, 30)]), rng.uniform(0, 2 * math.pi))]]
    got = {r.id: r.code for r in sp.point_in_area(spark.createDataFrame(points, POINTS), area).collect()}
    assert all((got[k] == "1") == (inside(x, y) < 20) for k, x, y in points)


def test_empty_tables(spark):
    points, areas = spark.createDataFrame([(1, 2.0, 2.0)], POINTS), spark.createDataFrame([], AREAS)
    assert [(r.id, r.code) for r in sp.point_in_area(points, areas).collect()] == [(1, None)]
    assert sp.point_in_area(points.limit(0), areas).collect() == []
