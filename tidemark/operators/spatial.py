"""Points in areas, tiles of the web map, and the layer version that is joined."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions.lineage import checkpointed


def on_edge(x: Column, y: Column, e: Column) -> Column:
    """Whether a point lies on the edge (x1, y1)-(x2, y2)."""
    cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    near = F.abs(cross) <= 1e-12
    return near & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))


def contains(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd ray cast over all edges of all rings (holes and parts alike); the boundary is inside."""

    def crosses(e: Column) -> Column:
        spans = (e["y1"] > y) != (e["y2"] > y)
        at = (e["x2"] - e["x1"]) * (y - e["y1"]) / F.when(e["y2"] == e["y1"], F.lit(1.0)).otherwise(e["y2"] - e["y1"]) + e["x1"]
        return spans & (x < at)

    return F.exists(edges, lambda e: on_edge(x, y, e)) | (F.size(F.filter(edges, crosses)) % 2 == 1)


def edges(rings: Column) -> Column:
    """Edges of an array of rings, each an array of (x, y), closed or not."""
    ring = lambda r: F.transform(r, lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.get(r, (i + 1) % F.size(r))["x"].alias("x2"), F.get(r, (i + 1) % F.size(r))["y"].alias("y2")))
    return F.flatten(F.transform(rings, ring))


#: Edges in a cell of a cover before it is cut into four, and how often a cell is cut at most.
CELL_EDGES, DEPTH = 16, 40
#: Where in a cell its reference point lies, off the places where edges are drawn.
REF_X, REF_Y = 0.3819660112501051, 0.4142135623730951

CELLS = "code string, name string, level int, i long, j long, inside boolean, edges array<struct<x1: double, y1: double, x2: double, y2: double>>"


def _crossings(px: float, py: float, qx: float, qy: float, e: np.ndarray) -> int:
    """How many edges the way from p to q crosses: along y = py to x = qx, then along x = qx."""
    x1, y1, x2, y2 = e.T
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (x2 - x1) * (py - y1) / np.where(y2 == y1, 1.0, y2 - y1) + x1
        up = (y2 - y1) * (qx - x1) / np.where(x2 == x1, 1.0, x2 - x1) + y1
    flat = ((y1 > py) != (y2 > py)) & ((px < at) != (qx < at))
    steep = ((x1 > qx) != (x2 > qx)) & ((py < up) != (qy < up))
    return int(flat.sum() + steep.sum())


def _touching(e: np.ndarray, x0: float, y0: float, size: float) -> np.ndarray:
    """Which edges touch a cell, by its box and the sides of each edge's line that its corners lie on; a little more than the cell counts."""
    more = size * 1e-9 + 1e-11
    a, b, c, d = x0 - more, y0 - more, x0 + size + more, y0 + size + more
    x1, y1, x2, y2 = e.T
    near = (np.minimum(x1, x2) <= c) & (np.maximum(x1, x2) >= a) & (np.minimum(y1, y2) <= d) & (np.maximum(y1, y2) >= b)
    sides = [(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x in (a, c) for y in (b, d)]
    return near & (np.minimum.reduce(sides) <= 0) & (np.maximum.reduce(sides) >= 0)


def quadtree(rings: list[list[tuple[float, float]]]) -> Iterator[tuple[int, int, int, bool, np.ndarray]]:
    """(level, i, j, whether the reference point is inside, edges) of the cells that cover an area; a cell of level l has sides of 2 ** -l.

    A cell that more than CELL_EDGES edges touch is cut into four. Cells that none touches are given if they lie inside. Whether a reference point is inside follows from that of the cell around by
    the edges on the way, which all touch that cell.
    """
    parts = [np.column_stack((r, np.roll(r, -1, axis=0))) for ring in rings if len(r := np.array(ring, float).reshape(-1, 2))]
    if not parts:
        return
    e = np.concatenate(parts)
    low, high = e.reshape(-1, 2).min(0), e.reshape(-1, 2).max(0)
    level = -math.ceil(math.log2(max(high[0] - low[0], high[1] - low[1], 2.0**-30)))
    size = 2.0**-level
    stack = []
    for i in range(math.floor(low[0] / size), math.floor(high[0] / size) + 1):
        for j in range(math.floor(low[1] / size), math.floor(high[1] / size) + 1):
            x, y = (i + REF_X) * size, (j + REF_Y) * size
            stack.append((level, i, j, _crossings(high[0] + size, high[1] + size, x, y, e) % 2 == 1, e[_touching(e, i * size, j * size, size)]))
    first = level
    while stack:
        level, i, j, inside, own = stack.pop()
        if not len(own) and not inside:
            continue
        if len(own) <= CELL_EDGES or level - first >= DEPTH:
            yield level, i, j, inside, own
            continue
        size = 2.0**-level
        half = size / 2
        x, y = (i + REF_X) * size, (j + REF_Y) * size
        for a in (2 * i, 2 * i + 1):
            for b in (2 * j, 2 * j + 1):
                crossed = _crossings(x, y, (a + REF_X) * half, (b + REF_Y) * half, own)
                stack.append((level + 1, a, b, inside != (crossed % 2 == 1), own[_touching(own, a * half, b * half, half)]))


def cover(areas: DataFrame) -> DataFrame:
    """The quadtree cells of every area (code, name, rings): CELLS. An area is cut up where its row is; each row given back has a few edges."""
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.struct([(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")]))]
    names = [c.split()[0] for c in CELLS.split(", ")[:7]]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        for batch in batches:
            rows = []
            for code, name, rings in zip(*(batch.column(k) for k in range(3))):
                drawn = [[(p["x"], p["y"]) for p in ring] for ring in rings.as_py() or []]
                for level, i, j, inside, e in quadtree(drawn):
                    rows.append((code.as_py(), name.as_py(), level, i, j, inside, [dict(zip(("x1", "y1", "x2", "y2"), x)) for x in e.tolist()]))
                    if len(rows) >= 10_000:
                        yield made(rows)
                        rows = []
            yield made(rows)

    return areas.select(F.col("code").cast("string"), F.col("name").cast("string"), "rings").mapInArrow(cells, CELLS)


def in_cell(x: Column, y: Column, level: Column, i: Column, j: Column, inside: Column, edges: Column) -> Column:
    """Whether a point of a cell lies in the area: as the reference point does, once for each edge on the way between them; the boundary is inside."""
    size = F.pow(F.lit(2.0), -level)
    rx, ry = (i + REF_X) * size, (j + REF_Y) * size

    def crossed(e: Column) -> Column:
        at = (e["x2"] - e["x1"]) * (y - e["y1"]) / F.when(e["y2"] == e["y1"], F.lit(1.0)).otherwise(e["y2"] - e["y1"]) + e["x1"]
        up = (e["y2"] - e["y1"]) * (rx - e["x1"]) / F.when(e["x2"] == e["x1"], F.lit(1.0)).otherwise(e["x2"] - e["x1"]) + e["y1"]
        flat = ((e["y1"] > y) != (e["y2"] > y)) & ((x < at) != (rx < at))
        steep = ((e["x1"] > rx) != (e["x2"] > rx)) & ((y < up) != (ry < up))
        return flat != steep

    return F.exists(edges, lambda e: on_edge(x, y, e)) | (inside != (F.size(F.filter(edges, crossed)) % 2 == 1))


def point_in_area(points: DataFrame, areas: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Each point with the code and name of the area it lies in: the least code where several hold it, NULL where none does.

    areas: code, name, rings (holes and parts alike, even-odd). Areas are covered by quadtree cells: a point in an inner cell is answered by the cell, one in a border
    cell by the few edges that touch it, so no list of edges is copied, however long. A point meets cells by equality on (level, i, j), once for each level that is in
    use (a few tens at most come to the driver); cells of dense points are split by Spark's skew join. Points must be told apart by their columns; equal ones get equal answers.
    """
    cells = checkpointed(cover(areas))
    levels = sorted(r.level for r in cells.select("level").distinct().collect())
    places = points.select(F.col(lon).cast("double").alias("_x"), F.col(lat).cast("double").alias("_y")).where("_x is not null and _y is not null and not isnan(_x) and not isnan(_y)").distinct()
    at = lambda c, k: F.floor(F.col(c) * 2.0**k).cast("long")
    asked = places.withColumn("_c", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), at("_x", k).alias("i"), at("_y", k).alias("j")) for k in levels]))).select("_x", "_y", "_c.*") if levels else places.limit(0).selectExpr("_x", "_y", "0 as level", "0L as i", "0L as j")
    hit = asked.join(cells, ["level", "i", "j"]).where(in_cell(F.col("_x"), F.col("_y"), F.col("level"), F.col("i"), F.col("j"), F.col("inside"), F.col("edges")))
    found = hit.groupBy("_x", "_y").agg(F.min_by(F.struct("code", "name"), "code").alias("_a"))
    return points.join(found, (points[lon].cast("double") == F.col("_x")) & (points[lat].cast("double") == F.col("_y")), "left").select(*points.columns, F.col("_a.code").alias("code"), F.col("_a.name").alias("name"))


def pinned_layer(fetches: DataFrame, layers: DataFrame) -> DataFrame:
    """Each fetch with the newest layer version that was held then: layer, version pairs of either table, day of fetch.

    The two are put in one order by layer and day, and the last version before a fetch is carried to it: no range join.
    """
    rows = fetches.select("layer", F.col("day").alias("_at"), F.lit(1).alias("_kind"), F.struct(*fetches.columns).alias("_f"), F.lit(None).cast("date").alias("version"))
    held = layers.select("layer", F.col("version").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(rows.schema["_f"].dataType).alias("_f"), "version")
    w = W.partitionBy("layer").orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    both = rows.unionByName(held).withColumn("pinned", F.last("version", True).over(w))
    return both.where("_kind = 1").select("_f.*", "pinned")


def tile(lon: Column, lat: Column, zoom: Column) -> tuple[Column, Column]:
    """Web Mercator tile of a place."""
    n = F.pow(F.lit(2.0), zoom)
    limit = 85.05112878
    r = F.radians(F.least(F.lit(limit), F.greatest(F.lit(-limit), lat)))
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.log(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * n)
    clip = lambda v: F.least(F.greatest(v, F.lit(0)), n - 1).cast("int")
    return clip(x), clip(y)


def tile_bins(boxes: DataFrame, zooms: list[int]) -> DataFrame:
    """zoom, x, y, n: features whose box (west, south, east, north) covers a tile."""
    rows = boxes.withColumn("zoom", F.explode(F.array(*[F.lit(z) for z in zooms])))
    x0, y0 = tile(F.col("west"), F.col("north"), F.col("zoom"))
    x1, y1 = tile(F.col("east"), F.col("south"), F.col("zoom"))
    rows = rows.select("zoom", F.explode(F.sequence(x0, x1)).alias("x"), y0.alias("_y0"), y1.alias("_y1"))
    return rows.select("zoom", "x", F.explode(F.sequence("_y0", "_y1")).alias("y")).groupBy("zoom", "x", "y").agg(F.count("*").alias("n"))
