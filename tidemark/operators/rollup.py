"""Precomputed cubes: statistics, the choice of field sets, grouping sets, answers from a cube when they are exact; series and grids."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators.exact import digit_sums, merged, prepared
from tidemark.operators.query import aggregate_query, where


def distinct_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, estimate: about how many values each field has, NULL as one."""
    made = [F.struct(F.lit(f).alias("field"), (F.approx_count_distinct(f) + F.max(F.col(f).isNull().cast("int"))).alias("estimate")) for f in fields]
    return df.agg(F.array(*made).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def group_counts(df: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """fields, estimate: about how many groups each field set has, all in one pass."""
    made = [F.struct(F.lit(",".join(s)).alias("fields"), F.approx_count_distinct(F.struct(*s)).alias("estimate")) for s in sets]
    return df.agg(F.array(*made).alias("x")).select(F.explode("x").alias("x")).select("x.*")


# Weights of a question that a register names, of one about one field and of one about two; the largest share of the
# table's rows that a cube may have as groups; bytes of a cube for each group, and for each of its fields and metrics in it.
NAMED, ONE, TWO = 100, 10, 1
SHARE = 0.5
# Of how many fields, those that readers count by most, two are put together.
PAIRED = 24
GROUP_BYTES, FIELD_BYTES, METRIC_BYTES = 1.2, 0.9, 6.0


def questions(fields: list[str], named: list[tuple[str, ...]] = ()) -> dict[frozenset[str], int]:
    """What readers may count by, and how much each is worth: the sets that a register names, every field, every two of the first PAIRED."""
    worth = [(h, NAMED) for h in named] + [((f,), ONE) for f in fields] + [(two, TWO) for two in combinations(fields[:PAIRED], 2)]
    total: dict[frozenset[str], int] = {}
    for s, w in worth:
        total[frozenset(s)] = total.get(frozenset(s), 0) + w
    return total


def plan(df: DataFrame, fields: list[str], metrics: list[str], cap: int, named: list[tuple[str, ...]] = (), batch: int = 64) -> list[tuple[str, ...]]:
    """Field sets to keep as cubes: again and again the one that answers most open questions by worth for each byte it is estimated to take,
    while it fits in what is left of `cap` bytes.

    A set answers the questions inside it. Fields of one value, and sets with more groups than SHARE of the table's rows, are
    left out. Group counts are estimated `batch` sets a pass; what the driver sees is one number for each set.
    """
    rows = df.count()
    values = {r.field: r.estimate for r in distinct_counts(df, fields).collect()}
    asked = [f for f in fields if 1 < values[f] <= SHARE * rows]
    named = [tuple(sorted(h)) for h in named if set(h) <= set(fields)]
    first_asked = {f for h in named for f in h}
    asked.sort(key=lambda f: (f not in first_asked, values[f], f))
    still_open = questions(asked, named)
    sets = sorted(tuple(sorted(q)) for q in still_open)
    passes = [group_counts(df, sets[k : k + batch]).collect() for k in range(0, len(sets), batch)]
    groups = {tuple(r.fields.split(",")): r.estimate for some in passes for r in some}
    price = {s: n * (GROUP_BYTES + FIELD_BYTES * len(s) + METRIC_BYTES * sum(m not in s for m in metrics)) for s, n in groups.items() if n <= SHARE * rows}
    kept: list[tuple[str, ...]] = []
    while price:
        value = {s: sum(w for q, w in still_open.items() if q <= set(s)) / max(1, cost) for s, cost in price.items()}
        first = min(price, key=lambda s: (-value[s], s))
        if not value[first]:
            return kept
        cost = price.pop(first)
        if cost <= cap:
            kept.append(first)
            cap -= cost
            still_open = {q: w for q, w in still_open.items() if not q <= set(first)}
    return kept


def cubes(df: DataFrame, sets: list[tuple[str, ...]], metrics: list[str], batch: int = 16) -> DataFrame:
    """One row for each group of each field set: cube, fields, count and n, sum, min, max of the metrics.

    A rolled-up field is NULL and not in the cube's name, so a real NULL is told from it. `batch` sets a pass bound how often
    a row is expanded. Sums of doubles are exact before they are rounded once; whole numbers and decimals sum as they are.
    """
    kinds = dict(df.dtypes)
    names = sorted({f for s in sets for f in s})
    doubles = {f"{m}_sum": F.col(m) for m in metrics if kinds[m] in ("double", "float")}
    bins = [f"{k}_bin" for k in doubles]
    also = {"count": (F.count("*"), F.sum)}
    for m in metrics:
        also |= {f"{m}_n": (F.count(m), F.sum), f"{m}_min": (F.min(m), F.min), f"{m}_max": (F.max(m), F.max)}
        if f"{m}_sum" not in doubles:
            also[f"{m}_sum"] = (F.sum(m), F.sum)
    rows, out = prepared(df, doubles), None
    for at in range(0, len(sets), batch):
        some = sets[at : at + batch]
        here = sorted({f for s in some for f in s})
        order = [*here, *bins]
        made = rows.groupingSets([[F.col(f) for f in (*s, *bins)] for s in some], *order).agg(F.grouping_id(*order).alias("_id"), *digit_sums(doubles), *[c.alias(n) for n, (c, _) in also.items()])
        ids = {sum(1 << (len(order) - 1 - k) for k, f in enumerate(here) if f not in s): ",".join(s) for s in some}
        cube = F.create_map(*[x for k, v in ids.items() for x in (F.lit(k).cast("bigint"), F.lit(v))])
        made = made.select(cube[F.col("_id")].alias("cube"), *[F.col(f) if f in here else F.lit(None).cast(kinds[f]).alias(f) for f in names], *[c for c in made.columns if c not in here and c != "_id"])
        out = made if out is None else out.unionByName(made)
    if doubles:
        out = merged(out, ["cube", *names], list(doubles), also)
    return out.select("cube", *names, "count", *[f"{m}_{x}" for m in metrics for x in ("n", "sum", "min", "max")])


def cube_for(sets: list[tuple[str, ...]], fields: set[str], sizes: dict[tuple[str, ...], int]) -> tuple[str, ...] | None:
    """The smallest cube that holds every field named."""
    fit = [s for s in sets if fields <= set(s)]
    return min(fit, key=lambda s: (sizes.get(s, 0), len(s), s), default=None)


def exact(df: DataFrame, metrics: list[str], kept: list[str]) -> bool:
    """Whether a cube's answer is the base table's: counts, minima and maxima always; sums and averages of whole numbers."""
    kinds = dict(df.dtypes)
    for m in metrics:
        fn, _, f = m.partition(".")
        if m != "count" and f not in kept:
            return False
        if fn in ("sum", "avg") and kinds[f] not in ("tinyint", "smallint", "int", "bigint", "boolean"):
            return False
    return True


def answer(base: DataFrame, cube_rows: DataFrame, sets: list[tuple[str, ...]], kept: list[str], groups: list[str], metrics: list[str], conditions: list[tuple[str, str]], sizes: dict[tuple[str, ...], int] | None = None) -> DataFrame:
    """The aggregate query from the smallest cube (by `sizes`, groups of each) that gives it exactly, else from the base table."""
    fields = set(groups) | {f for f, _ in conditions}
    cube = cube_for(sets, fields, sizes or {})
    if cube is None or not exact(base, metrics, kept):
        return aggregate_query(base, groups, metrics, conditions)
    return from_cube(cube_rows.where(F.col("cube") == ",".join(cube)), groups, metrics, conditions)


def from_cube(rows: DataFrame, groups: list[str], metrics: list[str], conditions: list[tuple[str, str]]) -> DataFrame:
    """The aggregate query from one cube's rows."""
    made = []
    for m in metrics:
        fn, _, f = m.partition(".")
        name = "count" if m == "count" else f"{fn}_{f}"
        made.append({
            "count": lambda: F.coalesce(F.sum("count" if m == "count" else f"{f}_n"), F.lit(0)),
            "sum": lambda: F.sum(f"{f}_sum").cast("bigint"), "avg": lambda: F.sum(f"{f}_sum") / F.nullif(F.sum(f"{f}_n"), F.lit(0)),
            "min": lambda: F.min(f"{f}_min"), "max": lambda: F.max(f"{f}_max"),
        }[fn]().alias(name))
    return where(rows, conditions).groupBy(*groups).agg(*made)


def field_profile(df: DataFrame, fields: list[str], few: int = 12) -> DataFrame:
    """field, distinct, low, high and, when there are few, the sorted values; of every field in one scan.

    Values meet once each, dealt by field and value; counts and ends are partial sums of those, and only fields of at most `few` values gather them. A field without values has no row.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")
    values = df.select(pairs).select("x.*").where("value is not null").groupBy("field", "value").agg(F.lit(1).alias("_one"))
    ends = values.groupBy("field").agg(F.count("*").alias("distinct"), F.min("value").alias("low"), F.max("value").alias("high"))
    short = values.join(ends.where(F.col("distinct") <= few).select("field"), "field", "left_semi")
    listed = short.groupBy(F.col("field").alias("_field")).agg(F.array_join(F.array_sort(F.collect_list("value")), ";").alias("values"))
    return ends.join(listed, F.col("field") == F.col("_field"), "left").drop("_field")


def pick_example(df: DataFrame, filter_field: str, group_field: str, least: int = 20) -> DataFrame:
    """value, rows, groups: the commonest value of one field with `least` rows and more than one value of the other inside."""
    made = df.groupBy(F.col(filter_field).alias("value")).agg(F.count("*").alias("rows"), F.count_distinct(group_field).alias("groups"))
    return made.where((F.col("rows") >= least) & (F.col("groups") > 1)).orderBy(F.desc("rows"), "value").limit(1)


def yearly_series(df: DataFrame, day: str, split: str, metric: Column) -> DataFrame:
    """year, category, value, partial: years 1800 to 2200; the first and last year are partial where days at their ends lack."""
    rows = df.withColumn("year", F.year(day)).where("year between 1800 and 2200")
    span = rows.agg(F.min(F.to_date(day)).alias("_low"), F.max(F.to_date(day)).alias("_high"))
    made = rows.groupBy("year", F.col(split).alias("category")).agg(metric.alias("value")).crossJoin(F.broadcast(span))  # one row
    part = ((F.col("year") == F.year("_low")) & (F.dayofyear("_low") > 1)) | ((F.col("year") == F.year("_high")) & (F.add_months(F.trunc("_high", "year"), 12) > F.date_add("_high", 1)))
    return made.withColumn("partial", part).drop("_low", "_high")


def top_n_other(df: DataFrame, category: str, value: str, n: int) -> DataFrame:
    """Categories after the n largest, as Other."""
    totals = df.groupBy(category).agg(F.sum(value).alias("_t"))
    kept = totals.orderBy(F.desc("_t"), category).limit(n).select(category, F.lit(True).alias("_keep"))
    named = df.join(F.broadcast(kept), category, "left").withColumn(category, F.when(F.col("_keep"), F.col(category)).otherwise("Other"))  # n rows
    return named.groupBy(category).agg(F.sum(value).alias(value))


def grid(df: DataFrame, lon: str, lat: str, box: tuple[float, float, float, float], step: float) -> DataFrame:
    """i, j, n: rows in each cell of a grid inside a box."""
    x0, y0, x1, y1 = box
    inside = df.where(F.col(lon).between(x0, x1) & F.col(lat).between(y0, y1))
    return inside.groupBy(F.floor((F.col(lon) - x0) / step).cast("int").alias("i"), F.floor((F.col(lat) - y0) / step).cast("int").alias("j")).agg(F.count("*").alias("n"))


def grid_merge(grids: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), grids).groupBy("i", "j").agg(F.sum("n").alias("n"))


def partition_index(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, value, n: the values of each declared field."""
    return reduce(lambda a, b: a.unionByName(b), [df.groupBy(F.col(f).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(f).alias("field"), "value", "n") for f in fields])


def place_summary(df: DataFrame, place: str) -> DataFrame:
    """place, rows, share of the table."""
    made = df.groupBy(place).agg(F.count("*").alias("rows"))
    total = df.agg(F.count("*").alias("_t"))
    return made.crossJoin(F.broadcast(total)).withColumn("share", F.col("rows") / F.col("_t")).drop("_t")  # one row
