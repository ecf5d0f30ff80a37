"""The row and aggregate query language: conditions, projection, order, page, groups, metrics.

A condition is (field, "op.value"), ops eq neq gt gte lt lte in.(a,b) is.null like ilike, each with an optional not. before
it. Everything becomes Columns of one lazy plan; only field names and literals are checked on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tidemark.operators.exact import exact_sums

MAX_VALUES, MAX_ROWS = 90, 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class QueryError(ValueError):
    """A question that cannot be asked of this table."""


def _field(df: DataFrame, name: str) -> T.StructField:
    for f in df.schema.fields:
        if f.name == name:
            return f
    raise QueryError(f"no field {name}; fields are {', '.join(df.columns)}")


def typed(df: DataFrame, name: str, text: str) -> Column:
    """A literal of the field's type; a word where a number belongs is refused."""
    kind = _field(df, name).dataType
    if isinstance(kind, T.NumericType):
        try:
            return F.lit(int(text)) if text.lstrip("+-").isdigit() else F.lit(float(text))
        except ValueError:
            raise QueryError(f"{name} takes a number, not {text!r}") from None
    if isinstance(kind, T.BooleanType):
        if text not in ("true", "false", "1", "0"):
            raise QueryError(f"{name} takes true or false, not {text!r}")
        return F.lit(text in ("true", "1"))
    return F.lit(text).cast(kind) if isinstance(kind, (T.DateType, T.TimestampNTZType, T.TimestampType)) else F.lit(text)


def like(column: Column, pattern: str) -> Column:
    """* is any text; % and _ are themselves; case counts for no ASCII letter."""
    text = pattern.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_").replace("*", "%")
    return F.translate(column.cast("string"), UPPER, LOWER).like(text.translate(str.maketrans(UPPER, LOWER)))


def condition(df: DataFrame, name: str, spec: str) -> Column:
    """One condition. NULL fields pass none but is.null, not even a negated one."""
    column, negated = F.col(_field(df, name).name), spec.startswith("not.")
    op, _, value = spec.removeprefix("not.").partition(".")
    if op in ("eq", "neq", "gt", "gte", "lt", "lte"):
        a = typed(df, name, value)
        made = {"eq": column == a, "neq": column != a, "gt": column > a, "gte": column >= a, "lt": column < a, "lte": column <= a}[op]
    elif op == "in":
        values = [v for v in value.strip("()").split(",") if v]
        if not values:
            raise QueryError(f"in.() of {name} lists nothing")
        made = column.isin(*[typed(df, name, v) for v in values])
    elif op == "is" and value == "null":
        made = column.isNull()
    elif op in ("like", "ilike"):
        made = like(column, value)
    else:
        raise QueryError(f"unknown condition {spec!r} on {name}")
    return ~made if negated else made


def where(df: DataFrame, conditions: list[tuple[str, str]]) -> DataFrame:
    """Rows that meet every condition; a field may be named twice."""
    if sum(max(1, spec.count(",") + 1) for _, spec in conditions) > MAX_VALUES:
        raise QueryError(f"more than {MAX_VALUES} values")
    return df.where(reduce(lambda a, b: a & b, [condition(df, *c) for c in conditions])) if conditions else df


def where_map(df: DataFrame, wanted: dict) -> DataFrame:
    """The dict form: None, a list, {min, max, like}, or a value."""
    made = []
    text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    for name, v in wanted.items():
        if v is None:
            made.append((name, "is.null"))
        elif isinstance(v, (list, tuple)):
            made.append((name, "in.(" + ",".join(map(text, v)) + ")"))
        elif isinstance(v, dict):
            made += [(name, f"{op}.{text(v[k])}") for k, op in (("min", "gte"), ("max", "lte"), ("like", "ilike")) if k in v]
        else:
            made.append((name, f"eq.{text(v)}"))
    return where(df, made)


def newest(df: DataFrame, name: str) -> DataFrame:
    """Rows of the field's largest value; of values that begin with a digit where there are any."""
    text = F.col(_field(df, name).name).cast("string")
    top = df.agg(F.coalesce(F.max(F.when(text.rlike("^[0-9]"), F.col(name))), F.max(name)).alias("_top"))
    return df.join(F.broadcast(top), F.col(name) == F.col("_top")).drop("_top")  # one row


def order_by(df: DataFrame, spec: str, tie: str | None = None) -> list[Column]:
    """f.asc,g.desc to sort columns: NULL first ascending and last descending, ties by position."""
    out = []
    for part in filter(None, spec.split(",")):
        name, _, way = part.partition(".")
        if way not in ("", "asc", "desc"):
            raise QueryError(f"order {part!r}")
        c = F.col(_field(df, name).name)
        out.append(c.desc_nulls_last() if way == "desc" else c.asc_nulls_first())
    return out + ([F.col(tie).asc_nulls_first()] if tie else [])


def page(df: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """limit rows and one more, which says that more follow."""
    if not 1 <= limit <= MAX_ROWS or offset < 0:
        raise QueryError(f"limit is 1 to {MAX_ROWS}, offset 0 or more")
    return df.offset(offset).limit(limit + 1) if offset else df.limit(limit + 1)


def rows_query(df: DataFrame, conditions: list[tuple[str, str]], select: list[str] | None = None, order: str = "", limit: int = 100, offset: int = 0, position: str = "_pos") -> DataFrame:
    """Filter, sort by the order or the source's position, take one page, project."""
    names = select or [c for c in df.columns if c != position]
    for n in names:
        _field(df, n)
    return page(where(df, conditions).orderBy(*order_by(df, order, position)), limit, offset).select(*names)


def matched(df: DataFrame, conditions: list[tuple[str, str]]) -> DataFrame:
    return where(df, conditions).agg(F.count("*").alias("total"))


def metric(df: DataFrame, spec: str) -> Column:
    """count, count.f, sum.f, avg.f, min.f, max.f as fn_f; sums and averages of numbers and booleans alone."""
    fn, _, name = spec.partition(".")
    if spec == "count":
        return F.count("*").alias("count")
    kind, c = _field(df, name).dataType, F.col(name)
    if fn in ("sum", "avg"):
        if isinstance(kind, T.BooleanType):
            c = c.cast("int")
        elif not isinstance(kind, T.NumericType):
            raise QueryError(f"{fn} needs a number, {name} is {kind.simpleString()}")
    if fn not in ("count", "sum", "avg", "min", "max"):
        raise QueryError(f"unknown metric {spec!r}")
    return getattr(F, fn)(c).alias(f"{fn}_{name}")


def aggregated(df: DataFrame, groups: list[str], metrics: list[str]) -> DataFrame:
    """Groups with metrics. Sums and averages of doubles are exact before they are rounded once, so no order of rows changes them."""
    made = [metric(df, m) for m in metrics]
    split = [m.partition(".")[::2] for m in metrics]
    doubles = sorted({f for fn, f in split if fn in ("sum", "avg") and isinstance(_field(df, f).dataType, (T.DoubleType, T.FloatType))})
    if not doubles:
        return df.groupBy(*groups).agg(*made)
    also, out = {}, []
    for m, (fn, f) in zip(metrics, split):
        name = "count" if m == "count" else f"{fn}_{f}"
        if f in doubles and fn in ("sum", "avg"):
            total = F.col(f"_sum_{f}")
            out.append((total if fn == "sum" else total / F.nullif(F.col(f"_sum_{f}_n"), F.lit(0))).alias(name))
        elif fn == "avg":
            also |= {f"_of_{f}": (F.sum(F.col(f).cast("long") if isinstance(_field(df, f).dataType, T.BooleanType) else F.col(f)), F.sum), f"_n_{f}": (F.count(f), F.sum)}
            out.append((F.col(f"_of_{f}") / F.nullif(F.col(f"_n_{f}"), F.lit(0))).alias(name))
        else:
            also[f"_{name}"] = (metric(df, m), F.sum if fn in ("count", "sum") else getattr(F, fn))
            out.append((F.coalesce(F.col(f"_{name}"), F.lit(0).cast("long")) if fn == "count" else F.col(f"_{name}")).alias(name))
    return exact_sums(df, groups, {f"_sum_{f}": F.col(f) for f in doubles}, also).select(*groups, *out)


def aggregate_query(df: DataFrame, groups: list[str], metrics: list[str], conditions: list[tuple[str, str]] | None = None, order: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Groups (NULL is one) with metrics, ordered by `order` and then by group, so a page's edge never moves. No group: one row."""
    made = aggregated(where(df, conditions or []), groups, metrics)
    if order is not None or limit:
        made = made.orderBy(*order_by(made, order or ""), *[F.col(g).asc_nulls_first() for g in groups])
    return page(made, limit, offset) if limit else made


def spread_sample(df: DataFrame, n: int, spread: str | None, position: str = "_pos") -> DataFrame:
    """n rows in which the spread field's values take turns, else the first n."""
    if spread is None:
        return df.orderBy(position).limit(n)
    turn = F.row_number().over(W.partitionBy(spread).orderBy(position))
    return df.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", position).limit(n)


def profile_order(sort: list[str], key: list[str], position: str = "_pos") -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in dict.fromkeys([*sort, *key, position])]


def profile_sort(df: DataFrame, sort: list[str], key: list[str], position: str = "_pos") -> DataFrame:
    """A total order: the declared sort, the key, the position, NULLs last."""
    return df.orderBy(*profile_order(sort, key, position))
