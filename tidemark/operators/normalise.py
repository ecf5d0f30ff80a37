"""From all-text tables to typed ones under a declared schema: projection, blanks, markers, suppression, casts, dates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean", "date": "date", "datetime": "timestamp_ntz"}
#: White space of any kind: what is trimmed from both ends of a cell.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
THOUSANDS = r"^-?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"


@dataclass(frozen=True)
class Field:
    """A declared column: its name, source header, type, and how its cells are read."""

    name: str
    source: str
    type: str = "string"
    true: tuple[str, ...] = ("true",)
    false: tuple[str, ...] = ("false",)
    formats: tuple[str, ...] = ()
    nulls: tuple[str, ...] = ()
    was: tuple[str, ...] = ()
    since: str | None = None


@dataclass(frozen=True)
class Entry:
    """A declared dataset."""

    key: tuple[str, ...]
    fields: tuple[Field, ...]
    suppression: tuple[str, ...] = ()
    omit: tuple[str, ...] = field(default=())


class SchemaError(ValueError):
    """The source does not fit its declaration."""


def blank_to_null(c: Column) -> Column:
    """Trimmed of all white space; empty cells are NULL."""
    return F.nullif(F.trim(c.cast("string"), F.lit(BLANKS)), F.lit(""))


def null_markers(c: Column, tokens: tuple[str, ...]) -> Column:
    return F.when(~c.isin(*tokens), c) if tokens else c


def plain_number(c: Column) -> Column:
    """19,918 as 19918, only where the whole cell is such a figure."""
    return F.when(c.rlike(THOUSANDS), F.replace(c, F.lit(","), F.lit(""))).otherwise(c)


def multi_format(c: Column, formats: tuple[str, ...], kind: str) -> Column:
    """The first format that parses; epoch_ms is milliseconds since 1970."""
    made = []
    for f in formats:
        made.append(F.timestamp_millis(c.try_cast("bigint")).cast("timestamp_ntz") if f == "epoch_ms" else F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz"))
    return F.coalesce(*made).cast(TYPES[kind])


def boolean(c: Column, true: tuple[str, ...], false: tuple[str, ...]) -> Column:
    return F.when(c.isin(*true), True).when(c.isin(*false), False)


def convert(f: Field, c: Column) -> Column:
    """The cell as the field's type; NULL where it does not fit."""
    if f.type in ("integer", "number"):
        return plain_number(c).try_cast(TYPES[f.type])
    if f.type == "boolean":
        return boolean(c, f.true, f.false)
    if f.type in ("date", "datetime"):
        return multi_format(c, f.formats or ("yyyy-MM-dd",), f.type)
    return c


def source_of(entry_field: Field, columns: list[str]) -> str | None:
    """The header a field is read under: its present one, else an earlier one."""
    trimmed = {c.strip(): c for c in columns}
    return next((trimmed[s] for s in (entry_field.source, *entry_field.was) if s in trimmed), None)


def allowlist(raw: DataFrame, entry: Entry, version: str | None = None) -> tuple[DataFrame, list[str]]:
    """(declared columns under their names, columns held out). A declared column that is absent is an error unless it came later."""
    chosen, used, absent = [], set(), []
    for f in entry.fields:
        source = source_of(f, raw.columns)
        if source:
            chosen.append(F.col(f"`{source}`").alias(f.name))
            used.add(source)
        elif f.since and version and version < f.since:
            chosen.append(F.lit(None).cast("string").alias(f.name))
        else:
            absent.append(f.source)
    if absent:
        raise SchemaError(f"declared columns absent: {', '.join(absent)}")
    keep = [c for c in raw.columns if c.startswith("_") and c not in used]
    return raw.select(*[F.col(c) for c in keep], *chosen), [c for c in raw.columns if c not in used and c not in keep and c.strip() not in entry.omit]


def suppressed(entry: Entry, cells: dict[str, Column]) -> Column:
    """The names of numeric fields whose cell is a suppression token."""
    marks = [F.when(cells[f.name].isin(*entry.suppression), F.lit(f.name)) for f in entry.fields if f.type in ("integer", "number") and entry.suppression]
    return F.filter(F.array(*marks), lambda x: x.isNotNull()) if marks else F.array().cast("array<string>")


def markers(cells: dict[str, Column], tokens: tuple[str, ...]) -> Column:
    """{field: token} as JSON of the cells a token empties, NULL if none."""
    pairs = [x for n, c in cells.items() for x in (F.lit(n), F.when(c.isin(*tokens), c))]
    kept = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    return F.when(F.size(kept) > 0, F.to_json(kept))


def normalise(raw: DataFrame, entry: Entry, version: str | None = None) -> DataFrame:
    """Typed rows with suppressed; cells that do not fit become NULL here and are listed by `misfits`."""
    rows, _ = allowlist(raw, entry, version)
    # Each cell is read once, into a struct that the value and its marks are taken from.
    read = F.struct(*[null_markers(blank_to_null(F.col(f.name)), f.nulls).alias(f.name) for f in entry.fields])
    rows = rows.select(*[c for c in rows.columns if c.startswith("_")], read.alias("_cells"))
    cells = {f.name: F.col("_cells")[f.name] for f in entry.fields}
    numeric = {f.name for f in entry.fields if f.type in ("integer", "number")}
    value = lambda f: convert(f, null_markers(cells[f.name], entry.suppression if f.name in numeric else ()))
    return rows.select(*[c for c in rows.columns if c.startswith("_") and c != "_cells"], *[value(f).alias(f.name) for f in entry.fields], suppressed(entry, cells).alias("suppressed"))


def misfits(raw: DataFrame, entry: Entry, examples: int = 5) -> DataFrame:
    """field, n, examples of cells that are neither blank, marker nor suppression token and do not fit the type."""
    rows, _ = allowlist(raw, entry)
    found = []
    for f in entry.fields:
        c = null_markers(null_markers(blank_to_null(F.col(f.name)), f.nulls), entry.suppression if f.type in ("integer", "number") else ())
        found.append(F.struct(F.lit(f.name).alias("field"), F.when(c.isNotNull() & convert(f, c).isNull(), c).alias("cell")))
    bad = rows.select(F.explode(F.array(*found)).alias("x")).select("x.*").where("cell is not null")
    counted = bad.groupBy("field", "cell").agg(F.count("*").alias("k"))
    ranked = counted.withColumn("r", F.row_number().over(W.partitionBy("field").orderBy("cell")))
    return ranked.groupBy("field").agg(F.sum("k").alias("n"), F.concat_ws(" | ", F.array_sort(F.collect_list(F.when(F.col("r") <= examples, F.col("cell"))))).alias("examples"))


def strict(raw: DataFrame, entry: Entry) -> DataFrame:
    """normalise, refused when any cell does not fit."""
    bad = misfits(raw, entry).limit(20).collect()
    if bad:
        raise SchemaError("; ".join(f"{r.field}: {r.n} cells such as {r.examples}" for r in bad))
    return normalise(raw, entry)


#: What a cell must look like to be a whole number or a double; what only looks so fails in the cast.
INTEGRAL = r"^[\x00-\x20\x7F]*[+-]?[0-9]+[\x00-\x20\x7F]*$"
NUMERAL = r"^[\x00-\x20]*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[dDfF]?|0[xX].*|(?i:nan|inf|infinity))[\x00-\x20]*$"


def date_shape(form: str) -> str:
    """A pattern that every text in a date format has: digits for its numbers, its signs as they are. Formats with optional or quoted parts have none ("")."""
    if re.search(r"[\[\]'{}#]", form):
        return ""
    part = lambda m: r"[+-]?[0-9]+" if m[0][0] in "yudDHhkKmsS" or m[0] in ("M", "MM", "L", "LL") else ".*" if m[0].isalpha() else re.escape(m[0])
    return "(?s)^" + re.sub(r"([a-zA-Z])\1*|[^a-zA-Z]", part, form) + "$"


def infer(sample: DataFrame, columns: list[str], suppression: tuple[str, ...] = ("<5", "np", "n.p."), date_formats: tuple[str, ...] = ("yyyy-MM-dd", "d/M/yyyy")) -> DataFrame:
    """column, type drafted from a sample of text: codes with leading zeros stay text, then integer, number, boolean, date, string.

    Each cell says once, in bits, what it can be, and a column can be what all its cells can. A cast or parse that fails costs far more than one that does
    not, so only cells of the right shape are put to it.
    """
    may = lambda shape, c, x: F.when(c.rlike(shape), x).otherwise(False) if shape else x
    cells = sample.select(*[blank_to_null(F.col(f"`{name}`")).alias(f"c{i}") for i, name in enumerate(columns)])
    cells = cells.select(*[null_markers(F.col(c), suppression).alias(c) for c in cells.columns])
    cells = cells.select("*", *[plain_number(F.col(f"c{i}")).alias(f"n{i}") for i in range(len(columns))])

    def bits(i: int) -> Column:
        c, n = F.col(f"c{i}"), F.col(f"n{i}")
        can = [~c.rlike("^0[0-9]+$"), may(INTEGRAL, n, n.try_cast("bigint").isNotNull()), may(NUMERAL, n, n.try_cast("double").isNotNull()), F.lower(c).isin("y", "n", "yes", "no", "true", "false")]
        can += [may(date_shape(f), c, F.try_to_timestamp(c, F.lit(f)).isNotNull()) for f in date_formats]
        return F.when(c.isNotNull(), reduce(lambda a, b: a + b, [F.when(x, F.lit(1 << k)).otherwise(0) for k, x in enumerate(can)]))

    told = cells.select(*[bits(i).alias(f"b{i}") for i in range(len(columns))]).agg(*[F.bit_and(f"b{i}").alias(f"b{i}") for i in range(len(columns))])
    all_ = lambda i, mask: F.coalesce(F.col(f"b{i}").bitwiseAND(mask) != 0, F.lit(False))
    kind = lambda i: F.when(F.col(f"b{i}").isNotNull() & ~all_(i, 1), "string").when(all_(i, 2), "integer").when(all_(i, 4), "number").when(all_(i, 8), "boolean").when(all_(i, (1 << len(date_formats)) - 1 << 4), "date").otherwise("string")
    drafts = F.array(*[F.struct(F.lit(name).alias("column"), kind(i).alias("type")) for i, name in enumerate(columns)])
    return told.select(F.explode(drafts).alias("x")).select("x.*")


def int_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, low, high, fits: whether every value is in 32 bits."""
    made = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.min(c).cast("bigint").alias("low"), F.max(c).cast("bigint").alias("high")) for c in columns]).alias("x"))
    return made.select(F.explode("x").alias("x")).select("x.*").withColumn("fits", F.coalesce((F.col("low") >= -(2**31)) & (F.col("high") < 2**31), F.lit(True)))


def narrow(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("int") for c in columns})


def widen(df: DataFrame) -> DataFrame:
    """Every integer as 64 bits, every timestamp to the second."""
    made = {}
    for name, kind in df.dtypes:
        if kind in ("tinyint", "smallint", "int"):
            made[name] = F.col(name).cast("bigint")
        elif kind.startswith("timestamp"):
            made[name] = F.date_trunc("second", name).cast(kind)
    return df.withColumns(made) if made else df


def iso_view(df: DataFrame) -> DataFrame:
    made = {}
    for name, kind in df.dtypes:
        if kind == "date":
            made[name] = F.date_format(name, "yyyy-MM-dd")
        elif kind.startswith("timestamp"):
            made[name] = F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss")
    return df.withColumns(made) if made else df


def records_view(df: DataFrame) -> DataFrame:
    """What every query sees: ISO dates, booleans 1 and 0, NaN as NULL, lists joined by ;, binary columns dropped."""
    out = iso_view(df.drop(*[n for n, k in df.dtypes if k == "binary"]))
    made = {}
    for name, kind in out.dtypes:
        if kind == "boolean":
            made[name] = F.col(name).cast("int")
        elif kind in ("double", "float"):
            made[name] = F.when(~F.isnan(name), F.col(name))
        elif kind.startswith("array"):
            made[name] = F.array_join(name, ";")
    return out.withColumns(made) if made else out


def slug(c: Column) -> Column:
    """A partition value as a file name: NULL _null, empty _blank."""
    made = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(c.isNull(), "_null").when(F.trim(c) == "", "_blank").otherwise(made)


def slug_clashes(df: DataFrame, column: str) -> DataFrame:
    """Slugs that more than one value has."""
    return df.groupBy(slug(F.col(column)).alias("slug")).agg(F.count_distinct(column).alias("values")).where("values > 1")


def as_at(c: Column) -> Column:
    """A publisher's wording of a date: 30 June 2025, June 30, 2025, 30/6/2025, 2025-06-30; a month alone is its last day."""
    t = F.regexp_replace(F.trim(c), r",", "")
    day = [F.try_to_timestamp(t, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "d MMMM yyyy", "MMMM d yyyy", "d/M/yyyy")]
    return F.coalesce(*day, F.last_day(F.try_to_timestamp(t, F.lit("MMMM yyyy")).cast("date")))


def fiscal_start(c: Column) -> Column:
    """The first year of a financial year's wording: 2011-12, 2008/09, FY2010 (ends then), FY12-13; else NULL."""
    pair = F.regexp_extract(c, r"^(?:FY)?\s*([0-9]{4})[-/](?:[0-9]{4}|[0-9]{2})$", 1)
    short = F.regexp_extract(c, r"^FY\s*([0-9]{2})[-/][0-9]{2}$", 1)
    ends = F.regexp_extract(c, r"^FY\s*([0-9]{4})$", 1)
    return F.when(pair != "", pair.try_cast("int")).when(short != "", 2000 + short.try_cast("int")).when(ends != "", ends.try_cast("int") - 1)


def zero_pad(df: DataFrame, column: str, reference: DataFrame, code: str) -> DataFrame:
    """Numeric codes as text with the zeros they lost, when all reference codes have one width."""
    width = reference.agg(F.min(F.length(code)).alias("_low"), F.max(F.length(code)).alias("_high"))
    text = F.col(column).cast("string")
    padded = F.when((F.col("_low") == F.col("_high")) & text.rlike("^[0-9]+$"), F.lpad(text, F.col("_high"), F.lit("0"))).otherwise(text)
    return df.crossJoin(F.broadcast(width)).withColumn(column, padded).drop("_low", "_high")  # one row


# Names of months and weekdays.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def natural_rank(c: Column) -> Column:
    """Place of a month, weekday or numeric band among its kind, else NULL."""
    low = F.lower(F.trim(c))
    place = lambda names: F.array_position(F.array(*[F.lit(n[:3]) for n in names]), F.substring(low, 1, 3))
    whole = lambda names: low.isin(*names, *[n[:3] for n in names])
    band = F.regexp_extract(low, r"^[^0-9]*([0-9]+)", 1).try_cast("bigint")
    return F.when(whole(MONTHS), place(MONTHS)).when(whole(WEEKDAYS), place(WEEKDAYS)).otherwise(band)


def preview(c: Column, most: int = 120) -> Column:
    """Tags stripped, white space as one space; a text over `most` characters is cut and ends in an ellipsis."""
    bare = F.when(F.contains(c, F.lit("<")) & F.contains(c, F.lit(">")), F.regexp_replace(c, "<[^>]+>", " ")).otherwise(c)
    line = F.trim(F.regexp_replace(bare, r"[\s\p{Z}]+", " "))
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, most - 1)), F.lit("…")))


def preview_number(c: Column) -> Column:
    """A number in at most 12 significant digits, without zeros at its end; in powers of ten from 1e12 on and under 1e-4."""
    exact = F.format_string("%.11e", c.cast("double"))
    plain = F.regexp_replace(F.regexp_replace(exact.try_cast("decimal(38,17)").cast("string"), "0+$", ""), r"\.$", "")
    near = (F.abs(c) < 1e12) & (F.abs(c) >= 1e-4)
    return F.when(c.isNull(), None).when(c == 0, F.lit("0")).when(near, plain).otherwise(F.regexp_replace(exact, r"\.?0*e", "e"))


#: Names of columns that hold years.
YEAR = r"(^|_)year($|_)"


def display(df: DataFrame, labels: dict[str, str], fits: tuple[str, ...] = ()) -> DataFrame:
    """Columns as a viewer shows them: years as text, booleans as Yes and No, 64-bit integers of `fits` (see `int_ranges`) as 32 bits, under their labels."""
    made = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "boolean":
            c = F.when(c, "Yes").when(~c, "No")
        elif kind in ("int", "bigint", "smallint") and re.search(YEAR, name):
            c = c.cast("string")
        elif kind == "bigint" and name in fits:
            c = c.cast("int")
        made.append(c.alias(labels.get(name, name)))
    return df.select(*made)


def drop_blank_rows(df: DataFrame) -> DataFrame:
    """Rows with some cell that is not blank."""
    cells = [c for c in df.columns if not c.startswith("_")]
    return df.where(reduce(lambda a, b: a | b, [blank_to_null(F.col(c)).isNotNull() for c in cells]))


def dated_unpivot(df: DataFrame, ids: list[str]) -> DataFrame:
    """Columns headed YYYY-MM-DD as rows: ids, date, cell."""
    dated = [c for c in df.columns if re.fullmatch(r"\d{4}-\d{2}-\d{2}", c)]
    return df.unpivot(ids, [F.col(f"`{c}`") for c in dated], "date", "cell").withColumn("date", F.to_date("date"))


def stacked(tables: list[DataFrame]) -> DataFrame:
    """Tables of one column set, in any order, as one; a row that several hold is kept once."""
    names = set(tables[0].columns)
    for t in tables:
        if set(t.columns) != names:
            raise SchemaError(f"columns differ: {sorted(names ^ set(t.columns))}")
    return reduce(lambda a, b: a.unionByName(b), tables).distinct()


def stacked_files(tables: dict[str, DataFrame], pattern: str = "", label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(files of one column set as one table without repeats, one row of what was read): the second has read and repeated.

    With `label`, a column of that name tells each row's file: what `pattern`'s group (or else the whole pattern) finds in the file's name; a name without a match is refused.
    Rows that differ in their label alone are different rows.
    """
    made = []
    for name, t in tables.items():
        if label is not None:
            found = re.search(pattern, name)
            if pattern and not found:
                raise SchemaError(f"{name!r} does not match the pattern of file names")
            t = t.withColumn(label, F.lit((found[1] if found.groups() else found[0]) if pattern else name))
        made.append(t)
    names = set(made[0].columns)
    for t in made:
        if set(t.columns) != names:
            raise SchemaError(f"columns differ: {sorted(names ^ set(t.columns))}")
    every = reduce(lambda a, b: a.unionByName(b), made).groupBy(*made[0].columns).agg(F.count("*").alias("_n"))
    return every.drop("_n"), every.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("read"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeated"))


def footnote(c: Column) -> tuple[Column, Column]:
    """(cell without a footnote number at its end, the number or NULL)."""
    pattern = r"^(.*\S)\s+(\d{1,2})$"
    found = c.rlike(pattern)
    return F.when(found, F.regexp_extract(c, pattern, 1)).otherwise(c), F.when(found, F.regexp_extract(c, pattern, 2))


def forward_fill(df: DataFrame, column: str, by: list[str], order: str) -> DataFrame:
    """Blank cells take the last filled one before them."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(column, F.last(F.nullif(F.col(column), F.lit("")), True).over(w))
