"""Landed files to tables: delimited text, GeoJSON, XML, nested JSON, station series; listings of files and versions."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType
from pyspark.sql.window import Window as W


def records(spark: SparkSession, path: str, header_row: int = 1) -> DataFrame:
    """file, line, record: the records of delimited text files after `header_row` - 1 lines of preamble, with the line of their file that each starts on (from 1).

    A line starts a record where an even number of quotes stands before it in its file. Files are read in blocks, as many at once as there are: lines and quotes are counted
    by block, each block starts from the counts of those before it in its file, and only the lines of records that run over several meet, by record. So a file of any
    size is split, wherever its new lines are quoted. Line ends inside a record are new lines.
    """
    lines = spark.read.option("recursiveFileLookup", not any(c in path for c in "*?[{")).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    at = ["file", "block"]
    upto = W.partitionBy(*at).orderBy("id").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row a block
    counted = lines.groupBy(*at).agg(F.count("*").alias("n")).select(*at, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines"))
    numbered = lines.withColumn("row", F.row_number().over(upto)).join(counted, at).withColumn("line", F.col("row") + F.col("lines")).drop("row", "lines")
    numbered = numbered.where(F.col("line") >= header_row).withColumn("value", F.when(F.col("line") == 1, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")))
    numbered = numbered.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    quotes = numbered.groupBy(*at).agg(F.sum("quotes").alias("n")).select(*at, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("past"))
    marked = numbered.join(quotes, at).withColumn("open", (F.col("past") + F.sum("quotes").over(upto) - F.col("quotes")) % 2 == 1)
    marked = marked.withColumn("start", F.when(~F.col("open"), F.col("line")))
    starts = marked.groupBy(*at).agg(F.max("start").alias("n")).select(*at, F.last("n", True).over(before).alias("from"))
    placed = marked.join(starts, at).withColumn("record_line", F.coalesce(F.last("start", True).over(upto), "from"))
    alone = ~F.col("open") & (F.col("quotes") % 2 == 0)
    one = placed.where(alone).select("file", "line", F.col("value").alias("record"))
    parts = placed.where(~alone).groupBy("file", F.col("record_line").alias("line")).agg(F.array_sort(F.collect_list(F.struct(F.col("line").alias("at"), "value"))).alias("parts"))
    return one.unionByName(parts.select("file", "line", F.array_join("parts.value", "\n").alias("record"))).where("record <> ''")


def delimited(spark: SparkSession, path: str, separator: str = ",", header_row: int = 1) -> DataFrame:
    """All-text columns of delimited files. `tab` is a tab; with a preamble the header is line `header_row`; rows that are
    short are padded with NULL, as empty cells are; new lines inside quotes are kept. No type or null is inferred.

    Every file is read by its own header, names as written; files of several headers become one table by name.
    """
    sep = "\t" if separator == "tab" else separator
    rows = records(spark, path, header_row)
    names = rows.where(F.col("line") == header_row).select("file", F.col("record").alias("header"))
    told = [r.header for r in names.select("header").distinct().orderBy("header").collect()]  # one row for each kind of file
    body = rows.where(F.col("line") > header_row).join(names, "file")
    options = {"sep": sep, "escape": '"', "mode": "PERMISSIVE", "nullValue": "\u0000", "emptyValue": ""}
    out = None
    for header in told:
        schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in next(csv.reader([header], delimiter=sep)))
        made = body.where(F.col("header") == header).select(F.from_csv("record", schema, options).alias("r")).select("r.*")
        out = made if out is None else out.unionByName(made, allowMissingColumns=True)
    return out if out is not None else spark.read.csv(path, sep=sep, header=True)


def short_rows(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """rows, short: how many rows a delimited file has, and how many have fewer cells than its header; separators in quotes count for none."""
    sep = "\t" if separator == "tab" else separator
    read = spark.read.option("sep", sep).option("escape", '"').option("multiLine", True).option("header", True)
    width = len(read.csv(path).columns)
    # A short row is one that a schema of its own cells cannot fill: the reader marks it as corrupt.
    schema = ", ".join(f"c{k} string" for k in range(width)) + ", _bad string"
    rows = read.schema(schema).option("enforceSchema", True).option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE").csv(path)
    missing = F.col("_bad").isNotNull() & F.col(f"c{width - 1}").isNull()
    return rows.agg(F.count("*").alias("rows"), F.count_if(missing).alias("short"))


#: Bytes 80 to 9F that Windows-1252 defines, and what they stand for: from the codec itself.
WINDOWS = {b: c for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))}


def decoded(content: Column, preferred: str | None = None) -> Column:
    """Bytes as text: the preferred charset, UTF-8 without its mark, Windows-1252, else (where it leaves a byte undefined) Latin-1."""
    utf8 = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8"))
    first = [F.decode(content, preferred)] if preferred and preferred.upper() != "UTF-8" else []
    latin = F.decode(content, "ISO-8859-1")
    windows = F.when(~latin.rlike("[" + "".join(rf"\x{b:02x}" for b in range(0x80, 0xA0) if b not in WINDOWS) + "]"), F.translate(latin, "".join(map(chr, WINDOWS)), "".join(WINDOWS.values())))
    return F.regexp_replace(F.coalesce(*first, utf8, windows, latin), "^﻿", "")


def geojson_points(spark: SparkSession, path: str) -> DataFrame:
    """One row a feature: its properties as text, then lon and lat; a MultiPoint has them only when it is one point."""
    geometry = "type string, coordinates string"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"struct<features:array<struct<properties:map<string,string>,geometry:struct<{geometry.replace(' string', ':string').replace(', ', ',')}>>>>")["features"]).alias("f"))
    pair = F.from_json("f.geometry.coordinates", "array<double>")
    many = F.from_json("f.geometry.coordinates", "array<array<double>>")
    kind = F.col("f.geometry.type")
    at = lambda i: F.when(kind == "Point", F.get(pair, F.lit(i))).when((kind == "MultiPoint") & (F.size(many) == 1), F.get(F.get(many, F.lit(0)), F.lit(i)))
    return rows.select(F.col("f.properties").alias("properties"), at(0).alias("lon"), at(1).alias("lat"))


def xml_records(spark: SparkSession, path: str, record: str) -> DataFrame:
    """One row for each named element: its attributes as @name, its children as columns, their attributes as child@name; repeated ones joined by ' | '.

    A record that holds another of its name is refused: it would be read twice, as a row and as a child.
    """
    rows = spark.read.format("xml").option("rowTag", record).option("inferSchema", False).option("attributePrefix", "@").load(path)
    if _holds(rows.schema, record):
        raise ValueError(f"a <{record}> element holds another <{record}>; name the outer one")

    def cells(f: StructField) -> Iterator[Column]:
        many = isinstance(f.dataType, ArrayType)
        kind, c = f.dataType.elementType if many else f.dataType, F.col(f"`{f.name}`")
        joined = lambda x: F.array_join(x, " | ") if many else x
        if not isinstance(kind, StructType):
            yield joined(c).alias(f.name)
            return
        for g in kind.fields:
            name = f.name if g.name == "_VALUE" else f.name + g.name if g.name.startswith("@") else f"{f.name}.{g.name}"
            yield joined(_part(c, g.name, many).cast("array<string>" if many else "string")).alias(name)

    return rows.select(*[x for f in rows.schema.fields for x in cells(f)])


def _holds(kind: DataType, name: str) -> bool:
    """Whether some element under a record has its name."""
    kind = kind.elementType if isinstance(kind, ArrayType) else kind
    return isinstance(kind, StructType) and any(f.name.split(":")[-1] == name or _holds(f.dataType, name) for f in kind.fields)


def _part(c: Column, name: str, many: bool) -> Column:
    return F.transform(c, lambda x: x[name]) if many else c[name]


def member_tables(spark: SparkSession, path: str, pattern: str, schema: str, form: str = "json") -> DataFrame:
    """The files of several tables under one folder as one table of a shared schema, with the table that `pattern`'s group finds in each file's path."""
    got = spark.read.schema(schema).option("recursiveFileLookup", True).format(form).load(path)
    return got.select(F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).alias("table"), "*")


def delimited_members(spark: SparkSession, path: str, pattern: str, separator: str = ",") -> dict[str, DataFrame]:
    """Delimited files under one folder grouped into tables by `pattern`'s group in their paths; files that it does not match are left out.

    All files of a table must share one header: another one is refused, as its cells would stand under wrong names.
    """
    sep = "\t" if separator == "tab" else separator
    lines = records(spark, path).withColumn("table", F.regexp_extract("file", pattern, 1)).where("table <> ''")
    heads = lines.where("line = 1").groupBy("table").agg(F.array_sort(F.collect_set("record")).alias("heads"))
    told = {r.table: r.heads for r in heads.orderBy("table").collect()}  # a row for each table, its different headers
    out = {}
    for name, different in told.items():
        if len(different) > 1:
            raise ValueError(f"the files of {name} have different headers: {different}")
        schema = ", ".join("`" + n.strip().replace("`", "``") + "` string" for n in next(csv.reader([different[0]], delimiter=sep)))
        options = {"sep": sep, "escape": '"', "mode": "PERMISSIVE", "nullValue": "\u0000", "emptyValue": ""}
        out[name] = lines.where((F.col("table") == name) & (F.col("line") > 1)).select(F.from_csv("record", schema, options).alias("r")).select("r.*")
    return out


def json_records(spark: SparkSession, path: str, record: str) -> DataFrame:
    """The list at a dotted path, one row an element; nested fields as dotted columns, lists joined by ' | '."""
    rows = spark.read.json(path, multiLine=True).select(F.explode(record).alias("r")).select("r.*")

    def leaves(fields, prefix=""):
        for f in fields:
            name = f"{prefix}{f.name}"
            if hasattr(f.dataType, "fields"):
                yield from leaves(f.dataType.fields, f"{name}.")
            elif f.dataType.typeName() == "array":
                yield F.array_join(F.col(name).cast("array<string>"), " | ").alias(name)
            else:
                yield F.col(name).cast("string").alias(name)

    return rows.select(*leaves(rows.schema.fields))


def versions_joined(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A version's parts as one table, widened to one schema, with their order as _part."""
    parts = [spark.read.parquet(p).withColumn("_part", F.lit(i)) for i, p in enumerate(paths)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def series(stations: DataFrame, values: DataFrame) -> DataFrame:
    """station, state, date, value, quality from stations (station, owner) and their arrays (station, data of date, value, quality)."""
    rows = values.select("station", F.explode("data").alias("d")).select("station", "d.*")
    named = stations.select("station", F.substring_index("owner", " - ", 1).alias("state"))
    return rows.join(named, "station", "left").select("station", "state", "date", "value", "quality")


def newest_file(listing: DataFrame, pattern: str) -> DataFrame:
    """The newest of the files (path, modificationTime) whose name matches."""
    return listing.where(F.col("path").rlike(pattern)).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def backfill(listing: DataFrame, stored: DataFrame, since: str) -> DataFrame:
    """Releases (dataset, version) from a day on that are not stored yet."""
    return listing.where(F.col("version") >= F.lit(since).cast("date")).join(stored, ["dataset", "version"], "left_anti")


def wide_grid(cells: DataFrame, header_rows: int, row_headers: int, header_row: int = 1, first_column: int = 1, fill_down: tuple[int, ...] = (), column_match: str | None = None, measures: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(a presentation grid's data, the headers that it does not read): the grid as cells (sheet, row, col, text), rows and columns from 1.

    The header begins at `header_row`, the row headers at `first_column`. Columns are told by the last header row: those with a filled cell there that `column_match` finds. Above it, a cell left
    blank beside a filled one is part of a merged cell and takes its value; the cells over a column, from the top, are its place in the header tree. Rows without a filled
    cell in these columns are notes and are left out. Row headers named in `fill_down` (from 1) hold until the next one below, in rows that have data.

    One row for each data row and column: sheet, row, name_1 and on, head_1 and on, cell (blank cells too). With `measures` (last header -> field) the last header row names
    fields: one row for each data row and group of columns under the same cells above, with a column for each field. The second table is sheet, head: last headers that are not read, in no order.
    A measure that a sheet lacks is refused, and so is a grid without columns to read.
    """
    text = F.nullif(F.trim("text"), F.lit(""))
    at = cells.select("sheet", (F.col("row") - header_row + 1).alias("row"), (F.col("col") - first_column + 1).alias("col"), text.alias("text")).where("row >= 1 and col >= 1")
    last = at.where((F.col("row") == header_rows) & (F.col("col") > row_headers) & F.col("text").isNotNull()).select("sheet", "col", F.col("text").alias("last"))
    read = F.col("last").isin(*measures) if measures else F.lit(True)
    read = read & F.col("last").rlike(column_match) if column_match else read
    cols, held = last.where(read), last.where(~read).select("sheet", F.col("last").alias("head")).distinct()
    there = {r.sheet: r.found for r in cols.groupBy("sheet").agg(F.collect_set("last").alias("found")).collect()}  # a row for each sheet, its different headers
    if not there:
        raise ValueError("the grid has no columns to read")
    for sheet, found in there.items():
        if absent := sorted(set(measures or {}) - set(found)):
            raise ValueError(f"sheet {sheet!r} has no columns headed {absent}")
    levels = header_rows - 1
    above = at.where((F.col("row") <= levels) & (F.col("col") > row_headers)).withColumn("asks", F.lit(False))
    asked = cols.select("sheet", F.explode(F.sequence(F.lit(1), F.lit(levels)) if levels else F.array().cast("array<int>")).alias("row"), "col", F.lit(None).cast("string").alias("text"), F.lit(True).alias("asks"))
    across = W.partitionBy("sheet", "row").orderBy("col").rangeBetween(W.unboundedPreceding, W.currentRow)
    over = above.unionByName(asked).withColumn("text", F.last("text", True).over(across)).where("asks")
    heads = over.groupBy("sheet", "col").agg(F.array_sort(F.collect_list(F.struct("row", F.coalesce("text", F.lit("")).alias("text")))).alias("over"))
    cols = cols.join(heads, ["sheet", "col"], "left").withColumn("over", F.coalesce(F.col("over.text"), F.array().cast("array<string>")))
    tree = F.col("over") if measures else F.array_append("over", F.col("last"))
    groups = cols.select("sheet", "col", "last", *[F.get(tree, F.lit(k)).alias(f"head_{k + 1}") for k in range(levels if measures else header_rows)])
    places = [c for c in groups.columns if c.startswith("head_")]

    body = at.where(F.col("row") > header_rows)
    filled = body.where(F.col("text").isNotNull()).join(groups, ["sheet", "col"])
    rows = filled.select("sheet", "row").distinct()
    ids = [F.max(F.when(F.col("col") == k, F.col("text"))).alias(f"name_{k}") for k in range(1, row_headers + 1)]
    if ids:
        rows = rows.join(body.where(F.col("col") <= row_headers).groupBy("sheet", "row").agg(*ids), ["sheet", "row"], "left")
    down = W.partitionBy("sheet").orderBy("row").rowsBetween(W.unboundedPreceding, W.currentRow)
    for k in fill_down:
        rows = rows.withColumn(f"name_{k}", F.last(f"name_{k}", True).over(down))
    names = [c for c in rows.columns if c.startswith("name_")]
    key = F.concat_ws("\u0001", *places) if measures and places else F.lit("") if measures else F.col("col")
    fields = [F.max(F.when(F.col("last") == h, F.col("text"))).alias(f) for h, f in measures.items()] if measures else [F.max("text").alias("cell")]
    values = filled.withColumn("_key", key).groupBy("sheet", "row", "_key").agg(*fields)
    branches = groups.withColumn("_key", key).groupBy("sheet", "_key").agg(F.min("col").alias("col"), *[F.first(c).alias(c) for c in places])
    out = rows.join(branches, "sheet").join(values, ["sheet", "row", "_key"], "left")
    made = [c for c in values.columns if c not in ("sheet", "row", "_key")]
    return out.select("sheet", (F.col("row") + header_row - 1).alias("row"), (F.col("col") + first_column - 1).alias("col"), *[F.coalesce(c, F.lit("")).alias(c) for c in (*names, *places, *made)]), held


def sections(lines: DataFrame, pattern: str, by: str = "doc", order: str = "_pos", text: str = "line") -> DataFrame:
    """Lines with the last title (a line that matches) above them as section; titles themselves are left out."""
    title = F.when(F.col(text).rlike(pattern), F.col(text))
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(title, True).over(w)).where(~F.coalesce(F.col(text).rlike(pattern), F.lit(False)))


def group_rows(rows: DataFrame, first: str, others: list[str], by: str, order: str) -> DataFrame:
    """A row with only its first cell filled names the group of the rows below it and is left out."""
    alone = reduce(lambda a, b: a & b, [F.nullif(F.trim(c), F.lit("")).isNull() for c in others])
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("_alone", alone).withColumn("group", F.last(F.when(F.col("_alone"), F.col(first)), True).over(w)).where("not _alone").drop("_alone")
