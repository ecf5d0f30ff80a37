"""Tables to files: CSV, JSON lines, Parquet in a declared order, GeoJSON rows, folders by value or period."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.versions import period
from tidemark.sources.described import write_described


def flat(df: DataFrame) -> DataFrame:
    """Lists joined by ; for text formats."""
    made = {n: F.array_join(n, ";") for n, k in df.dtypes if k.startswith("array")}
    return df.withColumns(made) if made else df


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    flat(df).write.csv(path, header=True, compression="gzip" if gzip else "none", escape='"', dateFormat="yyyy-MM-dd", mode="overwrite")


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.json(path, ignoreNullFields=False, mode="overwrite")


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.option("compression", "zstd").mode("overwrite").parquet(path)


def write_profile(df: DataFrame, path: str, sort: list[str], lookup: list[str] = (), files: int | None = None, rows_a_page: int = 20_000) -> None:
    """Parquet laid out for the queries: ranges of the sort over files, sorted inside, bloom filters on lookup fields."""
    ranged = df.repartitionByRange(files, *sort) if files else df.repartitionByRange(*sort)
    out = ranged.sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in sort]).write.option("compression", "zstd").option("parquet.page.row.count.limit", rows_a_page)
    for c in lookup:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    out.mode("overwrite").parquet(path)


def wkb_point(lon: Column, lat: Column) -> Column:
    """A point as little-endian WKB; NULL without coordinates."""

    @F.pandas_udf("binary")
    def pack(x: pd.Series, y: pd.Series) -> pd.Series:
        made = np.empty(len(x), [("order", "u1"), ("kind", "<u4"), ("x", "<f8"), ("y", "<f8")])
        made["order"], made["kind"], made["x"], made["y"] = 1, 1, x, y
        raw, width = made.tobytes(), made.itemsize
        return pd.Series([raw[k : k + width] for k in range(0, len(raw), width)])

    return F.when(lon.isNotNull() & lat.isNotNull(), pack(F.coalesce(lon, F.lit(0.0)), F.coalesce(lat, F.lit(0.0))))


def write_geo_parquet(df: DataFrame, table: str, dataset: str, version: str, lon: str, lat: str, provenance: dict | None = None) -> None:
    """A version with a geometry column of WKB points in place of lon and lat, and GeoParquet's `geo` in the footers."""
    rows = df.withColumn("geometry", wkb_point(F.col(lon), F.col(lat))).drop(lon, lat)
    write_described(rows, table, dataset, version, provenance or {}, "geometry")


def geojson_rows(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """value: one GeoJSON feature a row, geometry null without coordinates."""
    point = F.when(F.col(lon).isNotNull() & F.col(lat).isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))
    rest = F.struct(*[c for c in df.columns if c not in (lon, lat)])
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), rest.alias("properties")), {"ignoreNullFields": "false"}).alias("value"))


def write_geojson(df: DataFrame, path: str, lon: str, lat: str) -> None:
    geojson_rows(df, lon, lat).write.mode("overwrite").text(path)


def write_by_value(df: DataFrame, path: str, field: str) -> None:
    df.write.partitionBy(field).mode("overwrite").json(path)


def write_parts(df: DataFrame, path: str, day: str, grain: str, only: list[str] | None = None) -> None:
    """One folder a period; with `only`, those periods alone are replaced and the rest is left as it stands."""
    rows = df.withColumn("period", period(F.col(day), grain))
    rows = rows.where(F.col("period").isin(only)) if only is not None else rows
    rows.write.partitionBy("period").mode("overwrite").option("partitionOverwriteMode", "dynamic" if only is not None else "static").parquet(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        write_parquet(df, f"{path}/{name}")


def with_provenance(df: DataFrame, source: dict[str, str]) -> DataFrame:
    """The same rows, where they come from kept in every column's metadata."""
    return df.select(*[F.col(c).alias(c, metadata={**df.schema[c].metadata, **source}) for c in df.columns])


def csv_cell(c: Column) -> Column:
    """A cell as text, in quotes where it holds a comma, a quote or a line end; NULL is empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def answer_text(df: DataFrame, form: str, provenance: dict | None = None) -> DataFrame:
    """line, value: a query's answer as csv (a header line first), ndjson, or json with the version's provenance beside the rows.

    Lines are numbered in the answer's order. json is one line, as an answer is a page of rows: it is for pages, not for whole tables.
    """
    if form not in ("csv", "ndjson", "json"):
        raise ValueError("format is json, ndjson or csv")
    rows = flat(df) if form == "csv" else df
    numbered = rows.select(F.monotonically_increasing_id().alias("line"), F.struct(*rows.columns).alias("r"))
    kept = {"ignoreNullFields": "false"}
    if form == "ndjson":
        return numbered.select("line", F.to_json("r", kept).alias("value"))
    if form == "csv":
        head = df.sparkSession.range(1).select(F.lit(-1).cast("long").alias("line"), F.concat_ws(",", *[csv_cell(F.lit(c)) for c in df.columns]).alias("value"))
        return head.unionByName(numbered.select("line", F.concat_ws(",", *[csv_cell(F.col("r")[c]) for c in df.columns]).alias("value")))
    whole = numbered.agg(F.array_sort(F.collect_list(F.struct("line", "r"))).alias("x"))
    answer = F.to_json(F.struct(F.from_json(F.lit(json.dumps(provenance or {})), "map<string,string>").alias("provenance"), F.col("x.r").alias("rows")), kept)
    return whole.select(F.lit(0).cast("long").alias("line"), answer.alias("value"))
