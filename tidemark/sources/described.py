"""Parquet that says what it is: a data source writer whose files carry provenance and GeoParquet's `geo` in their footers, with one manifest row a version.

    <table>/<dataset>/<version>/part-*.parquet
    <table>/_manifest/<dataset>/<version>.json      written last: a version without it is not there

Tasks write under <table>/_staging/<job>; the commit moves that folder into place and writes the manifest row. A task or job that fails leaves nothing in place.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "dataset string, version string, rows long, files long, bytes long, fields array<string>, provenance string"
#: Shapes by their WKB codes.
SHAPES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that a path names, and the path there: whatever Arrow can open, from every executor."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _numbers(shape: bytes) -> np.ndarray:
    """The coordinates of a little-endian WKB shape, as (x, y) rows."""
    out, at = [], 0

    def read(at: int) -> int:
        kind, at = struct.unpack_from("<I", shape, at + 1)[0], at + 5
        if kind == 1:
            out.append(np.frombuffer(shape, "<f8", 2, at).reshape(-1, 2))
            return at + 16
        n, at = struct.unpack_from("<I", shape, at)[0], at + 4
        for _ in range(n):
            if kind in (4, 5, 6, 7):
                at = read(at)
                continue
            m = 1 if kind == 2 else struct.unpack_from("<I", shape, at)[0]
            count = n if kind == 2 else m
            at += 0 if kind == 2 else 4
            out.append(np.frombuffer(shape, "<f8", 2 * count, at).reshape(-1, 2))
            at += 16 * count
            if kind == 2:
                break
        return at

    read(at)
    return np.concatenate(out) if out else np.zeros((0, 2))


@dataclass
class Written(WriterCommitMessage):
    rows: int
    bytes: int
    files: int


class Writer(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool) -> None:
        self.names = schema.fieldNames()
        self.table, self.dataset, self.version = (options[k] for k in ("path", "dataset", "version"))
        self.provenance, self.geometry, self.overwrite = options.get("provenance", "{}"), options.get("geometry"), overwrite
        self.staging = f"{self.table}/_staging/{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """One file a task, its footer written last, when the shapes' kinds and box are known."""
        files, folder = _at(self.staging)
        files.create_dir(folder, recursive=True)
        task = TaskContext.get()
        path = f"{folder}/part-{task.partitionId():05}-{task.taskAttemptId()}.parquet"
        writer, rows, kinds, low, high = None, 0, set(), np.full(2, np.inf), np.full(2, -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            writer = writer or pq.ParquetWriter(path, batch.schema, filesystem=files, compression="zstd")
            writer.write_batch(batch)
            rows += batch.num_rows
            if self.geometry:
                shapes = batch.column(batch.schema.get_field_index(self.geometry))
                kinds |= {SHAPES[struct.unpack_from("<I", s, 1)[0]] for s in pc.unique(pc.binary_slice(shapes.drop_null(), 0, 5)).to_pylist()}
                for shape in shapes.drop_null().to_pylist():
                    at = _numbers(shape)
                    if len(at):
                        low, high = np.minimum(low, at.min(0)), np.maximum(high, at.max(0))
        if writer is None:
            return Written(0, 0, 0)
        said = {"provenance": self.provenance}
        if self.geometry:
            box = {"bbox": [*low.tolist(), *high.tolist()]} if np.isfinite(low).all() else {}
            said["geo"] = json.dumps({"version": "1.1.0", "primary_column": self.geometry, "columns": {self.geometry: {"encoding": "WKB", "geometry_types": sorted(kinds), **box}}})
        writer.add_key_value_metadata(said)
        writer.close()
        return Written(rows, files.get_file_info(path).size, 1)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m]
        files, table = _at(self.table)
        place, row = f"{table}/{self.dataset}/{self.version}", f"{table}/_manifest/{self.dataset}/{self.version}.json"
        if files.get_file_info(row).type != fs.FileType.NotFound:
            if not self.overwrite:
                self.abort(messages)
                raise ValueError(f"{self.dataset} {self.version} is there, and versions do not change")
            files.delete_file(row)
        if files.get_file_info(place).type != fs.FileType.NotFound:  # of a job that ended before its manifest row
            files.delete_dir(place)
        files.create_dir(f"{table}/{self.dataset}", recursive=True)
        files.create_dir(f"{table}/_manifest/{self.dataset}", recursive=True)
        staged = _at(self.staging)[1]
        if files.get_file_info(staged).type != fs.FileType.NotFound:
            files.move(staged, place)
        said = {"dataset": self.dataset, "version": self.version, "rows": sum(m.rows for m in done), "files": sum(m.files for m in done), "bytes": sum(m.bytes for m in done), "fields": self.names, "provenance": self.provenance}
        with files.open_output_stream(f"{row}.new") as out:
            out.write(json.dumps(said).encode())
        files.move(f"{row}.new", row)

    def abort(self, messages: list[Written | None]) -> None:
        files, folder = _at(self.staging)
        if files.get_file_info(folder).type != fs.FileType.NotFound:
            files.delete_dir(folder)


class DescribedParquet(DataSource):
    @classmethod
    def name(cls) -> str:
        return "described_parquet"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(schema, dict(self.options), overwrite)


def write_described(df: DataFrame, table: str, dataset: str, version: str, provenance: dict, geometry: str | None = None, replace: bool = False) -> None:
    """Write one version: its rows, what the footers say of it, and its manifest row, all in one commit. A version that is there is not written again unless `replace`."""
    df.sparkSession.dataSource.register(DescribedParquet)
    out = df.write.format("described_parquet").mode("overwrite" if replace else "append").option("dataset", dataset).option("version", version).option("provenance", json.dumps(provenance, sort_keys=True))
    (out.option("geometry", geometry) if geometry else out).save(table)


def manifest(spark: SparkSession, table: str) -> DataFrame:
    """A row for each version that is there."""
    return spark.read.schema(MANIFEST).json(f"{table}/_manifest/*")


def described(spark: SparkSession, table: str) -> DataFrame:
    """The rows of all versions that the manifest names, with dataset and version, to be joined to it."""
    at = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/([^/]+)/[^/]+$", 1), F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/([^/]+)/[^/]+$", 2)
    rows = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(table).select(at[0].alias("dataset"), at[1].alias("version"), "*")
    return rows.join(manifest(spark, table).select("dataset", "version"), ["dataset", "version"], "left_semi")
