"""A store of cubes: for each version of a table its cubes, each in a partition of its own, and a catalogue of what they hold and how large they are.

    <store>/cubes/<version>/<content hash>/cube=<fields>/   rows of one cube
    <store>/catalogue/<version>/<content hash>/             one row a cube: fields, groups, metrics, the types of the base table

A version is rebuilt when its content hash changes. The catalogue entry is written after the cubes, and an answer reads only what the newest entry names, so a build
that was cut off leaves nothing that is read.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.checks import stale_aggregates
from tidemark.operators.query import aggregate_query
from tidemark.operators.rollup import cube_for, cubes, exact, from_cube
from tidemark.operators.versions import digest

ENTRY = "version string, content string, built timestamp, fields array<string>, groups long, metrics array<string>, schema string"


@dataclass(frozen=True)
class Held:
    """What the catalogue says of one version: its content hash, sets of fields with their groups, metrics, and the base table's schema."""

    version: str
    content: str
    sizes: dict[tuple[str, ...], int]
    metrics: tuple[str, ...]
    schema: T.StructType


def content_hash(df: DataFrame) -> str:
    """A digest of a table's rows in any order (one row comes back to the driver)."""
    r = digest(df).first()
    return f"{r.rows}-{r.digest_xor}-{r.digest_sum}"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def entries(spark: SparkSession, store: str) -> DataFrame:
    """The catalogue: a row for each cube of the newest build of each version."""
    at, files = _files(spark, f"{store}/catalogue")
    if not files.exists(at):
        return spark.createDataFrame([], ENTRY)
    rows = spark.read.schema(ENTRY).json(f"{store}/catalogue/*/*")
    newest = rows.groupBy("version").agg(F.max_by("content", F.struct("built", "content")).alias("content"))
    return rows.join(newest, ["version", "content"]).select(rows.columns)


def build(spark: SparkSession, store: str, version: str, df: DataFrame, sets: list[tuple[str, ...]], metrics: list[str], content: str | None = None) -> None:
    """Write the cubes of one version, then its catalogue entry."""
    content = content or content_hash(df)
    path = _cubes(store, version, content)
    cubes(df, sets, metrics).repartition("cube").write.mode("overwrite").partitionBy("cube").parquet(path)
    sizes = {r.cube: r["count"] for r in spark.read.parquet(path).groupBy("cube").count().collect()}
    rows = [(version, content, list(s), sizes.get(",".join(s), 0), list(metrics), df.schema.json()) for s in sets]
    made = spark.createDataFrame(rows, "version string, content string, fields array<string>, groups long, metrics array<string>, schema string")
    made.withColumn("built", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(f"{store}/catalogue/{version}/{content}")


def refresh(spark: SparkSession, store: str, versions: dict[str, DataFrame], sets: list[tuple[str, ...]], metrics: list[str]) -> dict[str, str]:
    """Bring the store up to what is published: versions of other content are built again, versions that are no more are deleted. What was done, by version."""
    content = {v: content_hash(df) for v, df in versions.items()}
    published = spark.createDataFrame(list(content.items()), "version string, hash string")
    held = entries(spark, store).select("version", F.col("content").alias("hash")).distinct()
    done = {r.version: r.action for r in stale_aggregates(published, held).collect()}  # a row for each stale version
    for version, action in done.items():
        if action == "rebuild":
            build(spark, store, version, versions[version], sets, metrics, content[version])
    # What no entry names any more goes once all that replaces it is there.
    keep = {(v, content[v]) for v in versions}
    at, files = _files(spark, f"{store}/catalogue")
    for entry in [x for v in (files.listStatus(at) if files.exists(at) else []) for x in files.listStatus(v.getPath())]:
        version, mark = entry.getPath().getParent().getName(), entry.getPath().getName()
        if (version, mark) not in keep:
            files.delete(entry.getPath(), True)
            old, _ = _files(spark, _cubes(store, version, mark))
            files.delete(old, True)
    return done


def held(spark: SparkSession, store: str, version: str) -> Held | None:
    """What the store has of a version: a few rows of the catalogue."""
    rows = entries(spark, store).where(F.col("version") == version).collect()
    if not rows:
        return None
    return Held(version, rows[0].content, {tuple(r.fields): r.groups for r in rows}, tuple(rows[0].metrics), T.StructType.fromJson(json.loads(rows[0].schema)))


def stored_answer(spark: SparkSession, store: str, at: Held, groups: list[str], metrics: list[str], conditions: list[tuple[str, str]], base: DataFrame | None = None) -> DataFrame:
    """The aggregate query from the stored cube of fewest groups that gives it exactly: one partition is read and no file of the base table.

    Without such a cube it is answered from `base`, or refused where that is not given.
    """
    cube = cube_for(list(at.sizes), set(groups) | {f for f, _ in conditions}, at.sizes)
    if cube is None or not exact(spark.createDataFrame([], at.schema), metrics, list(at.metrics)):
        if base is None:
            raise ValueError("no stored cube answers this exactly")
        return aggregate_query(base, groups, metrics, conditions)
    rows = spark.read.schema(_cube_schema(at, cube)).parquet(_cubes(store, at.version, at.content))
    return from_cube(rows.where(F.col("cube") == ",".join(cube)), groups, metrics, conditions)


def _cube_schema(at: Held, cube: tuple[str, ...]) -> T.StructType:
    """The columns of one cube's files that answers use: known from the catalogue, so no file is opened to learn them."""
    kinds = {f.name: f.dataType for f in at.schema}
    sums = lambda k: k if isinstance(k, T.DecimalType) else T.DoubleType() if isinstance(k, (T.DoubleType, T.FloatType)) else T.LongType()
    fields = [T.StructField(f, kinds[f]) for f in cube] + [T.StructField("count", T.LongType())]
    for m in at.metrics:
        k = kinds[m]
        fields += [T.StructField(f"{m}_n", T.LongType()), T.StructField(f"{m}_sum", T.DecimalType(min(38, k.precision + 10), k.scale) if isinstance(k, T.DecimalType) else sums(k)), T.StructField(f"{m}_min", k), T.StructField(f"{m}_max", k)]
    return T.StructType([*fields, T.StructField("cube", T.StringType())])


def _cubes(store: str, version: str, content: str) -> str:
    return f"{store}/cubes/{version}/{content}"


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _files(spark, path)
    return files.exists(at)


def file_hash(spark: SparkSession, path: str) -> str:
    """A hash of a table's path and the names, sizes and times of its files: tells whether they changed without reading them."""
    at, files = _files(spark, path)
    seen = [(f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files.listStatus(at)]
    return hashlib.sha256(repr((path, sorted(seen))).encode()).hexdigest()[:32]
