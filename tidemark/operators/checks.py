"""Data-quality jobs: samples by stratum, licence drift, pins, content digests, integrity of files, required periods."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions.lineage import checkpointed
from tidemark.operators.query import QueryError, aggregate_query, where
from tidemark.operators.versions import row_hash


def running_total(df: DataFrame, value: str, order: list) -> DataFrame:
    """Adds _s, the sum of `value` over all rows up to each one in an order that tells rows apart, and _p, the row's part of it.

    Rows are dealt into ranges of the order and kept there; a range starts from the sums of those before it, one row a range.
    """
    parts = checkpointed(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sums = parts.groupBy("_p").agg(F.sum(value).alias("_sum"))
    before = sums.select("_p", F.sum("_sum").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    own = F.sum(value).over(W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    rows = parts.withColumn("_own", own).join(F.broadcast(before), "_p")
    return rows.withColumn("_s", F.coalesce(F.col("_own") + F.col("_before"), "_own", "_before")).drop("_own", "_before")


def stratified_sample(items: DataFrame, seed: int, budget: int) -> DataFrame:
    """id, stratum, cost, why: forced items, then each stratum's cheapest, then others in seeded order while the budget lasts.

    items: id, stratum, cost, forced. The running total is taken by ranges of the order.
    """
    cheapest = F.row_number().over(W.partitionBy("stratum").orderBy("cost", "id")) == 1
    rank = F.when(F.col("forced"), 0).when(cheapest, 1).otherwise(2)
    ordered = items.withColumn("_k", rank).withColumn("_h", F.when(F.col("_k") == 2, F.md5(F.concat_ws(":", F.lit(str(seed)), "id"))))
    chosen = running_total(ordered, "cost", ["_k", "_h", "cost", "id"]).where((F.col("_k") < 2) | (F.col("_s") <= budget))
    return chosen.select("id", "stratum", "cost", F.when(F.col("_k") == 0, "forced").when(F.col("_k") == 1, "stratum").otherwise("drawn").alias("why"))


def licence_drift(stated: DataFrame, registered: DataFrame) -> DataFrame:
    """dataset, version, stated, registered where a version states another licence than is registered."""
    return stated.join(registered, "dataset").where(~F.col("stated").eqNullSafe(F.col("registered")) & F.col("stated").isNotNull())


def missing_pins(fetches: DataFrame) -> DataFrame:
    """Fetches without a pin after one that had it."""
    before = F.max(F.col("pinned").cast("int")).over(W.partitionBy("dataset").orderBy("day").rowsBetween(W.unboundedPreceding, -1))
    return fetches.withColumn("_b", before).where((F.col("_b") == 1) & ~F.col("pinned")).drop("_b")


def content_digest(df: DataFrame, position: str) -> DataFrame:
    """rows and digests of the rows with their places: equal only for equal tables in equal order."""
    return df.select(row_hash(df.columns).alias("h")).agg(F.count("*").alias("rows"), F.bit_xor("h").alias("digest_xor"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("digest_sum"))


def content_equal(a: dict[str, DataFrame], b: dict[str, DataFrame], position: str) -> DataFrame:
    """table, same for every table of either tree."""
    def side(tables: dict[str, DataFrame], tag: str) -> DataFrame:
        made = [content_digest(df, position).select(F.lit(n).alias("table"), F.struct("rows", "digest_xor", "digest_sum").alias(tag)) for n, df in tables.items()]
        return reduce(lambda x, y: x.unionByName(y), made)

    return side(a, "_a").join(side(b, "_b"), "table", "full_outer").select("table", F.col("_a").eqNullSafe(F.col("_b")).alias("same"))


def example_answers(rows: DataFrame, examples: dict[str, tuple[list[str], list[str], list[tuple[str, str]]]]) -> DataFrame:
    """example, valid, rows: whether an example query (groups, metrics, conditions) fits the table's fields, and how many rows it covers."""
    made = []
    for name, (groups, metrics, conditions) in examples.items():
        try:
            aggregate_query(rows, groups, metrics, conditions).schema
            covered, valid = where(rows, conditions), True
        except (QueryError, AnalysisException):
            covered, valid = rows.where(F.lit(False)), False
        made.append(covered.agg(F.lit(name).alias("example"), F.lit(valid).alias("valid"), F.count("*").alias("rows")))
    return reduce(lambda a, b: a.unionByName(b), made)


def file_sums(spark, path: str) -> DataFrame:
    """file, sha256 of every file under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"))


def changed_files(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """file, state: changed, missing or new against the recorded sums."""
    old = recorded.select(F.col("file").alias("_f"), F.col("sha256").alias("_s"))
    both = now.join(old, F.col("file") == F.col("_f"), "full_outer")
    state = F.when(F.col("_f").isNull(), "new").when(F.col("file").isNull(), "missing").when(F.col("sha256") != F.col("_s"), "changed")
    return both.select(F.coalesce("file", "_f").alias("file"), state.alias("state")).where("state is not null")


def periods_needed(sizes: DataFrame, bytes_limit: int = 100 << 20, rows_limit: int = 5_000_000) -> DataFrame:
    """Dated datasets over a limit that have no declared period."""
    return sizes.where("dated and period is null").where((F.col("bytes") > bytes_limit) | (F.col("rows") > rows_limit))


def stale_aggregates(published: DataFrame, built: DataFrame) -> DataFrame:
    """version, action: rebuild where the aggregate was made of other content, delete where nothing is published."""
    old = built.select(F.col("version").alias("_v"), F.col("hash").alias("_h"))
    both = published.join(old, F.col("version") == F.col("_v"), "full_outer")
    action = F.when(F.col("version").isNull(), "delete").when(F.col("_v").isNull() | (F.col("hash") != F.col("_h")), "rebuild")
    return both.select(F.coalesce("version", "_v").alias("version"), action.alias("action")).where("action is not null")
