"""Sharding by sampled splitters: near-equal bytes in every shard, equal texts beside each other."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tidemark.llm.common import written


#: A group of equal texts up to this share of a shard's size is never parted.
WHOLE = 0.25


def range_sharded(rows: DataFrame, shards: int, key: list[str], size: str = "size", ranges_per_shard: int = 64, sample_rows: int = 16_384, seed: int = 7, group: str | None = None) -> DataFrame:
    """Adds shard (0 to shards - 1) and slot (gapless from 0 in each shard, in key order) so that the sizes are near equal.

    1. A weighted sample of keys is drawn: a row weighs its share of all sizes and its share of all rows, half and half, and stays with
       the probability weight * sample_rows, by a hash of its key: about `sample_rows` keys, the documented bound of what
       the driver sees, at any table size. So no range is overfull in bytes or in rows, however many rows are empty.
    2. Its weighted quantiles are the splitters of shards * ranges_per_shard ranges of the key order; rows are
       placed by binary search.
    3. Exact sizes of the ranges give each range's place on the scale of all sizes. A range that reaches over a shard's
       boundary (an overfull one among them) is subdivided: a running sum inside each range finds where every row
       lies on that scale. Its middle picks the shard.
    4. With `group`, the first column of the key, rows that share its value stay in one shard: where a boundary runs through such a group its middle picks the shard of all,
       unless it takes over WHOLE of a shard's size by itself. At most one group lies over each boundary.
    `key` must be unique for a fixed result (ties are broken by nothing else); a null key part sorts first, a null size counts 0.
    An empty table gives an empty table. The columns range, shard and slot are replaced if they exist.
    """
    rows = rows.drop("range", "shard", "slot")
    of = F.coalesce(F.col(size), F.lit(0)).cast("double")
    total, n = rows.agg(F.sum(of), F.count("*")).first()
    total = total or 0.0
    weight = (of / (2 * total) if total else F.lit(0.0)) + F.lit(0.5 / max(n, 1))
    chance = F.least(F.lit(1.0), weight * sample_rows)
    draw = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(draw < chance).select(*key, F.greatest(F.lit(1.0), weight * sample_rows).alias("weight")).collect()
    low = lambda k: tuple((x is not None, x) for x in k)  # noqa: E731  null first
    drawn = sorted((low(r[:-1]), r[-1]) for r in drawn)
    weight, splitters = sum(w for _, w in drawn), []
    step, seen = weight / (shards * ranges_per_shard), 0.0
    for k, w in drawn:
        seen += w
        if step and seen >= step * (len(splitters) + 1) and (not splitters or k > splitters[-1]):
            splitters.append(k)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in key))
            yield b.append_column("range", pa.array([bisect_right(splitters, low(k)) for k in keys], pa.int32()))

    placed = rows.mapInArrow(place, T.StructType([*rows.schema.fields, T.StructField("range", T.IntegerType())]))
    placed = written(placed, "ranges")
    sums = placed.groupBy("range").agg(F.sum(of).alias("_size"), F.count("*").alias("_rows"))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # over shards * ranges_per_shard rows at most
    sums = sums.select("range", F.coalesce(F.sum("_size").over(before), F.lit(0.0)).alias("_size0"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row0"))
    within = W.partitionBy("range").orderBy(*key)
    ranked = (
        placed.withColumn("_sum", F.sum(of).over(within.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("_n", F.row_number().over(within))
        .join(F.broadcast(sums), "range")
        .withColumn("_from", F.col("_size0") + F.col("_sum") - of)
        .withColumn("_row", F.col("_row0") + F.col("_n") - 1)
    )
    ranked = written(ranked.drop("_sum", "_n", "_size0", "_row0"), "ranked")
    shard_at = lambda at: F.least(F.lit(shards - 1), F.floor(at * shards / F.lit(total or 1.0))).cast("int")
    own = shard_at(F.col("_from") + of / 2)
    if group is None:
        ranked = ranked.withColumn("shard", own)
    else:
        groups = ranked.groupBy(F.col(group).alias("_group")).agg(F.min("_from").alias("_start"), F.sum(of).alias("_size"), F.count("*").alias("_copies"))
        over = groups.where((F.col("_copies") > 1) & (F.col("_size") <= WHOLE * total / shards) & (shard_at(F.col("_start")) != shard_at(F.col("_start") + F.col("_size"))))
        over = over.select("_group", shard_at(F.col("_start") + F.col("_size") / 2).alias("_whole"))  # a row a boundary at most
        ranked = ranked.join(F.broadcast(over), ranked[group].eqNullSafe(F.col("_group")), "left").withColumn("shard", F.coalesce("_whole", own)).drop("_group", "_whole")
    first = ranked.groupBy("shard").agg(F.min("_row").alias("_first"))  # one row a shard
    return ranked.join(F.broadcast(first), "shard").withColumn("slot", (F.col("_row") - F.col("_first")).cast("long")).drop("_row", "_first", "_from", "range")


def sharded_documents(docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Documents to shards of near-equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The key order is a 64-bit hash of the text, then the id, then the row's place in the table: equal texts stand together and share a shard, unless a group of
    copies takes over a quarter of a shard by itself (WHOLE): only then a boundary may run through it. The size is
    the text's UTF-8 bytes (null: none) plus 1. Texts of any length are read once, for their size and digests; only those are shuffled.
    Rows equal in id and text, and rows without an id, are each a row of their own.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    raw = F.encode(text, "UTF-8")
    # The row's number tells rows apart that are equal in id and text, or have no id: it is written once, so it stays.
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row_id"),
        F.col(id_column).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(text).alias("_text"),
    )
    out = range_sharded(written(rows, "sizes"), shards, ["_text", "doc_id", "_row_id"], group="_text")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
