"""An inverted index of a catalogue: postings in buckets of terms, with the totals that scores need, so that a search reads its words' buckets alone.

    <index>/postings/bucket=<k>/   term, id, kept columns, n_<field> (times the term is in a field), len_<field>, leads (1 in one posting of a row, else 0: they add up to rows); a file a segment (a range of ids), ordered by term and id
    <index>/totals/                rows and field lengths for each combination of the kept columns
"""

from __future__ import annotations

import json
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.catalogue import tokens
from tidemark.operators.cube_store import exists

BUCKETS = 64
#: Bytes of input files that make a segment; small inputs are cut down to a quarter of that, for all cores to have one.
SEGMENT = 16 << 20
#: Words that are counted at once, or one row's.
WORDS = 1 << 18


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term), F.lit(buckets)).cast("int")


def _segments(docs: DataFrame) -> list[int]:
    """The number of segments by the size of the largest table that docs are read from; none where Spark does not know it, and the session's number of partitions holds."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = max(leaves.apply(k).stats().sizeInBytes() for k in range(leaves.size()))
    if size >= 1 << 60:
        return []
    return [max(1, -(-size // SEGMENT), min(docs.sparkSession.sparkContext.defaultParallelism, -(-size // (SEGMENT // 4))))]


def _counted(fields: list[str], kept: list[str], buckets: int):
    """Rows with lists of words, as Arrow batches, to postings in the order of bucket, term and id within what is counted at once."""

    def postings(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = [b.column(f"_{f}") for f in fields]
        lengths = [pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in lists]
        said = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        bucket = np.array([zlib.crc32(t) % buckets for t in said.dictionary.cast(pa.binary()).to_pylist()], np.int32)
        terms = pc.sort_indices(pa.table({"bucket": bucket, "term": said.dictionary}), [("bucket", "ascending"), ("term", "ascending")]).to_numpy()
        rows = pc.sort_indices(b.column("id"), null_placement="at_start").to_numpy()
        place = lambda order: np.argsort(order).astype(np.int64)
        row = place(rows)[np.concatenate([np.repeat(np.arange(len(b)), n) for n in lengths])]
        field = np.repeat(np.arange(len(fields)), [n.sum() for n in lengths])
        keys, times = np.unique((place(terms)[said.indices.to_numpy()] * len(b) + row) * len(fields) + field, return_counts=True)
        own = keys // len(fields)
        first = np.r_[True, own[1:] != own[:-1]]
        counts = np.zeros((len(fields), first.sum()), np.int32)
        counts[keys % len(fields), np.cumsum(first) - 1] = times
        term, row = terms[own[first] // len(b)], rows[own[first] % len(b)]
        columns = {"term": said.dictionary.take(pa.array(term))} | {c: b.column(c).take(pa.array(row)) for c in ("id", *kept)}
        lead = np.full(len(b), -1)
        lead[row[::-1]] = np.arange(len(row))[::-1]  # the last that is set is a row's first
        leads = np.zeros(len(row), np.int32)
        leads[lead[lead >= 0]] = 1
        columns |= {f"n_{f}": pa.array(n) for f, n in zip(fields, counts, strict=True)} | {f"len_{f}": pa.array(n[row].astype(np.int32)) for f, n in zip(fields, lengths, strict=True)}
        return pa.RecordBatch.from_pydict(columns | {"leads": pa.array(leads), "bucket": pa.array(bucket[term])})

    def count(batches):
        for b in batches:
            ends = np.cumsum(sum(pc.list_value_length(b.column(f"_{f}")).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields))
            at = 0
            while at < len(b):
                before = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + WORDS, "right")))
                if ends[to - 1] > before:
                    yield postings(b.slice(at, to - at))
                at = to

    return count


def build_index(docs: DataFrame, path: str, fields: list[str], kept: list[str] = (), buckets: int = BUCKETS) -> None:
    """Index the rows of docs (id, text fields, kept columns that searches filter or order by).

    Rows are dealt to segments by ranges of their ids while they are text, so that finding the ranges cuts no text into words; a segment cuts and counts the words of its rows once and writes its own file of each bucket. Postings are not shuffled, and a term in a third of all rows is in a file of every segment, so no task writes it whole.
    """
    kept = list(kept)
    dealt = docs.select("id", *kept, *fields).repartitionByRange(*_segments(docs), "id")
    lists = dealt.select("id", *kept, *[tokens(F.coalesce(F.col(f), F.lit(""))).alias(f"_{f}") for f in fields])
    number = lambda c: T.StructField(c, T.IntegerType())
    schema = T.StructType([T.StructField("term", T.StringType()), *[docs.schema[c] for c in ("id", *kept)], *[number(f"n_{f}") for f in fields], *[number(f"len_{f}") for f in fields], number("leads"), number("bucket")])
    counted = lists.mapInArrow(_counted(fields, kept, buckets), schema)
    counted.sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    # A row's terms are its words, so postings tell rows and lengths; only rows without words are looked for in the text.
    sums = lambda rows, length: [F.coalesce(F.sum(rows), F.lit(0)).alias("rows"), *[F.coalesce(F.sum(length(f)), F.lit(0)).alias(f"len_{f}") for f in fields]]
    silent = reduce(lambda x, y: x & y, [~F.lower(F.coalesce(F.col(f), F.lit(""))).rlike(r"[\p{L}\p{N}]") for f in fields])
    said = docs.sparkSession.read.schema(schema).parquet(f"{path}/postings").groupBy(*kept).agg(*sums("leads", lambda f: f"n_{f}"))
    unsaid = docs.where(silent).groupBy(*kept).agg(*sums(F.lit(1), lambda f: F.lit(0)))
    totals = said.unionByName(unsaid).groupBy(*kept).agg(*sums("rows", lambda f: f"len_{f}"))
    totals.select("*", F.lit(buckets).alias("buckets"), F.lit(schema.json()).alias("schema")).write.mode("overwrite").parquet(f"{path}/totals")


def search_index(spark: SparkSession, path: str, query: str, weights: dict[str, float], where: dict[str, list] | None = None, limit: int = 20, k1: float = 1.2, b: float = 0.75, first: str | None = None) -> DataFrame:
    """id, score as ranked_search gives them: rows in which all words (12 at most) occur, by BM25 over weighted fields, rows where `first` holds before others.

    `where` keeps rows whose kept columns have one of the values listed; totals and frequencies are those of the rows it keeps. Of the postings only the buckets of the words are read.
    """
    words = list(dict.fromkeys(w for w in query.lower().split() if w))[:12]
    keeps = reduce(lambda x, y: x & y, [F.col(c).isin(*v) for c, v in (where or {}).items()], F.lit(True))
    totals = spark.read.parquet(f"{path}/totals")
    told = totals.select("buckets", "schema").first()
    if told is None:  # an index of no rows
        return spark.createDataFrame([], "id string, score double")
    buckets, schema = told.buckets, T.StructType.fromJson(json.loads(told.schema))
    length = lambda c: sum((w * F.col(f"{c}_{f}") for f, w in weights.items()), F.lit(0.0))
    every = totals.where(keeps).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("_n"), *[F.sum(f"len_{f}").alias(f"len_{f}") for f in weights]).select("_n", (length("len") / F.nullif(F.col("_n"), F.lit(0))).alias("_avg"))
    if not words:
        return spark.createDataFrame([], T.StructType([schema["id"], T.StructField("score", T.DoubleType())]))
    # The words' buckets are known before the postings are planned, so their folders alone are listed and read; a bucket without terms has none.
    own = sorted({zlib.crc32(w.encode()) % buckets for w in words})
    folders = [at for k in own if exists(spark, at := f"{path}/postings/bucket={k}")]
    postings = spark.read.schema(schema).option("basePath", f"{path}/postings").parquet(*folders) if folders else spark.createDataFrame([], schema)
    found = postings.where(F.col("bucket").isin(*own) & F.col("term").isin(*words) & keeps)
    found = found.select("term", "id", (F.col(first) if first else F.lit(True)).alias("_first"), length("n").alias("_t"), length("len").alias("_len"))
    df = found.groupBy("term").agg(F.count("*").alias("_df"))  # a row a word
    scored = found.join(F.broadcast(df), "term").crossJoin(F.broadcast(every))  # one row
    idf = F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    part = idf * F.col("_t") * (k1 + 1) / (F.col("_t") + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))
    rows = scored.select("id", "_first", "term", part.alias("part")).groupBy("id", "_first").agg(*[F.max(F.when(F.col("term") == w, F.col("part"))).alias(f"_p{i}") for i, w in enumerate(words)])
    score = sum((F.col(f"_p{i}") for i in range(len(words))), F.lit(0.0))
    return rows.where(score.isNotNull()).select("_first", "id", score.alias("score")).orderBy(F.desc("_first"), F.desc("score"), "id").limit(limit).drop("_first")
