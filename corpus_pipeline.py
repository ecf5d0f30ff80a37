"""The corpus pipeline: documents to packed token sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, near_dup, packing, quality, secrets
from tidemark.llm.common import documents, written
from tidemark.llm.queries import tokenizer_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    verdicts = quality.quality_verdicts(docs)
    bad = verdicts.where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["_hash"])
    return docs.join(bad, same, "left_anti")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words a shingle, similarity 0.8), the one of least id.

    Rows are told by id and text, so a unique text stays where its id is repeated or null; rows equal in both are one document.
    """
    groups = near_dup.near_duplicates(docs)
    rows = groups.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.min("chosen").alias("_chosen"), F.count("*").alias("_rows"))
    rows = written(rows.where("not _chosen or _rows > 1"), "repeated")
    same = docs["doc_id"].eqNullSafe(rows["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == rows["_hash"])
    single = docs.join(rows, same, "left_anti")
    repeated = docs.join(rows.where("_chosen"), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return single.unionByName(repeated)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_contaminated(docs, decontaminate.contaminated(docs, documents(spark, sf_dir, "benchmark")))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in their texts replaced by a mark; n_chars follows the text."""
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars").cast("long")))


def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 4096 tokens."""
    return packing.packed(docs, tokenizer_path())


STAGES = [
    ("quality rules", good),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", clean_of_benchmark),
    ("secret scans", without_secrets),
    ("packing", packs),
]
#: SQL cannot express the sketches, robust estimates or the tokenizer; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each one's rows written and read again before the next."""
    rows = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        rows = written(stage(spark, rows, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, rows, sf_dir)
