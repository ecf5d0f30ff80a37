"""Ranked lexical search: bundles of items pass the owners of their terms one after another and gather integer scores by document."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm.common import written

BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Documents, and letters of their texts, in a block; items in a bundle. A block and a bundle meet in one group, whose scores are a table of so many by so many.
BLOCK_ROWS, BLOCK_CHARS, BUNDLE = 2_048, 8_000_000, 128
#: Slots for the crc32 of item terms: a bit each, so what executors get of the items has one size for any number of items.
SLOTS = 1 << 20
#: Owners by weight, rarest terms first: the least weights of the first three. 2303 is 1000 * ln 10, so every owner has terms ten times as common.
OWNERS = (6909, 4606, 2303)

POSTINGS = "block long, term string, rows binary, tf binary, n binary, most_tf long, least_n long, docs binary, known binary"


def terms(text: Column) -> Column:
    """The terms of a text: maximal runs of letters, digits and code points from 80 on, A-Z lower-cased (null: none)."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK), lambda t: t != "")


def slots(term: Column) -> Column:
    return (F.crc32(term.cast("binary")) % SLOTS).cast("int")


def _indexed(wanted: bytes):
    """Texts to blocks: for each term that an item may hold, its rows of the block, how often they hold it, and how long they are; and one row of the block's documents."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_slots = np.unpackbits(np.frombuffer(wanted, np.uint8)).astype(bool)
        seen: dict[str, bool] = {}
        part, number = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        lengths: list[int] = []
        posted: dict[str, tuple[list[int], list[int]]] = {}
        chars = 0

        def given() -> pa.RecordBatch:
            n = np.array(lengths, np.int64)
            block = (part << 32) + number
            rows = [(block, None, None, None, n.tobytes(), None, None, np.array([i or 0 for i in ids], np.int64).tobytes(), np.array([i is not None for i in ids], np.uint8).tobytes())]
            for term, (at, tf) in posted.items():
                here = n[at]
                rows.append((block, term, np.array(at, np.int32).tobytes(), np.array(tf, np.int64).tobytes(), here.tobytes(), max(tf), int(here.min()), None, None))
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            names = [c.split()[0] for c in POSTINGS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                # bytes.lower() changes A to Z alone
                found = TERM.findall(text.encode().lower().decode())
                row = len(ids)
                ids.append(doc)
                lengths.append(len(found))
                chars += len(text)
                for term, tf in Counter(found).items():
                    if (asked := seen.get(term)) is None:
                        if len(seen) >= 500_000:
                            seen.clear()
                        asked = seen[term] = bool(open_slots[zlib.crc32(term.encode()) % SLOTS])
                    if asked:
                        at, tfs = posted.setdefault(term, ([], []))
                        at.append(row)
                        tfs.append(tf)
                if len(ids) >= BLOCK_ROWS or chars >= BLOCK_CHARS:
                    yield given()
                    number, chars = number + 1, 0
                    ids, lengths, posted = [], [], {}
        if ids:
            yield given()

    return index


def impact(tf, n, total: int, length: int):
    """(10^9 * tf) div (1000 * tf + 12 * m), m = 75 + (25 * n * documents) div terms: of numbers, arrays or columns."""
    if isinstance(n, Column):
        div = lambda a, b: F.call_function("div", a, b)
        return div(F.lit(1_000_000_000) * tf, F.lit(1000) * tf + F.lit(12) * (F.lit(75) + div(F.lit(25) * n * F.lit(total), F.lit(length))))
    return (1_000_000_000 * tf) // (1000 * tf + 12 * (75 + (25 * n * total) // length))


#: A bundle's row for one item in one block: rows of the block that have a score so far, and their scores. top has the block's best scores of the item.
CARRIED = "bundle long, block long, slot int, rows binary, scores binary, top array<long>"


def _stage(total: int, length: int, k: int):
    """One owner's stage for one bundle and block: (its bundle, what the owner has of the block) -> the bundle with the owner's contributions added.

    A row of the block joins an item's scores only while what this owner and those after it can give at most reaches the item's bar, the k-th best score
    that k documents are known to have; a row leaves when its score and what is still to come cannot reach it.
    """

    def stage(key: tuple, carried: pd.DataFrame, owned: pd.DataFrame) -> pd.DataFrame:
        size = 0
        for rows in (*carried["rows"], *owned["rows"]):
            size = max(size, int(np.frombuffer(rows, np.int32).max(initial=-1)) + 1)
        scores: dict[int, np.ndarray] = {}
        live: dict[int, np.ndarray] = {}
        bars: dict[int, tuple[int, int]] = {}
        for slot, rows, got, to_join, to_stay in zip(*(carried[c] for c in ("slot", "rows", "scores", "to_join", "to_stay"))):
            at = np.frombuffer(rows, np.int32)
            bars[slot] = to_join, to_stay
            scores[slot], live[slot] = np.zeros(size, np.int64), np.zeros(size, bool)
            scores[slot][at] = np.frombuffer(got, np.int64)
            live[slot][at] = True
        for weight, rows, tf, n, asked in zip(owned["weight"], owned["rows"], owned["tf"], owned["n"], owned["items"]):
            at = np.frombuffer(rows, np.int32)
            given = int(weight) * impact(np.frombuffer(tf, np.int64), np.frombuffer(n, np.int64), total, length)
            for x in asked:
                slot = x["slot"]
                bars[slot] = x["to_join"], x["to_stay"]
                if slot not in scores:
                    if bars[slot][0] > 0:  # no row that no earlier owner named can reach the bar
                        continue
                    scores[slot], live[slot] = np.zeros(size, np.int64), np.zeros(size, bool)
                if bars[slot][0] <= 0:
                    live[slot][at] = True
                scores[slot][at] += given * x["times"]
        out = []
        for slot, had in scores.items():
            at = np.flatnonzero(live[slot] & (had > 0) & (had >= bars[slot][1]))
            if len(at):
                mine = had[at]
                top = np.sort(np.partition(mine, len(mine) - k)[len(mine) - k :] if len(mine) > k else mine)
                out.append((key[0], key[1], slot, at.astype(np.int32).tobytes(), mine.tobytes(), top.tolist()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in CARRIED.split(", ")])

    return stage


def _last(k: int):
    """The rows of a block that may be among an item's k best: its k best there, and all that are as good as the last of them."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, scores, ids = [], [], []
            for item, rows, got, bar, docs, known in zip(*(batch.column(i).to_pylist() for i in range(6))):
                at, had = np.frombuffer(rows, np.int32), np.frombuffer(got, np.int64)
                doc, is_known = np.frombuffer(docs, np.int64)[at], np.frombuffer(known, np.uint8)[at]
                order = np.lexsort((doc, is_known == 0, -had))[:k]
                order = order[had[order] >= bar]
                items += [item] * len(order)
                scores += had[order].tolist()
                ids += [int(d) if f else None for d, f in zip(doc[order], is_known[order])]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(scores, pa.int64()), pa.array(ids, pa.int64())], ["_item", "score", "doc_id"])

    return best


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, id_column: str = "doc_id", text_column: str = "text", item_id_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """The k best documents of each item: item_id, rank (from 1), doc_id, score; fewer where fewer have a score above 0.

    A term that df of N documents with terms hold weighs w = floor(1000 * ln((2N + 2) / (2df + 1))); a document of n terms gives w * impact(tf, n) for each time that the
    item names the term. Equal scores rank by ascending doc_id, null last.

    Texts are read once, into blocks of at most BLOCK_ROWS documents with the postings of terms that some item may hold (a fixed number of hash slots says which). Items go in
    bundles of at most BUNDLE. An owner has the terms of one range of weights; a bundle's scores in a block visit the owners one after another, rarest terms first, and meet
    there by cogroup what the owner has of that block, so no group grows with the table or with a term. Between owners every item's k-th best score so far becomes its bar: it
    prunes only what cannot be among the k best whatever follows, so results are exact. Every stage is written.

    Null and empty texts have no terms and no rank; a null or repeated item_id, or doc_id, is an item, or a document, of its own; texts of any length are read whole; other
    columns are not looked at; empty tables give no rows.
    """
    spark = docs.sparkSession
    named = items.select(F.monotonically_increasing_id().alias("_item"), F.col(item_id_column).cast("long").alias("item_id"), F.col(item_text_column).cast("string").alias("text"))
    named = written(named, "items").withColumn("bundle", F.floor(F.col("_item") / BUNDLE)).withColumn("slot", (F.col("_item") % BUNDLE).cast("int"))
    asked = written(named.select("bundle", "slot", F.explode(terms(F.col("text"))).alias("term")).groupBy("bundle", "slot", "term").agg(F.count("*").alias("times")), "item-terms")
    bits = np.zeros(SLOTS, np.uint8)
    bits[[r[0] for r in asked.select(slots(F.col("term"))).distinct().collect()]] = 1  # at most SLOTS numbers
    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    index = written(slim.mapInArrow(_indexed(np.packbits(bits).tobytes()), POSTINGS), "postings")
    blocks = index.where("term is null")
    # n is eight bytes a document; how many have terms and how many terms there are come from counts of whole blocks.
    total, length = _sizes(blocks)
    if not length:
        return named.select("item_id", F.lit(None).cast("int").alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("score")).limit(0)
    owner = reduce_owner(F.col("weight"))
    known = index.where("term is not null").groupBy("term").agg(F.sum(F.length("rows") / 4).cast("long").alias("df"), F.max(impact(F.col("most_tf"), F.col("least_n"), total, length)).alias("most"))
    known = known.withColumn("weight", F.floor(1000 * F.log((2 * F.lit(total) + 2) / (2 * F.col("df") + 1)))).where("weight > 0").withColumn("owner", owner)
    known = written(asked.join(known, "term"), "weights")
    per_item = known.groupBy("bundle", "slot", "owner").agg(F.sum(F.col("weight") * F.col("most") * F.col("times")).alias("most"))
    bounds = per_item.groupBy("bundle", "slot").pivot("owner", list(range(len(OWNERS) + 1))).agg(F.sum("most")).na.fill(0)
    bounds = written(bounds, "bounds")
    carried, bars = None, bounds.select("bundle", "slot", F.lit(0).cast("long").alias("bar"))
    for stage in range(len(OWNERS) + 1):
        rest = sum((F.col(str(s)) for s in range(stage, len(OWNERS) + 1)), F.lit(0).cast("long"))
        told = bars.join(bounds, ["bundle", "slot"]).select("bundle", "slot", (F.col("bar") - rest).alias("to_join"), (F.col("bar") - rest + F.col(str(stage))).alias("to_stay"))
        who = known.where(F.col("owner") == stage).join(told, ["bundle", "slot"]).groupBy("bundle", "term", "weight").agg(F.collect_list(F.struct("slot", "times", "to_join", "to_stay")).alias("items"))
        owned = index.where("term is not null").select("block", "term", "rows", "tf", "n").join(who, "term").select("bundle", "block", "weight", "rows", "tf", "n", "items")
        before = (carried if carried is not None else spark.createDataFrame([], CARRIED)).drop("top").join(told, ["bundle", "slot"])
        step = before.groupBy("bundle", "block").cogroup(owned.groupBy("bundle", "block"))
        carried = written(step.applyInPandas(_stage(total, length, k), CARRIED), f"stage-{stage}")
        each = carried.select("bundle", "slot", F.explode("top").alias("score"))
        place = F.row_number().over(W.partitionBy("bundle", "slot").orderBy(F.desc("score")))
        reached = each.withColumn("_r", place).where(F.col("_r") <= k).groupBy("bundle", "slot").agg(F.max("_r").alias("n"), F.min("score").alias("least"))
        bars = bounds.select("bundle", "slot").join(reached, ["bundle", "slot"], "left").select("bundle", "slot", F.when(F.col("n") == k, F.col("least")).otherwise(0).cast("long").alias("bar"))
        bars = written(bars, f"bars-{stage}")
    left = carried.join(bars, ["bundle", "slot"]).join(named.select("bundle", "slot", "_item"), ["bundle", "slot"]).join(blocks.select("block", "docs", "known"), "block")
    best = left.select("_item", "rows", "scores", "bar", "docs", "known").mapInArrow(_last(k), "_item long, score long, doc_id long")
    rank = F.row_number().over(W.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))).alias("rank")
    return best.select("_item", "score", "doc_id", rank).where(F.col("rank") <= k).join(named.select("_item", "item_id"), "_item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def reduce_owner(weight: Column) -> Column:
    """The owner of a term by its weight, 0 for the rarest."""
    made = F.lit(len(OWNERS))
    for k in reversed(range(len(OWNERS))):
        made = F.when(weight >= OWNERS[k], k).otherwise(made)
    return made


def _sizes(blocks: DataFrame) -> tuple[int, int]:
    """How many documents have terms, and how many terms all have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([int((x > 0).sum()) for x in n], pa.int64()), pa.array([int(x.sum()) for x in n], pa.int64())], ["total", "length"])

    got = blocks.select("n").mapInArrow(count, "total long, length long").agg(F.sum("total"), F.sum("length")).first()
    return got[0] or 0, got[1] or 0
