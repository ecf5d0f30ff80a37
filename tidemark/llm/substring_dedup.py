"""Substring dedup: every run of consecutive sentences is hashed, equal runs meet in one shuffle, later copies lose their sentences."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.near_dup import mixed, powers_to

#: Kinds of characters: letters and digits, letters of scripts written without spaces (each a word), ends of sentences where a
#: space follows, ends of sentences anywhere, new lines.
OTHER, LETTER, ALONE, STOP, FULL_STOP, LINE = range(6)
#: Characters from here on (rare ideographs) are words of their own.
TOP = 0x20000
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF)]
#: What may close a sentence after its end.
CLOSERS = "\"')]»”’"
#: For the second pass sentences are also cut after words whose hash is 0 modulo CUT, wherever they stand: equal passages are cut alike
#: though they begin and end in the middle of different sentences.
CUT = 14
_SECOND = np.uint64(0xD6E8FEB86659FD93)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(kind, lower case) of every character under TOP, and of all others in the last place."""
    kind = np.array([LETTER if (c := chr(k)).isalnum() or c == "_" else OTHER for k in range(TOP)] + [ALONE], np.uint8)
    for a, b in UNSPACED:
        kind[a : b + 1][kind[a : b + 1] == LETTER] = ALONE
    for c, k in zip(".!?。！？\n", [STOP] * 3 + [FULL_STOP] * 3 + [LINE]):
        kind[ord(c)] = k
    lower = np.array([ord(c) if len(c := chr(k).lower()) == 1 else k for k in range(TOP)] + [TOP], np.uint64)
    return kind, lower


@dataclass
class Cut:
    """The words of a text: where they start and end (code points; a word that ends a sentence has its stop too), whether a sentence ends after them, their hashes."""

    start: np.ndarray
    end: np.ndarray
    ends: np.ndarray
    words: np.ndarray

    def bounds(self, cut_words: int = 0) -> np.ndarray:
        """Places in words where sentences begin, and the end; sentences cut further after one in `cut_words` words where that is given."""
        cut = self.ends | (self.words % np.uint64(cut_words) == 0) if cut_words else self.ends.copy()
        cut[-1] = True
        return np.concatenate(([0], np.flatnonzero(cut) + 1))


def sentences(text: str) -> Cut | None:
    """A text cut into words and sentences; None for a text without words."""
    kinds, lower = _tables()
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.minimum(code, TOP)
    kind = kinds[at]
    letter, alone = kind == LETTER, kind == ALONE
    before, after = np.zeros(len(kind), bool), np.zeros(len(kind), bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    start = np.flatnonzero(alone | letter & ~before)
    end = np.flatnonzero(alone | letter & ~after) + 1
    if not len(start):
        return None
    up, down = powers_to(len(code))
    hashed = mixed(np.where(at == TOP, code, lower[at]).astype(np.uint64) + np.uint64(1))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashed * up[: len(code)], dtype=np.uint64)))
    words = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    stop = (kind == FULL_STOP) | (kind == LINE) | (kind == STOP) & ~after
    last_stop = np.maximum.accumulate(np.where(stop, np.arange(len(kind)), -1))
    until = np.append(start[1:], len(code)) - 1  # the last character before the next word
    ends = last_stop[until] >= end
    return Cut(start, np.where(ends, last_stop[until] + 1, end), ends, words)


def runs(cut: Cut, bounds: np.ndarray, several: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word after, hash, hash) of the run at every unit that has one: the fewest units, `several` or more, with `least_words` words."""
    first = np.arange(len(bounds) - 1)
    after = np.maximum(first + several, np.searchsorted(bounds, bounds[:-1] + least_words))
    first, after = first[after < len(bounds)], after[after < len(bounds)]
    a, b = bounds[first], bounds[after]
    up, down = powers_to(len(cut.words))
    made = []
    for words in (cut.words, mixed(cut.words ^ _SECOND)):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)))
        made.append(mixed((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)).view(np.int64))
    return a, b, *made


def all_runs(cut: Cut, several: int, passage_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, word after, hash, hash) of the runs of sentences, place twice their first word, and of the second pass, place one more."""
    found = [runs(cut, cut.bounds(), several, 0)]
    if passage_words:
        found.append(runs(cut, cut.bounds(CUT), several, passage_words))
    return np.concatenate([2 * f[0] + k for k, f in enumerate(found)]), *(np.concatenate([f[i] for f in found]) for i in (1, 2, 3))


def repeated_spans(docs: DataFrame, several: int = 3, passage_words: int = 24, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Documents that lose text: doc_id, n_sentences, n_removed, spans (start, end in code points), first_ids, text (what is left).

    Every run of `several` consecutive sentences is hashed to 128 bits (words only, lower case), however few words it has; a run
    that occurs before, in a document of smaller id or earlier in the same one, is a copy, and its sentences are removed; so a longer repeated passage goes whole, as all
    its runs are copies. The first occurrence stays. first_ids lists the ids that hold the first occurrences (null ids left out). A sentence ends at a stop before white
    space, at a full-width stop or at a new line. n_removed counts the sentences that go whole.

    Repeated passages. A passage that begins and ends within sentences, or whose sentences are long, can hold no run of whole ones. A second pass in the same shuffle takes pieces for
    sentences: cut at sentence ends and after words that a hash picks (one in CUT), so that equal passages are cut alike wherever they stand. A run of `several` pieces
    and `passage_words` words is removed where it is a copy, be it a part of one sentence. `passage_words` of 0 leaves this pass out, and a repeated sentence alone then stays, however long.

    A row is told by its id and its text: rows that repeat an id with other texts are documents of their own (ties go by a hash of the
    text), rows equal in both are one document and are answered alike, and rows without an id come first. Texts without a copied run
    have no row; nor have null and empty texts. Texts of any length are cut whole. The hashes of runs are what is shuffled: least occurrences are
    found by partial sums, and a run that a third of all documents share is joined back from a written table, so that Spark can split its rows.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    keyed = docs.where("text is not null").withColumn("_text", F.xxhash64("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
            rows, parts, size = [], [], 0

            def made() -> pa.RecordBatch:
                of = np.concatenate([np.full(len(p[0]), r) for r, p in zip(rows, parts)]) if rows else np.zeros(0, int)
                place, one, two = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 2, 3))
                # The two passes never meet: their hashes differ by a constant.
                one = np.where(place % 2 == 1, ~one, one)
                arrays = [ids.take(pa.array(of, pa.int64())), pa.array(keys[of]), pa.array(place.astype(np.int64)), pa.array(one), pa.array(two)]
                return pa.RecordBatch.from_arrays(arrays, ["doc_id", "_text", "place", "run", "run2"])

            for row, text in enumerate(batch.column(1).to_pylist()):
                found = sentences(text)
                if found and len((run := all_runs(found, several, passage_words))[0]):
                    rows.append(row)
                    parts.append(run)
                    size += len(run[0])
                if size > 100_000:
                    yield made()
                    rows, parts, size = [], [], 0
            yield made()

    # Cut anew for each of its two uses: hashes do not compress, and written runs take more disk than the texts.
    every = keyed.mapInArrow(cut, "doc_id long, _text long, place long, run long, run2 long")
    place = F.struct("doc_id", "_text", "place")
    least = every.groupBy("run", "run2").agg(F.min(place).alias("at"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    least = written(least, "runs")
    later = every.join(least, ["run", "run2"]).where(~place.eqNullSafe(F.col("at")))
    covers = later.groupBy("doc_id", "_text").agg(F.collect_set("place").alias("covers"), F.array_sort(F.collect_set("at.doc_id")).alias("first_ids"))
    covers = written(covers.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_key"), "covers", "first_ids"), "covers")
    hit = keyed.join(covers, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key"))).select("doc_id", "text", "covers", "first_ids")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, *_without(text, covers, several, passage_words), ids) for doc, text, covers, ids in zip(*(c.to_pylist() for c in batch.columns))]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "n_sentences", "n_removed", "spans", "text", "first_ids"])

    out = hit.mapInArrow(remove, "doc_id long, n_sentences long, n_removed long, spans array<struct<start:long,end:long>>, text string, first_ids array<long>")
    return out.select("doc_id", "n_sentences", "n_removed", "spans", "first_ids", "text")


def _without(text: str, covers: list[int], several: int, passage_words: int) -> tuple[int, int, list[dict], str]:
    """(sentences, how many go whole, spans that go, text that is left) of a text whose runs at the places `covers` are copies."""
    cut = sentences(text)
    place, after, *_ = all_runs(cut, several, passage_words)
    copied = np.isin(place, covers)
    change = np.zeros(len(cut.words) + 1, int)
    np.add.at(change, place[copied] // 2, 1)
    np.add.at(change, after[copied], -1)
    gone = np.concatenate(([False], np.cumsum(change)[:-1] > 0, [False]))
    kept = np.concatenate(([0], np.cumsum(~gone[1:-1])))
    bounds = cut.bounds()
    whole = int((kept[bounds[1:]] == kept[bounds[:-1]]).sum())
    edge = np.flatnonzero(gone[1:] != gone[:-1])
    spans, left, at = [], [], 0
    for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist()):
        start, end = int(cut.start[a]), int(cut.end[b - 1])
        while end < len(text) and text[end] in CLOSERS and text[end - 1] not in "\n ":
            end += 1
        spans.append({"start": start, "end": end})
        left.append(text[at:start])
        at = end
    return len(bounds) - 1, whole, spans, "".join(left) + text[at:]
