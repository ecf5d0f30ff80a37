"""Spelling variants: words one edit apart found by Gram matrices of letter-count blocks, and the commoner form that each leads to."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

RUN = re.compile(r"[a-zÀ-ÿ]+")
LETTERS = [chr(c) for c in (*range(0x61, 0x7B), *range(0xC0, 0x100))]
#: Letters fall into so many classes, by code point; a word's cell is how many letters of each class it has.
CLASSES = 8
#: Coordinates of a letter-count vector: a to z, and six that share the letters beyond. Sharing can only bring two words closer.
DIMENSIONS = 32
#: Letters in a block of words of one cell (a word counts as 16 at least), and rows of a block multiplied at once.
BLOCK_LETTERS, ROWS = 65_536, 256
#: A task's counts are given out when it holds so many words; later sums put them together.
HELD = 200_000


def result(doc_id: int | None, run: str, planted: int = 31) -> str:
    """The run, without one code point where `planted` divides the crc32 of '<doc_id>:<run>' (a null id is empty)."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % planted:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _counted(least_length: int, planted: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(found: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

        total: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if (text := text.as_py()) is None:
                    continue
                # bytes.lower() changes A to Z alone
                for run, n in Counter(r for r in RUN.findall(text.encode().lower().decode()) if len(r) >= least_length).items():
                    if len(word := result(doc, run, planted)) >= least_length:
                        total[word] += n
                if len(total) >= HELD:
                    yield given(total)
                    total = Counter()
        yield given(total)

    return count


def counted_words(docs: DataFrame, least_length: int = 7, least_n: int = 2, planted: int = 31, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """word, n: the distinct results of the letter runs of all whole texts, of `least_length` code points and `least_n` occurrences at least.

    A run is a maximal row of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased; `result` says which lose a letter. Counts are summed in
    the task that reads a text before they are dealt by word, so a word in every document costs one row a task.
    """
    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return slim.mapInArrow(_counted(least_length, planted), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def cell(word: Column) -> Column:
    """Letters of each class in a word: a coarse letter-count vector, whose sum is the length."""
    of = ["".join(c for c in LETTERS if ord(c) % CLASSES == k) for k in range(CLASSES)]
    return F.array(*[F.length(word) - F.length(F.translate(word, letters, "")) for letters in of])


#: From a cell to those that hold words one edit away: itself, one letter of another class instead, one letter more. Every two cells come once.
STEPS = [[0] * CLASSES] + [[(c == i) - (c == j) for c in range(CLASSES)] for i in range(CLASSES) for j in range(i + 1, CLASSES)] + [[int(c == i) for c in range(CLASSES)] for i in range(CLASSES)]


def counts(codes: np.ndarray) -> np.ndarray:
    """Letter-count vectors of words given as rows of code points."""
    n, length = codes.shape
    at = np.where(codes < 0x7B, codes - 0x61, 26 + codes % (DIMENSIONS - 26)).astype(np.int64)
    made = np.bincount((at + DIMENSIONS * np.arange(n)[:, None]).ravel(), minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)
    return made.astype(np.float32 if length < 2048 else np.float64)


def codes(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.array(words).view(np.uint32).reshape(len(words), -1)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of code points, b as long as a or one longer: whether exactly one replaced or inserted code point makes a row of b from that of a."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    first = np.cumprod(a == b[:, :-1], axis=1).sum(1)
    return ((a == b[:, 1:]) | (np.arange(a.shape[1]) < first[:, None])).all(1)


def near(a: list[str], b: list[str] | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the words of blocks a and b (or twice a) that are one edit apart. Words of a block are of one length, those of b as long or one longer.

    |x - y|^2 = |x|^2 + |y|^2 - 2 x.y over letter counts is one matrix product; an edit moves it by two at most, so only pairs up to two are compared by letters.
    """
    ca = codes(a)
    cb = ca if b is None else codes(b)
    va, vb = counts(ca), (counts(cb) if b is not None else counts(ca))
    own = (vb * vb).sum(1)
    for k in range(0, len(a), ROWS):
        rows = va[k : k + ROWS]
        gram = rows @ vb.T
        gram *= -2
        gram += own
        gram += (rows * rows).sum(1)[:, None]
        i, j = np.nonzero(gram <= 2)
        i += k
        if b is None:
            i, j = i[i < j], j[i < j]
        good = one_edit(ca[i], cb[j])
        yield i[good], j[good]


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the words of every two blocks: how many near words there are in the other, and the commonest of them."""
    for batch in batches:
        words, n_near, best_n, best = [], [], [], []
        for a, na, b, nb in zip(*(batch.column(k) for k in range(4))):
            a, na, b, nb = a.as_py().split(" "), na.as_py(), b.as_py(), nb.as_py()
            b = None if b is None else b.split(" ")
            found: dict[str, list] = {}
            for i, j in near(a, b):
                other, n_other = (a, na) if b is None else (b, nb)
                for x, y in zip(i.tolist(), j.tolist()):
                    for word, by, n in ((a[x], other[y], n_other[y]), (other[y], a[x], na[x])):
                        had = found.get(word)
                        if had is None:
                            found[word] = [1, n, by]
                        else:
                            had[0] += 1
                            if (-n, by) < (-had[1], had[2]):
                                had[1:] = n, by
            for word, (k, n, by) in found.items():
                words.append(word), n_near.append(k), best_n.append(n), best.append(by)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n_near, pa.int64()), pa.array(best_n, pa.int64()), pa.array(best, pa.string())], ["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: of each word (word, n; words distinct) how many others are exactly one code point away, and the commonest of them, ties by code points.

    Words of one cell are cut into blocks of bounded letters by a hash, however many a cell has. Two blocks meet where their cells differ as one edit can make
    them differ, so lengths are equal or adjacent. Each meeting gives back one row a word, not its pairs.
    """
    placed = words.select("word", "n", cell(F.col("word")).alias("cell"))
    weight = F.sum(F.greatest(F.length("word"), F.lit(16)))
    cells = written(placed.groupBy("cell").agg(F.ceil(weight / BLOCK_LETTERS).cast("int").alias("parts")), "cells")
    cut = placed.join(cells, "cell").withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    gathered = F.array_sort(F.collect_list(F.struct("word", "n")))
    blocks = cut.groupBy("cell", "part").agg(gathered.alias("x")).select("cell", "part", F.array_join("x.word", " ").alias("words"), F.col("x.n").alias("ns"))
    blocks = written(blocks, "letter-blocks")
    step = F.explode(F.array(*[F.array(*map(F.lit, s)) for s in STEPS])).alias("step")
    to = cells.select("cell", "parts", step).select("cell", "parts", F.zip_with("cell", "step", lambda x, y: x + y).alias("other"))
    to = to.join(cells.select(F.col("cell").alias("other"), F.col("parts").alias("other_parts")), "other")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    units = to.withColumn("part", every("parts")).withColumn("other_part", every("other_parts"))
    units = units.where((F.col("cell") != F.col("other")) | (F.col("part") <= F.col("other_part")))
    own = (F.col("cell") == F.col("other")) & (F.col("part") == F.col("other_part"))
    # A block that meets itself is not fetched twice.
    met = units.where(~own).join(blocks.select(F.col("cell").alias("other"), F.col("part").alias("other_part"), F.col("words").alias("words_b"), F.col("ns").alias("ns_b")), ["other", "other_part"])
    met = met.select("cell", "part", "words_b", "ns_b").join(blocks, ["cell", "part"]).select("words", "ns", "words_b", "ns_b")
    alone = blocks.select("words", "ns", F.lit(None).cast("string").alias("words_b"), F.lit(None).cast("array<bigint>").alias("ns_b"))
    found = met.unionByName(alone).mapInArrow(_paired, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct(-F.col("best_n"), F.col("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("x")).select("word", "n_near", (-F.col("x.col1")).alias("best_n"), F.col("x.best").alias("best"))


def roots(forms: DataFrame, digits: int) -> DataFrame:
    """word, root for rows of word, form: forms followed to the last, two steps becoming one each round. No chain is longer than `digits`."""
    way = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(1, digits - 1).bit_length()):
        on = way.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        way = written(way.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "forms")
    return way


def spelling_variants(docs: DataFrame, least_length: int = 7, least_n: int = 2, times: int = 10, planted: int = 31, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each word of the texts (see counted_words): word, form, root, n, n_near, form_n.

    Near words differ by exactly one inserted, deleted or replaced code point; a word's form is its near word of largest n (ties: the first by code
    points) if that n is `times` the word's at least, and its root the last form on the way (the word itself without one). A form's n is ten
    times as large, so ways end and are no longer than the largest n has digits.

    Null and empty texts have no words; a null id is empty in the hash; repeated rows count each; texts are read whole, whatever their length;
    other columns are not looked at; an empty table gives no rows.
    """
    if times < 10:
        raise ValueError("times is 10 or more: chains of forms are followed as far as the largest count has digits")
    words = written(counted_words(docs, least_length, least_n, planted, id_column, text_column), "words")
    known = near_words(words)
    formed = F.col("best_n") >= times * F.col("n")
    rows = words.join(known, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n"))
    rows = written(rows, "near-words")
    most = rows.agg(F.max("n")).first()[0] or 0
    way = roots(rows.where("form is not null"), len(str(most)))
    return rows.join(way, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
