"""Spelling variants against a plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from tests.compare import sf
from tidemark.llm import spelling


def plain_words(rows, least_length=7, least_n=2):
    total = Counter()
    for doc, text in rows:
        for m in re.finditer("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[0])
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode("utf-8"))
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= least_length and n >= least_n}


def apart_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows):
    words = plain_words(rows)
    near = {w: [] for w in words}
    by = {}
    for w in words:
        by.setdefault(len(w), []).append(w)
    for w in words:
        near[w] = [v for k in (-1, 0, 1) for v in by.get(len(w) + k, []) if apart_by_one(w, v)]
    form = {w: (v := min(near[w], key=lambda x: (-words[x], x))) if near[w] and words[min(near[w], key=lambda x: (-words[x], x))] >= 10 * n else None for w, n in words.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_generated_words(spark):
    rng = random.Random(7)
    letters = "abcdéÿ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 10))) for _ in range(60)]
    rows = []
    for doc in range(150):
        words = []
        for _ in range(40):
            w = rng.choice(base[:6] * 8 + base)
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice((w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]))
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((doc, " ".join(words)))
    want = plain(rows)
    assert any(r[1] for r in want) and any(r[4] > 5 for r in want)
    assert got(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_chain_of_forms(spark):
    """Each word ten times as common as the one before: the root is three steps away."""
    names = ["zzzzzzzz", "zzzzzzzq", "zzzzzzqq", "zzzzzqqq"]
    whole = [next(d for d in range(99) if spelling.result(d, name) == name) for name in names]
    rows = [(whole[k], " ".join([name] * 2 * 10**k)) for k, name in enumerate(names)]
    assert got(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)
    assert {r[2] for r in plain(rows)} == {"zzzzzqqq"}


def test_many_blocks(spark, monkeypatch):
    """Cells cut into several blocks, and products into several strips, lose no pair."""
    monkeypatch.setattr(spelling, "BLOCK_LETTERS", 64)
    monkeypatch.setattr(spelling, "ROWS", 2)
    rng = random.Random(3)
    words = list({"".join(rng.choice("ai") for _ in range(rng.randint(7, 8))) for _ in range(120)})
    rows = [(k, f"{w} {w}") for k, w in enumerate(words)] + [(k + 1000, f"{w} {w}") for k, w in enumerate(words[:20])]
    assert got(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_odd_rows(spark):
    long = "b" * 30_000
    rows = [(None, "letters Letters"), (1, None), (2, ""), (3, "short a1b2c3 lettersx lettersx"), (3, "short a1b2c3"), (4, f"{long} {long}"), (5, f"{long[1:]}c {long}x"), (6, "× ÷×÷×÷×÷ ÷×÷×÷×÷")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'q' as word", "array(1) as cell")
    assert got(spelling.spelling_variants(df)) == plain(rows)
    assert spelling.spelling_variants(df.limit(0)).collect() == []


@pytest.mark.skipif(not __import__("os").path.isdir(sf()), reason="no test tables here")
def test_given_documents(spark):
    docs = spark.read.parquet(f"{sf()}/documents.parquet")
    assert got(spelling.spelling_variants(docs)) == plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_no_edit_is_missed_by_the_counts():
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice(spelling.LETTERS) for _ in range(rng.randint(7, 12)))
        k = rng.randrange(len(a))
        for b in (a[:k] + rng.choice(spelling.LETTERS) + a[k + 1 :], a[:k] + rng.choice(spelling.LETTERS) + a[k:]):
            pairs = [p for i, j in spelling.near([a], [b]) for p in zip(i, j)]
            assert len(pairs) == apart_by_one(a, b)
