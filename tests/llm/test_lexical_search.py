"""Ranked search against scores of every item and document."""

import math
import random
import re
from collections import Counter

import pytest

from tests.compare import sf
from tidemark.llm import lexical_search


def plain(docs, items, k=20):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low(t))
    bags = [(d, Counter(terms(t))) for d, t in docs]
    total, length = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked, scored = Counter(terms(text)), []
        for doc, bag in bags:
            m = 75 + 25 * sum(bag.values()) * total // length if length else 0
            score = sum(times * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m)) for t, times in asked.items() if t in bag)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("seed", [1, 2])
def test_every_score(spark, monkeypatch, seed):
    """Small blocks and bundles, terms of all frequencies, copies that tie."""
    monkeypatch.setattr(lexical_search, "BLOCK_ROWS", 7)
    monkeypatch.setattr(lexical_search, "BUNDLE", 3)
    monkeypatch.setattr(lexical_search, "OWNERS", (3500, 2000, 700))
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(150)] + ["Été", "ÉTÉ", "x-y"]
    word = lambda: vocabulary[min(len(vocabulary) - 1, int(rng.paretovariate(0.5)) - 1)]
    docs = [(k, " ".join(word() for _ in range(rng.randint(0, 40)))) for k in range(120)]
    docs += [(k + 1000, docs[5][1]) for k in range(40)]
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 12)))) for k in range(8)] + [(100, "w0 w0 W1"), (101, docs[5][1])]
    assert got(lexical_search.ranked(*tables(spark, docs, items), k=5)) == plain(docs, items, 5)


def test_odd_rows(spark):
    docs = [(None, "apple pear"), (1, None), (2, ""), (3, "apple " * 5000 + "pear"), (3, "apple pear"), (4, "apple pear"), (5, "... !?"), (6, "plum"), (7, "fig"), (8, "kiwi")]
    items = [(None, "apple"), (1, None), (2, ""), (3, "pear PEAR nothing"), (3, "plum apple")]
    d, i = tables(spark, docs, items)
    clash = d.selectExpr("*", "1 as block", "'q' as term", "2 as score")
    assert got(lexical_search.ranked(clash, i.selectExpr("*", "3 as bundle", "4 as slot"))) == plain(docs, items)
    assert lexical_search.ranked(d.limit(0), i).collect() == lexical_search.ranked(d, i.limit(0)).collect() == []


@pytest.mark.skipif(not __import__("os").path.isdir(sf()), reason="no test tables here")
def test_given_tables(spark):
    docs, items = (spark.read.parquet(f"{sf()}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert got(lexical_search.ranked(docs, items)) == want
