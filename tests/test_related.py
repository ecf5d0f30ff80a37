"""The k most related records by shared words, against all pairs; words that all records share bring no pairs together."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import catalogue

SCHEMA = "id long, org string, collection long, topics array<string>, words array<string>"


def brute(rows, k):
    out = []
    for a in rows:
        near = []
        for b in rows:
            if a[0] != b[0] and a[1] is not None and b[1] is not None and a[1] != b[1] and not (a[2] is not None and a[2] == b[2]) and set(a[3]) & set(b[3]):
                if n := len(set(a[4]) & set(b[4])):
                    near.append((-n, b[0]))
        out += [(a[0], o, -n) for n, o in sorted(near)[:k]]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_as_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(catalogue, "MEET", [2, 5, 12, 40][seed])
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(170):
        own = {"all"} if rng.random() < 0.8 else set()
        own |= {words[min(59, int(rng.paretovariate(0.6)) - 1)] for _ in range(rng.randint(0, 6))}
        rows.append((k, rng.choice("abcde") if rng.random() < 0.8 else "a", rng.choice([None, 1, 2, 3]), rng.sample("xyz", rng.randint(0, 2)), sorted(own)))
    got = sorted(map(tuple, catalogue.related(spark.createDataFrame(rows, SCHEMA), 4).collect()))
    assert got == brute(rows, 4)


def test_a_word_in_every_record(spark):
    """Rows dealt grow with rows times k: twice the records, about twice the rows."""
    counts = []
    for n in (1500, 3000):
        df = spark.range(n).selectExpr("id", "concat('o', id % 40) org", "if(id % 3 = 0, null, id % 50) collection", "array('x') topics", "array('all', concat('w', id div 3)) words")
        each = df.select("id", "org", "collection", F.explode("topics").alias("topic"), "words").withColumn("word", F.explode("words"))
        each = each.join(each.groupBy("topic", "word").agg(F.count("*").alias("n")), ["topic", "word"])
        rare, common = catalogue.met_by_rare_words(each), catalogue.met_by_common_words(each, df.select("id").limit(0).withColumn("bar", F.lit(0).cast("long")), 12)
        counts.append((rare.count(), common.count()))
        assert counts[-1][0] <= 2 * n and counts[-1][1] <= 60 * n
    assert counts[1][1] < 2.2 * counts[0][1]
    got = sorted(map(tuple, catalogue.related(df.where("id < 700")).where("id in (5, 6, 600)").collect()))
    rows = [(r.id, r.org, r.collection, r.topics, r.words) for r in df.where("id < 700").collect()]
    assert got == [x for x in brute(rows, 12) if x[0] in (5, 6, 600)]
