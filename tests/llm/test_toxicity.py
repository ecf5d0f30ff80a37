import random
import zlib

import numpy as np

from tidemark.llm import toxicity as t


def corpus(n=1500):
    r = random.Random(6)
    voc = ["w" + "".join(r.choices("abcdefgh", k=5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 9 == 0
        words = r.choices(voc, k=r.randint(20, 60))
        if toxic:
            for _ in range(r.randint(1, 4)):
                words[r.randrange(len(words))] = r.choice(["idiot", "Scum", "zorgl" + r.choice("abcde"), "zorgl" + r.choice("xyz")])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic != (r.random() < 0.03))))
    return rows, labels


def test_held_out_accuracy(docs, spark):
    rows, labels = corpus()
    rows += [(9001, None), (9002, ""), (None, "you are such an idiot"), (9003, "calm " * 50_000)]
    got = {r.doc_id: r for r in t.toxicity(docs(rows), spark.createDataFrame(labels + labels[:5], "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, _ in rows if d is not None) and got[None].held_out is False
    held = [d for d, _ in rows if d is not None and d < 9000 and got[d].held_out]
    assert np.mean([got[d].predicted == (d % 9 == 0) for d in held]) > 0.98
    assert got[9001].score == got[9002].score == got[9003].score < 0.5 < got[None].score


def test_held_out_labels_teach_nothing(docs, spark):
    rows, labels = corpus(300)
    flip = [(d, q, 1 - y if zlib.crc32(str(d).encode()) % 5 == 0 else y) for d, q, y in labels]
    score = lambda ls: {r.doc_id: r.score for r in t.toxicity(docs(rows), spark.createDataFrame(ls, "doc_id long, quality int, toxic int")).collect()}
    assert score(labels) == score(flip)


def test_label_model_finds_accuracies_and_correlations():
    r = np.random.default_rng(0)
    y = r.random(20_000) < 0.2
    vote = lambda a, b: np.where(y, r.random(len(y)) < a, r.random(len(y)) < b)
    one = vote(0.6, 0.05)
    fired = np.stack((one, one, vote(0.7, 0.02), vote(0.4, 0.01)), 1)
    p, rates, correlation = t.label_model(fired, np.where(r.random(len(y)) < 0.05, ~y, y))
    assert abs(rates[1, 2] - 0.7) < 0.03 and abs(rates[0, 2] - 0.02) < 0.01
    assert correlation[0, 1] > 0.9 and abs(correlation[0, 2]) < 0.1 and ((p > 0.5) == y).mean() > 0.97


def test_no_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r.score, r.predicted) for r in t.toxicity(docs([(1, "idiot")]), none).collect()] == [(0.0, 0)]
    assert t.toxicity(docs([(1, "a")]).limit(0), none).collect() == []


def test_voters_overrule_wrong_labels():
    r = np.random.default_rng(3)
    y = r.random(6_000) < 0.15
    fired = np.stack([np.where(y, r.random(len(y)) < 0.6, r.random(len(y)) < 0.01) for _ in range(8)], 1)
    wrong = r.random(len(y)) < 0.04
    given = y ^ wrong
    p, rates, _ = t.label_model(fired, given)
    told = p > 0.5
    assert (told[wrong] == y[wrong]).mean() > 0.9 and (told == y).mean() > 0.995 and (told != given).sum() > 100


def test_nested_keys_go():
    fired = np.array([[1, 1, 0], [1, 1, 1], [0, 0, 1], [1, 1, 0]])
    assert t.unnested([" trash ", " tras", " garbage "], fired) == [0, 2]
