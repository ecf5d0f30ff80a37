import random
import re
from collections import Counter

import numpy as np

from tidemark.llm import quality


def brute(x):
    x = x or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [s for s in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w))


def test_counts_equal_brute_force_and_junk_goes(docs):
    r = random.Random(5)
    voc = ["word%s" % "abcdefgh"[i % 8] * (1 + i % 3) for i in range(200)]
    say = lambda n: " ".join(r.choices(voc, k=n)).capitalize() + "."
    rows = [(i, "\n".join(say(r.randint(8, 20)) for _ in range(r.randint(2, 12))), r.choice(["en", "de", None]), r.choice(["a", "b", None, "c" + str(i)])) for i in range(300)]
    rows += [(1000 + i, " ".join(w + "***#" for w in r.choices(voc, k=80))) for i in range(5)]
    rows += [(2000, ""), (2001, None), (2002, "a b c d e a b c d e x y z"), (2003, "l1\n\n l1\nl1\n \nl1"), (2004, "same words " * 20_000), (2005, "é b " * 12), (2005, "é b " * 12)]
    got = {}
    for x in quality.quality_verdicts(docs(rows)).collect():
        got[x.doc_id] = x
    for d, text, *_ in rows:
        g = got[d]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == brute(text), d
        assert not (g.base_failed and g.kept)
    assert all(got[d].kept for d in range(300)) and not any(got[1000 + i].kept for i in range(5))


def test_small_groups_read_the_estimates_of_large_ones(docs):
    r = random.Random(6)
    voc = ["word%s" % "abcdefgh"[i % 8] * (1 + i % 3) for i in range(200)]
    good = lambda: "\n".join(" ".join(r.choices(voc, k=r.randint(8, 20))).capitalize() + "." for _ in range(r.randint(2, 12)))
    junk = lambda: " ".join(w + "***#" for w in r.choices(voc, k=80))
    rows = [(i, good(), "en", "web") for i in range(120)] + [(200 + i, good(), "de", "web") for i in range(60)]
    small = [("en", "rare"), ("en", None), ("de", "rare"), ("fr", "web"), (None, None)]
    rows += [(1000 + i, junk(), *x) for i, x in enumerate(small)] + [(2000 + i, good(), *x) for i, x in enumerate(small)]
    kept = {x.doc_id: x.kept for x in quality.quality_verdicts(docs(rows)).collect()}
    assert kept == {x[0]: not 1000 <= x[0] < 2000 for x in rows}


def test_a_cluster_of_outliers_is_found(docs):
    """A fifth of a group is junk of one kind: it would pull the group's mean, but not its medians."""
    r = random.Random(7)
    voc = ["word%s" % "abcdefgh"[i % 8] * (1 + i % 3) for i in range(200)]
    good = lambda: "\n".join(" ".join(r.choices(voc, k=r.randint(8, 20))).capitalize() + "." for _ in range(r.randint(2, 12)))
    rows = [(i, good(), "en", "web") for i in range(200)] + [(1000 + i, " ".join(w.upper() + "***#" for w in r.choices(voc, k=r.randint(70, 90))), "en", "web") for i in range(50)]
    kept = {x.doc_id: x.kept for x in quality.quality_verdicts(docs(rows)).collect()}
    assert all(not kept[1000 + i] for i in range(50)) and sum(kept[i] for i in range(200)) >= 198


def test_estimates_are_those_of_the_least_determinant(spark):
    """On small groups, against concentration from many random starts in numpy: the kept rows' determinant is as small."""
    r = np.random.default_rng(1)
    for seed in range(3):
        x = r.normal(size=(60, 5)) @ r.normal(size=(5, 5)) * 0.3
        x[:12] += r.normal(size=5) * 4
        rows = spark.createDataFrame([(i, "g", *map(float, v)) for i, v in enumerate(x)], "i int, g string, " + ", ".join(f"{f} double" for f in quality.FEATURES))
        d2 = np.array([v.d2 for v in quality.robust_distance(rows, ["g"]).orderBy("i").collect()])
        floor = np.diag([quality.FLOOR[f] ** 2 for f in quality.FEATURES])
        size = lambda rows: np.linalg.slogdet(np.cov(rows.T, bias=True) + floor)[1]  # noqa: E731, B023
        best = np.inf
        for _ in range(200):
            some = x[r.choice(60, 8, replace=False)]
            for _ in range(20):
                z = x - some.mean(0)
                far = np.einsum("ij,jk,ik->i", z, np.linalg.inv(np.cov(some.T, bias=True) + floor), z)
                some = x[np.argsort(far)[:45]]
            best = min(best, size(some))
        assert size(x[np.argsort(d2)[:45]]) <= best + 0.05 and (d2[:12] > 30).all()


def test_empty_table(docs):
    assert quality.quality_verdicts(docs([(1, "a")]).limit(0)).collect() == []
