import itertools
import random
import re

import numpy as np

from tidemark.llm import near_dup


def brute(rows, k, percent):
    sets, root = {}, {}
    for d, x in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        root[d] = d
    top = lambda x: x if root[x] == x else top(root[x])
    for a, b in itertools.combinations(sorted(sets), 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= percent * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d), top(d) == d) for d in sets}


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)]
    rows = [(i, " ".join(r.choices(vocabulary, k=r.randint(1, 120)))) for i in range(60)]
    base = r.choices(vocabulary, k=150)
    for i in range(60, 160):  # a cloud of near copies, some linked only through others
        w = list(base)
        for _ in range(r.randint(0, 14)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((i, " ".join(w)))
    rows += [(200, rows[3][1].upper()), (201, rows[3][1]), (202, ""), (203, None), (204, "  \n"), (205, "One two"), (206, "one  TWO"), (207, "x " * 40_000)]
    return rows


def test_groups_equal_brute_force(docs, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    monkeypatch.setattr(near_dup, "FEW", 3)
    for k, share in ((3, 0.85), (5, 0.8)):
        rows = corpus(k)
        got = {r[0]: tuple(r[1:4]) for r in near_dup.near_duplicates(docs(rows), k, share).collect()}
        assert got == brute(rows, k, round(100 * share))


def test_rows_dealt_grow_with_a_hot_group(docs, monkeypatch):
    """Of a group of near copies of one text, rows dealt to blocks grow as the group does, not as its square."""
    monkeypatch.setattr(near_dup, "BLOCK", 32)
    dealt, deal = [], near_dup._dealt
    monkeypatch.setattr(near_dup, "_dealt", lambda rows, *x: dealt.append(rows.count()) or deal(rows, *x))
    r, counts = random.Random(4), []
    base = ["w%d" % r.randrange(500) for _ in range(400)]
    for n in (400, 1600):
        rows = []
        for i in range(n):
            w = list(base)
            w[r.randrange(400)] = "x%d" % i
            rows.append((i, " ".join(w)))
        dealt.clear()
        got = near_dup.near_duplicates(docs(rows), 5, 0.8).collect()
        assert {x.component_id for x in got} == {0} and sum(x.chosen for x in got) == 1
        counts.append(sum(dealt))
    assert counts[1] < 5 * counts[0]


def test_repeated_and_null_ids(docs):
    r = random.Random(5)
    say = lambda: " ".join("w%d" % r.randrange(900) for _ in range(60))
    p, u, v, q = say(), say(), say(), say()
    rows = [(1, p), (5, p), (5, u), (7, u + " tail"), (9, v), (9, v), (None, q), (None, q + " tail"), (None, say()), (3, p + " tail")]
    got = sorted(str((x.doc_id, x.component_id, x.chosen)) for x in near_dup.near_duplicates(docs(rows)).collect())
    assert got == sorted(map(str, [(1, 1, True), (5, 1, False), (5, 5, True), (7, 5, False), (9, 9, True), (9, 9, True), (3, 1, False), (None, None, True), (None, None, True), (None, None, False)]))


def test_empty_table(docs, spark):
    assert near_dup.near_duplicates(docs([(1, "a b c")]).limit(0)).collect() == []


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(1)
    a, b = (np.unique(r.integers(0, 2**63, 3000, np.uint64)) for _ in range(2))
    union = np.unique(np.concatenate((a, b)))
    assert (np.maximum(near_dup.sketch(a), near_dup.sketch(b)) == near_dup.sketch(union)).all()
    near = np.unique(np.concatenate((a[:2900], b[:100])))
    x, y, z = (near_dup.sketch(s)[None] for s in (a, near, b))
    n = np.array([3000.0])
    assert near_dup.likely(x, y, n, n, 0.85)[0] and not near_dup.likely(x, z, n, n, 0.85)[0]


def test_intersections_are_exact():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 400, n).astype(np.uint64)) for n in (1, 5, 50, 300, 300, 2)]
    got = near_dup.intersections(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(6) for j in range(6) if i != j)


def test_components_of_links(spark, monkeypatch):
    """Least reachable nodes, for random links, a chain and a hub; large stars are written without a shuffle to make them distinct."""
    import random

    from tidemark.llm import near_dup

    rng, plans = random.Random(3), []
    real = near_dup.written
    monkeypatch.setattr(near_dup, "written", lambda df, name: (plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), real(df, name))[1])
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(500 + k, 501 + k) for k in range(20)] + [(900, 901 + k) for k in range(50)] + [(7, 7)]
    df = spark.createDataFrame([(a.to_bytes(2, "big"), b.to_bytes(2, "big")) for a, b in links], "a binary, b binary")
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in near_dup.components(df).collect()}
    assert got == {x: top(x) for x in root if top(x) != x}
    assert near_dup.components(df.limit(0)).count() == 0
    assert plans and not any("Aggregate" in p for name, p in plans if name == "large")


def test_blocks_give_stars_that_need_few_rounds(docs, spark, monkeypatch):
    """Stars are done as they come, and a group of near copies in many blocks takes two steps at most each time it is joined."""
    frames, real, join = [], near_dup.written, near_dup.components
    monkeypatch.setattr(near_dup, "written", lambda df, name: (frames.append(name), real(df, name))[1])
    stars = spark.createDataFrame([(bytes([k]), bytes([k % 3])) for k in range(3, 60)] * 2, "a binary, b binary")
    assert {(r.node[0], r.root[0]) for r in near_dup.components(stars).collect()} == {(k, k % 3) for k in range(3, 60)}
    assert frames == ["least"]

    def counted(links):
        frames.clear()
        out = join(links)
        steps.append(sum(name != "least" for name in frames))
        return out

    steps = []
    monkeypatch.setattr(near_dup, "BLOCK", 32)
    monkeypatch.setattr(near_dup, "components", counted)
    r = random.Random(6)
    base = ["w%d" % r.randrange(500) for _ in range(400)]
    rows = [(i, " ".join([*base[:k], "x%d" % i, *base[k:]])) for i in range(400) for k in [r.randrange(400)]]
    assert {x.component_id for x in near_dup.near_duplicates(docs(rows), 5, 0.8).collect()} == {0}
    assert len(steps) == 4 and max(steps) <= 2
