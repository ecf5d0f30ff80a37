import random

from tidemark.llm import decontaminate as d


def brute_distance(p, t):
    row = list(range(len(p) + 1))
    best, end = len(p), 0
    for at, c in enumerate(t, 1):
        new = [0]
        for i, x in enumerate(p, 1):
            new.append(min(row[i - 1] + (x != c), row[i] + 1, new[-1] + 1))
        row = new
        if row[-1] < best:
            best, end = row[-1], at
    return best, end


def test_bit_parallel_distance_is_edit_distance():
    r = random.Random(1)
    for _ in range(200):
        p = "".join(r.choices("abc", k=r.randint(1, 40)))
        t = "".join(r.choices("abc", k=r.randint(0, 60)))
        assert d.distance_in(p, t) == brute_distance(p, t)


def test_leaks_found_and_clean_left(docs, spark):
    r = random.Random(2)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 8)))
    say = lambda n: " ".join(word() for _ in range(n))
    items = [(i, say(30)) for i in range(20)] + [(50, None), (51, ""), (52, "short one")]
    rows, want = [], set()
    for i in range(60):
        text = say(100)
        if i % 3 == 0:
            item = items[i % 20][1]
            cut = list(item)
            for _ in range(int(len(d.normal(item)) * 0.06) - 1 if i % 2 else 0):
                cut[r.randrange(len(cut))] = r.choice("xyz")
            text = text + "!\n" + "".join(cut).upper().replace(" ", ",  ") + ".\n" + say(50)
            want.add((i, i % 20))
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, "short one"), (103, "é " * 30_000)]
    got = d.contaminated(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in got} >= want and {x.doc_id for x in got} == {i for i, _ in want}
    text = dict(rows)
    for x in got:
        item = d.normal(dict(items)[x.item_id])
        assert d.distance_in(item, d.normal(text[x.doc_id][x.start : x.end]))[0] == x.distance <= len(item) * 0.06
    kept = {x.doc_id for x in d.without_contaminated(docs(rows), d.contaminated(docs(rows), spark.createDataFrame(items, "item_id long, text string"))).collect()}
    assert kept == set(text) - {i for i, _ in want}


def test_short_items_are_found_as_whole_words(docs, spark):
    items = spark.createDataFrame([(1, "Who wrote Hamlet?"), (2, "art of war"), (3, "Why so?"), (4, "誰が書いた"), (5, "What is 12 plus 17?")], "item_id long, text string")
    rows = [(1, "Q: who  wrote “Hamlet” A: he"), (2, "who wrote hamlets"), (3, "Art of War."), (4, "start of war, the art of wars"), (5, "why so? why so?"), (6, "昔、誰が書いたのか"), (7, "what is 12 plus 18"), (8, "start of war; art of war")]
    got = {(x.doc_id, x.item_id): (x.distance, dict(rows)[x.doc_id][x.start : x.end]) for x in d.contaminated(docs(rows), items).collect()}
    assert got == {(1, 1): (0, "who  wrote “Hamlet"), (3, 2): (0, "Art of War"), (6, 4): (0, "誰が書いた"), (8, 2): (0, "art of war")}


def test_repeated_piece_does_not_cut_the_window(docs, spark):
    r = random.Random(3)
    p = ["".join(r.choices("abcdefgh", k=16)) for _ in range(4)]
    item = p[0] + p[1] + p[2] + p[0] + p[3]
    leak = "".join(x if k == 3 else x[:8] + "z" + x[9:] for k, x in enumerate((p[0], p[1], p[2], p[0], p[3])))
    got = d.contaminated(docs([(1, "before " + leak + " after")]), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(x.doc_id, x.item_id, x.distance, x.start, x.end) for x in got] == [(1, 7, 4, 7, 87)]


def test_many_blocks_find_the_same(docs, spark, monkeypatch):
    items = spark.createDataFrame([(i, f"item number {i} has its own words like w{i * 7919} and w{i * 104729} in it") for i in range(12)], "item_id long, text string")
    rows = docs([(i, f"before. Item number {i} has its own words like w{i * 7919} and w{i * 104729} in it") for i in range(0, 12, 2)])
    one = {tuple(x) for x in d.contaminated(rows, items).collect()}
    monkeypatch.setattr(d, "BLOCK_CHARS", 200)
    assert {tuple(x) for x in d.contaminated(rows, items).collect()} == one and len({x[0] for x in one}) == 6


def test_empty_tables(docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated(docs([(1, "a")]), none).collect() == [] and d.contaminated(docs([(1, "a")]).limit(0), none).collect() == []
