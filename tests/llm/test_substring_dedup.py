import random
import re

import pytest

from tidemark.llm import substring_dedup as s


def cut_up(text):
    """[(lower-case words)] of each sentence, by a splitter of its own: at stops that no letter or digit follows, and at new lines."""
    parts = [re.findall(r"\w+", p) for p in re.split(r"(?<=[.!?])(?!\w)|\n", text)]
    return [[w.lower() for w in p] for p in parts if p]


def brute(rows, several=3):
    """{(doc_id, text): words that go} by the runs of sentences alone, from word tuples: no hash, no array, no cut of the operator."""
    first, gone = {}, {}
    for d, x in sorted({(d, x or "") for d, x in rows}, key=lambda r: (r[0] is not None, r[0] or 0, key(r[1]))):
        cut = cut_up(x)
        at = [sum(map(len, cut[:k])) for k in range(len(cut) + 1)]
        for i in range(len(cut) - several + 1):
            run = tuple(w for p in cut[i : i + several] for w in p)
            if run in first:
                gone.setdefault((d, x), set()).update(range(at[i], at[i + several]))
            else:
                first[run] = (d, x, i)
    return gone


def key(text):
    """The hash that orders texts of one id."""
    return KEYS[text]


KEYS: dict = {}


def learn(spark, rows):
    from pyspark.sql import functions as F

    KEYS.update({r.t: r.h for r in spark.createDataFrame([(x or "",) for _, x in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()})


def corpus():
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randint(2, 8)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    text = lambda k: " ".join(sentence(r.randint(4, 14)) for _ in range(k))
    shared = [text(6), sentence(60), "\n".join(sentence(11) for _ in range(5))]
    rows = [(i, text(8)) for i in range(40)]
    rows += [(100 + i, text(4) + "\n" + shared[i % 3] + "\n" + text(3)) for i in range(12)]
    rows += [(200, rows[5][1]), (201, None), (202, ""), (203, "No. Yes. No."), (204, "No. Yes. No."), (205, ("One two three. " * 4000))]
    # Repeated and null ids: unique texts, copies, and rows that are one document.
    rows += [(5, text(9)), (300, rows[7][1]), (300, text(9)), (None, text(9)), (None, rows[50][1]), (None, text(7)), (9, rows[9][1]), (301, text(8)), (301, text(8))]
    rows += [rows[-1]]
    return rows, shared


def test_equal_brute_force(docs, spark):
    rows, shared = corpus()
    learn(spark, rows)
    got = s.repeated_spans(docs(rows), passage_words=0).collect()
    want = brute(rows)
    texts = {}
    for d, x in set(rows):
        texts.setdefault(d, []).append(x or "")
    seen = set()
    for x in got:
        for text in texts[x.doc_id]:
            left, at = "", 0
            for a, b in x.spans:
                left, at = left + text[at:a], b
            if left + text[at:] == x.text and (x.doc_id, text) in want:
                words = [w for a, b in x.spans for w in re.findall(r"\w+", text[a:b])]
                assert len(words) == len(want[x.doc_id, text])
                seen.add((x.doc_id, text))
    assert seen == set(want) and len(got) == len(want)
    assert {(d, x) for d, x in want if d in (5, 9, 301)} == set()  # unique text of a repeated id, and rows that are one, stay
    assert (300, rows[7][1]) in want and not any(d is None for d, x in want)  # rows without an id come first ...
    assert (110, rows[50][1]) in want  # ... so the row that shares its text with one is the copy


def test_passages_in_the_middle_of_sentences(docs):
    r = random.Random(3)
    voc = ["".join(r.choices("abcdefghijklmnopqrst", k=r.randint(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(w + r.choice([""] * 9 + ["."]) for w in r.choices(voc, k=n))
    for n, least in ((51, 0.93), (75, 0.99)):
        rows, passages = [], []
        for i in range(150):
            passages.append(prose(n).rstrip("."))
            rows += [(2 * i, f"{prose(30)} {passages[-1]} {prose(30)}"), (2 * i + 1, f"{prose(25)} {passages[-1]} {prose(41)}")]
        got = {x.doc_id: x for x in s.repeated_spans(docs(rows)).collect()}
        assert all(d % 2 for d in got) and len(got) >= least * 150
        removed = [sum(len(re.findall(r"\w+", rows[d][1][a:b])) for a, b in x.spans) / n for d, x in got.items()]
        assert sum(removed) / len(removed) > 0.75 and max(removed) <= 1.0


@pytest.mark.parametrize("text", ['A b. "C d!" e f\n\ng (h). … i? ' + "long " * 90 + "end", "你好。世界！ok 3.14 x", "\U0001f600", "a", ". . ."])
def test_sentences_cover_the_words(text):
    cut = s.sentences(text)
    said = re.findall(r"[㐀-鿿]|[^\W㐀-鿿]+", text)
    if cut is None:
        assert not said
        return
    assert cut.bounds()[-1] == cut.bounds(s.CUT)[-1] == len(said) == len(cut.words) and all(a < b for a, b in zip(cut.start, cut.end)) and all(b <= a for a, b in zip(cut.start[1:], cut.end))


def made_prose(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 9)))
    return r, lambda n: " ".join(word() for _ in range(n)).capitalize() + "."


def test_short_sentences_go_and_a_lone_long_one_stays(docs):
    """Four repeated sentences of five words are found in every copy; one repeated sentence of 60 words is not several."""
    r, sentence = made_prose(5)
    own = lambda: " ".join(sentence(r.randint(4, 12)) for _ in range(5))
    short, lone = " ".join(sentence(5) for _ in range(4)), [sentence(60) for _ in range(40)]
    rows = [(k, f"{own()} {short} {own()}") for k in range(201)] + [(1000 + k, f"{own()} {lone[k % 40]} {own()}") for k in range(200)] + [(5000 + k, own()) for k in range(100)]
    got = {x.doc_id: x for x in s.repeated_spans(docs(rows), passage_words=0).collect()}
    assert set(got) == set(range(1, 201)) and all(x.n_removed == 4 and short not in x.text for x in got.values())
    both = {x.doc_id: x for x in s.repeated_spans(docs(rows)).collect()}
    assert set(range(1, 201)) <= set(both) and not any(d >= 5000 or d == 0 or 1000 <= d < 1040 for d in both)
    # The second pass takes the 60 words for what they are, a repeated passage, where they hold three pieces.
    assert sum(d > 1000 for d in both) > 0.4 * 160


def test_empty_table(docs):
    assert s.repeated_spans(docs([(1, "a")]).limit(0)).collect() == []


def test_runs_are_not_written(docs, monkeypatch):
    """What goes to disk are the runs that repeat and what they cover, not every run."""
    sizes = {}

    def counted(df, name):
        sizes[name] = df.count()
        return df

    monkeypatch.setattr(s, "written", counted)
    rng = random.Random(4)
    own = [" ".join(f"w{rng.randrange(10**6)} x{rng.randrange(10**6)}." for _ in range(60)) for _ in range(8)]
    same = "One two three. Four five six. Seven eight nine. "
    assert s.repeated_spans(docs([(k, same + t) for k, t in enumerate(own)])).count() == 7
    assert sum(sizes.values()) < 60
