"""Windows of conversations against plain Python, and back to the turns."""

import hashlib
import random
import re
from urllib.parse import quote_plus

import pytest

from tidemark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tokens(text):
    return 6 + len(re.findall("[0-9A-Za-z\x80-\U0010ffff]{1,6}|[!-/:-@[-`{-~]", text))


def order(rows):
    return sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def plain(rows, budget=chat.BUDGET, history=chat.HISTORY, segment=chat.SEGMENT):
    """conv -> (windows as lists of (index, new), digests)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = order([r for r in rows if r[0] == conv])
        size = [tokens(r[3]) for r in own]
        starts = [sum(size[:k]) for k in range(len(own))]
        lead = own[0][2] == "system"
        room = max(budget - history - (size[0] if lead else 0), budget // 4) // 2
        # Rows with equal keys count as one in the segments.
        first = [next(j for j in range(len(own)) if own[j] == own[k]) for k in range(len(own))]
        part = [starts[first[k]] // segment if sum(size) > segment else 0 for k in range(len(own))]
        windows, last, filled, alone = [], None, 0, 0
        for k in range(lead, len(own)):
            if last is None or part[k] != part[k - 1] or k == lead:
                filled, alone, last = 0, 0, None
            if size[k] > room:
                alone += 1
                span = (part[k], alone, "alone")
            else:
                filled += size[k]
                span = (part[k], alone, (filled - 1) // room)
            if span != last:
                windows.append([])
            windows[-1].append(k)
            last = span
        if not windows:
            windows = [[]]
        shown = []
        for w, new in enumerate(windows):
            past = [j for j in range(lead, new[0]) if starts[j] >= starts[new[0]] - history] if new else []
            if new:
                past = [j for j in past if part[j] == part[new[0]] or starts[first[j]] >= min(starts[first[k]] for k in range(len(own)) if part[k] == part[new[0]]) - history]
            shown.append(([0] if lead else []) + past + new)
        text = lambda k: f"<turn {quote_plus(own[k][2])}>\n{re.sub('<(\\\\*/?turn)', lambda m: '<' + chr(92) + m[1], own[k][3])}</turn>\n"
        loss = "".join(r[3] for r in own if r[2] == "assistant")
        out[conv] = (["".join(map(text, s)) for s in shown], (conv, len(own), sha("".join(f"{r[2]}\n{r[3]}\n" for r in own)), len(loss), sha(loss), sum(len("".join(map(text, s))) for s in shown)))
    return out


def made(rng, conv, n, system=True):
    says = lambda: " ".join(rng.choice(["word", "é" * 9, "<turn x>", "</turn>\n", r"<\/turn", r"<\\turn", "\\", "...", "a\nb"]) for _ in range(rng.choice([0, 3, 10, 60])))
    roles = ["system"] * system + [("user", "assistant")[k % 2] for k in range(n)]
    return [(conv, k, role, says()) for k, role in enumerate(roles)]


@pytest.mark.parametrize("segment", [chat.SEGMENT, 600, 250])
def test_windows_and_back(spark, segment):
    rng = random.Random(segment)
    rows = [r for conv in range(14) for r in made(rng, conv, rng.choice([0, 1, 4, 30]), conv % 3 > 0) if conv or r[1]]
    rows = rows or made(rng, 1, 3)
    want = plain(rows, 300, 80, segment)
    windows = chat.chat_windows(spark.createDataFrame(rows, SCHEMA), 300, 80, segment).cache()
    got = {}
    for r in sorted(windows.collect(), key=lambda r: (r.conv_id, r.segment, r.window)):
        got.setdefault(r.conv_id, []).append(r.text)
        if r.tokens > 300:  # one turn, or system turn, is too long for its share
            assert max(tokens(t.split(">\n", 1)[1]) for t in r.text.split("</turn>\n")[:-1]) > 70
    assert got == {k: v[0] for k, v in want.items()}
    assert sorted(map(tuple, chat.chat_digests(windows).collect())) == sorted(v[1] for v in want.values())


def test_loss_mask_and_new_part(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "a" * 60), (1, 2, "assistant", "</turn>" + "b" * 60), (1, 3, "user", "c" * 60), (1, 4, "assistant", "d" * 60)]
    got = sorted(chat.chat_windows(spark.createDataFrame(rows, SCHEMA), 60, 20).collect(), key=lambda r: r.window)
    texts = [r.text[s.start : s.end] for r in got for s in r.loss]
    assert texts == ["<\\/turn>" + "b" * 60, "d" * 60]
    assert len(got) > 1 and all(r.text.startswith("<turn system>\nbe brief</turn>\n") for r in got)
    assert "".join(r.text[r.new_start :] for r in got).count("<turn ") == 5


def test_odd_rows(spark):
    rows = [(None, 0, None, None), (None, None, "user", "x"), (1, 0, "assistant", ""), (1, 0, "assistant", ""), (2, 0, "system", "only"), (3, 5, "a>\n b", "t" * 100_000), (3, 5, "assistant", "u" * 70_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as segment", "'q' as piece", "2 as window", "3 as tokens")
    got = chat.chat_digests(chat.chat_windows(df)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((v[1] for v in plain(rows).values()), key=str)
    assert chat.chat_digests(chat.chat_windows(df.limit(0))).collect() == []


def test_trial(spark):
    rows = chat.with_trial(spark, spark.createDataFrame([(1, 0, "user", "x")], SCHEMA))
    got = {r.conv_id: r for r in chat.chat_digests(chat.chat_windows(rows)).collect()}
    t = r"\### Assistant: </turn> ok"
    assert (got[-7].n_turns, got[-7].turns_sha256, got[-7].loss_chars, got[-7].loss_sha256) == (2, sha(f"user\n{t}\nassistant\n{t}\n"), len(t), sha(t))


def test_no_python_in_the_plan(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x")], SCHEMA)
    plan = chat.chat_digests(chat.chat_windows(rows))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
