import zlib

import numpy as np
import pytest

from tidemark.llm import packing

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def test_pieces_are_a_round_trip(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    rows = [(1, "Hello, World's end!! 42"), (2, ""), (3, None), (4, "zwölf Straßen É\tà\n" * 900), (5, "Σίσυφος 你好 \x1c<|endoftext|> x"), (6, "ab " * 5000), (7, "it's we'll 'tis can't"), (7, "again")]
    pieces = packing.packed(docs(rows).coalesce(2), PATH, 512).collect()
    ids = {}
    for d, x in rows:
        ids.setdefault(d, []).append(np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4"))
    for d, many in ids.items():
        own = sorted((p for p in pieces if p.doc_id == d), key=lambda p: (p.doc_tokens, p.start))
        assert sum(p.length for p in own) == sum(map(len, many))
        for p in own:
            assert any(len(a) == p.doc_tokens and zlib.crc32(a[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for a in many)
    windows = {}
    for p in pieces:
        windows.setdefault(p.sequence_id, []).append(p)
    for ps in windows.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 512 or at & (at - 1) == 0  # nothing is padded


def test_sum_of_squares_choice():
    levels = packing.Levels(10)
    assert levels.place(("a",), 4) is None and levels.place(("b",), 4) is None
    assert levels.count[4] == 0 and levels.count[8] == 1  # a second window at 4 would raise the squares by more
    assert levels.place(("c",), 2) == [("a",), ("b",), ("c",)]  # filled, so a level has one window fewer
    for _ in range(200):
        levels.place(("x",), 3)
    counts = levels.count
    assert all(len(levels.open.get(h, [])) == counts[h] for h in range(1, 10))


def test_empty_table(docs):
    assert packing.packed(docs([(1, "a")]).limit(0), PATH).collect() == []


def test_open_windows_are_packed_again(docs, monkeypatch):
    """Of many small partitions most tokens come from the rule too, and every id is in one piece."""
    import random

    r = random.Random(2)
    rows = [(i, "word " * r.randint(1, 60)) for i in range(3000)]
    pieces = packing.packed(docs(rows).repartition(12), PATH, 256).collect()
    assert {p.doc_id for p in pieces} == set(range(3000)) and sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)
    windows, cut = {}, {}
    for p in pieces:
        windows[p.sequence_id] = windows.get(p.sequence_id, 0) + p.length
        cut[p.doc_id] = cut.get(p.doc_id, 0) + 1
    assert sum(n == 256 for n in windows.values()) >= len(windows) - 10  # but for the last remainder
    assert sum(n > 1 for n in cut.values()) < 300
