"""Packing documents into token sequences by the sum-of-squares rule, in two rounds.

Every input partition is packed as a stream of its own, where its rows are read: the only state is the level array
(how many windows stand partly filled at each level, and which), so any number of executors work at once. What stands in
open windows when a partition ends is packed again in fewer, longer streams. A lost executor's partition is packed again
from its input, with the same result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Lower-cased text made of these characters alone (white space, printable ASCII, Latin-1 letters), without the mark of special
#: tokens, is cut into the tokenizer's own pre-tokens by one pattern.
PLAIN = bytes([*range(9, 14), *range(32, 127), *(k for k in range(0xC0, 0x100) if k not in (0xD7, 0xF7))])
PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\sa-zß-öø-ÿ0-9]+")
CACHE = 400_000
#: Tokens of a stream of the second round: its open windows, about a million tokens at most, are a small part of it.
STREAM = 8_000_000
_encoders: dict[str, Callable[[str], bytes]] = {}


def plain(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, PLAIN) and "<|" not in text
    except UnicodeEncodeError:
        return False


def encoder(path: str) -> Callable[[str], bytes]:
    """text -> its ids as little-endian unsigned 32-bit bytes, without special tokens added.

    A pre-token's ids do not depend on its neighbours, so each distinct one is encoded once and kept (the memory is
    bounded: the store is emptied when it is full). Texts with other characters go to the tokenizer whole.
    """
    if path in _encoders:
        return _encoders[path]
    from tokenizers import Tokenizer, pre_tokenizers

    whole, by_word = Tokenizer.from_file(path), Tokenizer.from_file(path)
    by_word.normalizer = None
    by_word.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    vocabulary = whole.get_vocab()
    last = np.zeros(max(vocabulary.values()) + 1, bool)
    last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
    pieces: dict[str, bytes] = {}
    known: dict[str, bytes] = {}

    def learn(fresh: list[str]) -> None:
        for at in range(0, len(fresh), 200):
            some = fresh[at : at + 200]
            ids = np.array(by_word.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(last[ids]) + 1
            if len(ends) != len(some):  # a piece without a closing token: one by one
                pieces.update((w, np.array(by_word.encode(w, add_special_tokens=False).ids, "<u4").tobytes()) for w in some)
                continue
            raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
            pieces.update((w, raw[a:b]) for w, a, b in zip(some, cuts, cuts[1:]))

    def encode(text: str) -> bytes:
        if not plain(text):
            return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        found = text.lower().split()
        try:
            return b"".join([known[w] for w in found])
        except KeyError:
            if len(known) > CACHE or len(pieces) > CACHE:
                known.clear()
                pieces.clear()
            new = {w: PIECES.findall(w) for w in set(found).difference(known)}
            learn(list({p for ps in new.values() for p in ps}.difference(pieces)))
            known.update((w, b"".join([pieces[p] for p in ps])) for w, ps in new.items())
            return b"".join([known[w] for w in found])

    _encoders[path] = encode
    return encode


class Levels:
    """The level array: counts of partly filled windows by fill, and the windows themselves (their pieces)."""

    def __init__(self, size: int):
        self.size, self.count, self.open = size, np.zeros(size + 1, np.int64), {}

    def place(self, piece: tuple, length: int) -> list | None:
        """Put a piece where the sum of squared counts grows least; a window that is full thereby is returned."""
        if length >= self.size:
            return [piece]
        c, at = self.count, 0
        h = np.flatnonzero(c[1 : self.size - length + 1]) + 1  # levels with an open window that the piece fits
        if len(h):
            rise = 2 * (c[h + length] - c[h]) + 2  # one window more at level h + length, one fewer at h ...
            if h[-1] + length == self.size:
                rise[-1] -= 1  # ... and none more when full
            k = int(rise.argmin())
            if rise[k] <= 2 * c[length] + 1:
                at = int(h[k])
        window = self.open[at].pop() if at else []
        if at:
            c[at] -= 1
        window.append(piece)
        if at + length == self.size:
            return window
        c[at + length] += 1
        self.open.setdefault(at + length, []).append(window)
        return None

    def rest(self) -> list[tuple]:
        """The pieces of all windows still open, fullest windows first."""
        return [p for level in sorted(self.open, reverse=True) for w in self.open[level] for p in w]


def packed(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of documents placed in sequences of at most `size` tokens, one row a piece (SCHEMA).

    A document is the ids of its text (null: none) and `end_id`. A document longer than a window gives whole windows
    first; what remains is one piece. Pieces are placed by the sum-of-squares rule. Windows still open when a partition ends are taken
    apart, and their pieces packed by the same rule again, in streams of about STREAM tokens. What these leave open is
    joined and cut anew at `size`, and the last remainder of a stream is cut at powers of two, so nothing is padded.
    Texts of any length are taken whole. Repeated rows are packed each on their own; an empty table gives no rows; other columns are not read.
    """
    kept = f"{SCHEMA}, ids binary"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()

        def pieces() -> Iterator[tuple]:
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    raw = encode(text or "") + end
                    for start in range(0, len(raw) // 4, size):
                        yield doc, start, raw[4 * start : 4 * (start + size)], len(raw) // 4

        yield from _stream(pieces(), size, kept, 0, joined=False)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(4))))
        yield from _stream(pieces, size, SCHEMA, 1 << 62, joined=True)

    ids = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    placed = written(ids.mapInArrow(first, kept), "packed")
    left = placed.where("ids is not null")
    tokens = left.agg(F.sum("length")).first()[0] or 0
    streams = left.select("doc_id", "start", "ids", "doc_tokens", "sequence_id").repartition(-(-tokens // STREAM) or 1, "sequence_id").sortWithinPartitions("sequence_id")
    return placed.where("ids is null").drop("ids").unionByName(streams.drop("sequence_id").mapInArrow(second, SCHEMA))


def _stream(pieces: Iterator[tuple], size: int, schema: str, base: int, joined: bool) -> Iterator[pa.RecordBatch]:
    """Rows of full windows of a stream of pieces (doc_id, start, ids, tokens of the document), and of what stays open at its end.

    The latter is joined and cut, or given back as pieces with their ids, each with a number of its own in place of a sequence.
    """
    levels, number = Levels(size), base | TaskContext.get().partitionId() << 40
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.binary() if c.endswith("binary") else pa.int64() for c in schema.split(", ")]
    out: list[tuple] = []

    def close(window: list[tuple], keep: bool = False) -> None:
        nonlocal number
        offset = 0
        for doc, start, raw, total in window:
            out.append((doc, start, len(raw) // 4, zlib.crc32(raw), total, number, offset, raw if keep else None))
            offset += len(raw) // 4
        number += 1

    def rows() -> pa.RecordBatch:
        made = [pa.array(column, kind) for column, kind in zip(zip(*out), kinds)]
        out.clear()
        return pa.RecordBatch.from_arrays(made, names)

    for piece in pieces:
        if full := levels.place(piece, len(piece[2]) // 4):
            close(full)
        if len(out) >= 20_000:
            yield rows()
    left = levels.rest()
    if not joined:
        for piece in left:
            close([piece], keep=True)
            if len(out) >= 2_000:
                yield rows()
    else:
        window, room, tokens = [], size, sum(len(p[2]) // 4 for p in left)
        for doc, start, raw, total in left:
            while raw:
                if room == size and not window and tokens < size:
                    room = 1 << (tokens.bit_length() - 1)
                part, raw = raw[: 4 * room], raw[4 * room :]
                window.append((doc, start, part, total))
                start, room, tokens = start + len(part) // 4, room - len(part) // 4, tokens - len(part) // 4
                if not room:
                    close(window)
                    window, room = [], size
    if out:
        yield rows()
