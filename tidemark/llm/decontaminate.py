"""Benchmark decontamination: pigeonhole pieces found exactly, then Myers' bit-parallel distance over the window around them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, item_id long, distance int, start long, end long, text_hash long"
#: Characters of normalised items that one pass carries to the executors; more items are searched in more passes.
BLOCK_CHARS = 4_000_000
#: Fewest words of an item that is searched for: fewer (one or two) are found in ordinary text by chance.
LEAST_WORDS = 3
#: Letters of scripts written without spaces: each counts as a word, and no boundary is asked for beside one.
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_OTHER = re.compile(r"[\W_]+")
_searchers: dict[int, object] = {}


def normal(text: str) -> str:
    """Lower case, with every run of characters that are neither letters nor digits as one space; no space at the ends."""
    return _OTHER.sub(" ", text.lower()).strip()


def places(text: str) -> list[int]:
    """For each character of normal(text), the place in text it comes from."""
    out: list[int] = []
    gap = False
    for at, c in enumerate(text):
        for x in c.lower():
            if _OTHER.match(x):
                gap = bool(out)
            else:
                if gap:
                    out.append(at - 1)
                gap = False
                out.append(at)
    return out


def n_words(item: str) -> int:
    """Words of a normalised text."""
    return len(_UNSPACED.sub(" x ", item).split())


def bounded(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] has no part of a word beside it."""
    left = start == 0 or text[start - 1] == " " or bool(_UNSPACED.match(text[start]))
    return left and (end == len(text) or text[end] == " " or bool(_UNSPACED.match(text[end - 1])))


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 consecutive pieces of near-equal length: any text within that many edits of the item has one unchanged."""
    n = errors + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def distance_in(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to any substring of text, where the first such substring ends), bit-parallel."""
    m = len(pattern)
    ones, high = (1 << m) - 1, 1 << (m - 1)
    equal: dict[str, int] = {}
    for i, c in enumerate(pattern):
        equal[c] = equal.get(c, 0) | 1 << i
    up, down, score, best, end = ones, 0, m, m, 0
    for at, c in enumerate(text, 1):
        eq = equal.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = (down | ~(xh | up)) & ones
        mh = up & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, end = score, at
        ph, mh = (ph << 1) & ones, (mh << 1) & ones
        up = (mh | ~(xv | ph)) & ones
        down = ph & xv
    return best, end


class Searcher:
    """One block of items: an automaton over all their pieces. Items under min_chars are to be found unchanged, as whole words."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, min_chars: int):
        import ahocorasick

        self.min_chars, self.trie = min_chars, ahocorasick.Automaton()
        self.items = [(i, t, int(len(t) * error_rate) if len(t) >= min_chars else 0) for i, t in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, errors) in enumerate(self.items):
            for at, piece in pieces(text, errors):
                found.setdefault(piece, []).append((k, at))
        for piece, where in found.items():
            self.trie.add_word(piece, (len(piece), where))
        self.trie.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of the best place of every item that lies in a normalised text."""
        windows: dict[int, list[list[int]]] = {}
        short: dict[int, int] = {}
        for last, (n, where) in self.trie.iter(text):
            for k, at in where:
                _, item, errors = self.items[k]
                if len(item) < self.min_chars:
                    if k not in short and bounded(text, last + 1 - n, last + 1):
                        short[k] = last + 1
                    continue
                low = max(0, last + 1 - n - at - errors)
                high = last + 1 - n - at + len(item) + errors
                own = windows.setdefault(k, [])
                if own and low <= own[-1][1]:
                    own[-1] = [min(own[-1][0], low), max(own[-1][1], high)]
                else:
                    own.append([low, high])
        for k, end in short.items():
            name, item, _ = self.items[k]
            yield name, 0, end - len(item), end
        for k, spans in windows.items():
            name, item, errors = self.items[k]
            best = min((distance_in(item, text[a:b]) + (a,) for a, b in spans), key=lambda x: x[0])
            if best[0] <= errors:
                end = best[2] + best[1]
                back = text[max(0, end - len(item) - errors) : end][::-1]
                yield name, best[0], end - distance_in(item[::-1], back)[1], end


def contaminated(docs: DataFrame, items: DataFrame, error_rate: float = 0.06, min_chars: int = 40, id_column: str = "doc_id", text_column: str = "text", item_id_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """One row for every document and benchmark item it holds: doc_id, item_id, distance, start, end (places in the text), text_hash.

    Both texts are lower-cased and every run of characters other than letters and digits is one space. An item lies in a
    document when some part of the document is within floor(error_rate * item length) edits of it. An item of fewer than
    `min_chars` normalised characters must be there unchanged and as whole words, as an edit may make another question of it;
    one of fewer than LEAST_WORDS words says too little to be told from ordinary text and is not searched for.

    The items are the stated query set: they go to the executors in blocks of at most BLOCK_CHARS characters, one pass over the
    documents a block, each document whole and in its own row, without a shuffle. Null and empty texts hold nothing and are held
    by nothing; repeated rows answer each for itself, told apart by text_hash (xxhash64 of the text) where they share an id. Of places
    at equal distance the first counts. Texts of any length are searched whole, in time in proportion to them.
    """
    named = items.select(F.col(item_id_column).cast("long").alias("item_id"), F.col(item_text_column).cast("string").alias("text")).where("text is not null")
    blocks = -(-(named.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS)
    text = F.col(text_column).cast("string")
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")
    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"), plain.alias("plain"), F.xxhash64(text).alias("text_hash")).where("plain is not null")
    found = None
    for block in range(max(1, blocks)):
        part = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks))) == block).collect()
        known = [(r[0], t) for r in part if len(t := normal(r[1])) >= min_chars or n_words(t) >= LEAST_WORDS]
        one = slim.mapInArrow(_search(known, error_rate, min_chars), SCHEMA)
        found = one if found is None else found.unionByName(one)
    return found


def _search(items: list[tuple[int, str]], error_rate: float, min_chars: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(items, error_rate, min_chars) if items else None
        for batch in batches:
            out = []
            for row, plain in enumerate(batch.column(2).to_pylist()):
                if searcher and any(searcher.find(plain)):  # few texts: found again with places in the text itself
                    doc, text, key = (batch.column(k)[row].as_py() for k in (0, 1, 3))
                    at = places(text)
                    out += [(doc, item, d, at[a], at[b - 1] + 1, key) for item, d, a, b in searcher.find(normal(text))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int32() if k == 2 else pa.int64()) for k in range(6)], ["doc_id", "item_id", "distance", "start", "end", "text_hash"])

    return search


def without_contaminated(docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Documents that have no row in found, told by id (null too) and text: a clean row stays where another of its id goes."""
    gone = found.select(F.col("doc_id").alias("_found"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(gone, docs[id_column].eqNullSafe(gone["_found"]) & (F.xxhash64(docs[text_column]) == gone["_hash"]), "left_anti")
