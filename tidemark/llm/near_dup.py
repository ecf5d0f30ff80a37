"""Near-duplicate documents by SetSketch registers, banded, estimated jointly by likelihood and verified on full sets.

The work of a group of near copies is never one task's: buckets and groups are cut into blocks of bounded size, which are compared
with themselves and a few leaders of their group first. What that leaves apart is compared block by block, so a group of copies of
one text costs its rows and not their square. A block gives back stars that join what its links join, not the links; as the least
node of a group leads it, stars of most blocks have one centre and need few rounds. Copies with equal shingle sets are one node
from the start. Nothing is collected on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.llm.common import written

REGISTERS = 64
#: SetSketch parameters: register k says the least of the set's exponential draws (rate RATE) lies under BASE ** (1 - k).
BASE, RATE, TOP = 1.001, 20.0, 65_535
#: A candidate pair is dropped only where the similarity asked for is less likely than the best estimate by exp(-DOUBT).
DOUBT = 15.0
#: Rows of one block, and bytes of the shingle sets of one block.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Rows of a group of several blocks that every block of it is compared with first.
LEADERS = 8
#: Most keys of texts (of about 50 bytes each) that are broadcast.
KEYS = 500_000
#: Buckets of so many rows or fewer are compared together.
FEW = 24

_rng = np.random.default_rng(20_251)
_BYTE = _rng.integers(1, 2**64, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_ORD = (_rng.integers(0, 2**63, 64, np.uint64) << np.uint64(1)) | np.uint64(1)
_MULT = (_rng.integers(0, 2**63, REGISTERS, np.uint64) << np.uint64(1)) | np.uint64(1)
_FLIP = _rng.integers(0, 2**64, REGISTERS, np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_POWER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values stirred, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base of the word hash and of its inverse."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_POWER, _INVERSE)):
            all_ = np.full(2 * n + 1, base)
            all_[0] = 1
            _powers[k] = np.cumprod(all_, dtype=np.uint64)
    return _powers[0], _powers[1]


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of a text's words (runs of characters other than space and 09-0D), A-Z as a-z."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    up, down = powers_to(len(raw))
    word = np.concatenate(([False], ~_BLANK[raw], [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[0::2], edge[1::2]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64)))
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of `words` words; of a shorter text, of its whole sequence; none without words."""
    w = word_hashes(text or "")
    k = min(words, len(w))
    if not k:
        return w
    n = len(w) - k + 1
    runs = np.full(n, np.uint64(k))
    for j in range(k):
        runs += w[j : j + n] * _ORD[j]
    return np.unique(mixed(runs))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a non-empty set. Registers of a union are the greater registers: sketches merge."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 2048):
        np.minimum(least, ((shingles[at : at + 2048, None] ^ _FLIP) * _MULT).min(0), out=least)
    draw = -np.log1p(-((least >> np.uint64(11)).astype(float) * 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(draw, 1e-300)) / np.log(BASE)), 0, TOP).astype("<u2")


def bands_for(similarity: float, miss: float = 1e-5) -> int:
    """Registers a band: the most that leave a pair at the similarity unseen with at most the given probability."""
    return max([r for r in range(1, 17) if (1 - similarity**r) ** (REGISTERS // r) <= miss], default=1)


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of sketches (rows of a and b, sets of na and nb) may reach the similarity, by the joint likelihood.

    With shares u, v of the sizes, a register is greater on one side with p(u - vJ), on the other with p(v - uJ), and
    equal else; the three counts give a likelihood of J, compared between its best value and values of at least `similarity`.
    """
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = REGISTERS - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1))

    below = log_likelihood(np.linspace(0, 1, 24) * np.minimum(most, similarity)).max(1)
    above = log_likelihood(similarity + np.linspace(0, 1, 8) * np.maximum(most - similarity, 0)).max(1)
    return (most[:, 0] >= similarity - 1e-9) & (above >= below - DOUBT)


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric 0/1 matrix of links."""
    out, free = [], np.ones(len(links), bool)
    for first in range(len(links)):
        if not free[first]:
            continue
        free[first], queue = False, [first]
        while queue:
            x = queue.pop()
            new = np.flatnonzero(links[x] & free)
            free[new] = False
            out += [(x, y) for y in new.tolist()]
            queue += new.tolist()
    return out


def _pairs(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows inside each of many small groups."""
    left, right = [np.zeros(0, int)], [np.zeros(0, int)]
    for n in np.unique(count[count > 1]).tolist():
        i, j = np.triu_indices(n, 1)
        at = start[count == n][:, None]
        left.append((at + i).ravel())
        right.append((at + j).ravel())
    return np.concatenate(left), np.concatenate(right)


def _trees(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the given links."""
    root: dict[int, int] = {}
    out = []

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    for x, y in zip(left.tolist(), right.tolist()):
        if (a := top(x)) != (b := top(y)):
            root[a] = b
            out.append((x, y))
    return out


def _stars(links: Iterable[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    """(q, a, b) -> (a, b, q): every node that links of equal q join to a lesser one, with the least of those."""
    root: dict[tuple[int, bytes], tuple[int, bytes]] = {}

    def top(x: tuple[int, bytes]) -> tuple[int, bytes]:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for q, a, b in links:
        x, y = top((q, a)), top((q, b))
        root[max(x, y)] = min(x, y)
    out = [(x[1], y[1], x[0]) for x in list(root) if (y := top(x)) != x]
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.binary(), pa.binary(), pa.int32()))], ["a", "b", "_q"])


def _likely_forest(regs: np.ndarray, size: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the likely pairs among sketches: pairs with most equal registers first, and only between trees."""
    n = len(regs)
    low, equal = (regs & 0xFF).astype(np.uint8), np.zeros((n, n), np.uint8)
    for r in range(REGISTERS):  # of the low bytes, so never fewer than there are
        equal += low[:, r, None] == low[:, r]
    fits = np.minimum(size[:, None], size) >= similarity * np.maximum(size[:, None], size) - 1e-9
    np.fill_diagonal(fits, False)
    label = np.arange(n)
    out: list[tuple[int, int]] = []
    x, y = np.nonzero(np.triu(fits & (equal >= similarity * REGISTERS - 7 * (similarity * (1 - similarity) * REGISTERS) ** 0.5), 1))
    order = np.argsort(-equal[x, y].astype(int), kind="stable")
    x, y = x[order], y[order]
    while len(x):
        ok = likely(regs[x[:4096]], regs[y[:4096]], size[x[:4096]], size[y[:4096]], similarity)
        for i, j in zip(x[:4096][ok].tolist(), y[:4096][ok].tolist()):
            if (a := label[i]) != (b := label[j]):
                label[label == max(a, b)] = min(a, b)
                out.append((i, j))
        x, y = x[4096:], y[4096:]
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    return out


def _grouped(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 10_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of whole groups (equal in the first `keys` columns), with where each group starts."""
    rest: pa.Table | None = None

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(len(t), bool)
        new[:1] = True
        for k in range(keys):
            c = t.column(k).combine_chunks().dictionary_encode()
            c = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).indices.to_numpy(zero_copy_only=False)
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if len(rest) >= rows:
            at = starts(rest)
            if len(at) > 1:
                yield rest.slice(0, at[-1]), at[:-1]
                rest = rest.slice(at[-1])
    if rest is not None and len(rest):
        yield rest, starts(rest)


def _dealt(rows: DataFrame, group: str, payload: list[str]) -> DataFrame:
    """Rows with their block numbers _p and _q, each block of a group (equal in group, _p and _q) in one task and in order."""
    # A stated number of partitions: the rows are few bytes but much work, so Spark shall not put them together.
    many = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(group, "_p", "_q", "node", *payload).repartition(many, group, "_p", "_q").sortWithinPartitions(group, "_p", "_q")


def _block(count: Column) -> Column:
    return F.pmod(F.xxhash64("node"), count).cast("int")


def forest(rows: DataFrame, group: str, load: Callable[[DataFrame, DataFrame | None], DataFrame], payload: list[str], find: Callable, blocks: Column) -> DataFrame:
    """(a, b): links that join what the links of every group join, each found inside a block by `find`.

    rows: group, node, _blocks (how many blocks the group's rows fill) and what `blocks`, the aggregate that says this of any rows, needs;
    load(rows, nodes) adds the payload, where nodes lists the nodes in rows if they are few. First every block is compared with itself and
    the group's LEADERS (rows of least node in as many parts of it; _q is 1 where the group has several blocks). In a group of several blocks, rows that are then in one
    component need no comparison; the largest component's blocks are compared with the blocks of all other rows, and those
    with each other. A row is so dealt once, and as often as its group has blocks of rows apart: none in a group of copies of one text.
    """
    hot = rows.where("_blocks > 1")
    own = rows.withColumns({"_p": _block(F.col("_blocks")), "_q": (F.col("_blocks") > 1).cast("int")})
    least = hot.groupBy(group, F.pmod(F.xxhash64("node", F.lit(1)), F.lit(LEADERS)).alias("_k")).agg(F.min("node").alias("node")).drop("_k")
    leaders = hot.join(written(least, "leaders"), [group, "node"])
    lead = leaders.withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumn("_q", F.lit(1)).where(F.col("_p") != _block(F.col("_blocks")))
    first = written(_dealt(load(own.unionByName(lead), None), group, payload).mapInArrow(find, "a binary, b binary, _q int"), "first-links")
    if not hot.head(1):
        return first.select("a", "b")
    inside = components(first.where("_q = 1"))
    labelled = hot.drop("_blocks").join(inside, "node", "left").withColumn("_c", F.coalesce("root", "node")).drop("root")
    parts = written(labelled.groupBy(group, "_c").agg(F.count("*").alias("_n"), blocks.alias("_of")), "parts")
    largest = parts.groupBy(group).agg(F.max(F.struct("_n", "_of", "_c")).alias("_x"), F.sum("_of").alias("_all"), F.count("*").alias("_parts")).where("_parts > 1")
    largest = largest.select(group, F.col("_x._c").alias("_most"), F.ceil("_x._of").cast("int").alias("_big"), F.ceil(F.col("_all") - F.col("_x._of")).cast("int").alias("_rest"))
    left = written(labelled.join(largest, group), "apart")
    big = F.col("_c") == F.col("_most")
    each = lambda n: F.sequence(F.lit(0), n - 1)
    # The largest component's block i meets the others' block j as (i, j); the others' i and j as (-1 - the greater, the less).
    most = left.where(big).select(group, "node", _block(F.col("_big")).alias("_p"), F.explode(each(F.col("_rest"))).alias("_q"))
    rest = left.where(~big).withColumn("_j", _block(F.col("_rest")))
    across = rest.select(group, "node", F.explode(each(F.col("_big"))).alias("_p"), F.col("_j").alias("_q"))
    among = rest.select(group, "node", "_j", F.explode(each(F.col("_rest"))).alias("_o")).select(group, "node", (-1 - F.greatest("_j", "_o")).alias("_p"), F.least("_j", "_o").alias("_q"))
    again = load(most.unionByName(across).unionByName(among), left.select("node").distinct())
    second = written(_dealt(again, group, payload).mapInArrow(find, "a binary, b binary, _q int"), "second-links")
    # Links of groups of several blocks go on as what they have joined already.
    return first.where("_q = 0").unionByName(second).select("a", "b").unionByName(inside.select(F.col("node").alias("a"), F.col("root").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, root): every linked node but the roots, with the least node reachable, by large and small stars.

    The links given are read twice, so they should be cheap to read. Each step is written to the shared folder, so lineage stays short;
    steps go on until every node has one root, itself with none. No step gives more rows than it takes, so none is made distinct.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    was_large = False
    while True:
        # Least neighbours are written before they are joined, so both sides of a join are exchanges and a hub's rows can be split.
        both = links.select("a", "b", F.col("b").alias("up")).unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(None).cast("binary").alias("up")))
        ups = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.max("up").alias("up"), F.count_if(F.col("up").isNull()).alias("below"))
        # The same pass tells how many nodes have two lesser neighbours, and how many lie between two others.
        seen, has_up = Observation(), F.col("up").isNotNull()
        ups = ups.observe(seen, F.count_if(has_up & (F.col("up") != F.col("m"))).alias("forks"), F.count_if(has_up & (F.col("below") > 0)).alias("between"))
        least = written(ups.select("a", "m"), "least")
        forks, between = seen.get["forks"], seen.get["between"]
        if not forks and not between:
            return least.where("m < a").select(F.col("a").alias("node"), F.col("m").alias("root"))
        # Large stars change nothing where no node lies between others, small ones nothing where none forks; else they take turns.
        was_large = bool(between) and not (forks and was_large)
        if was_large:
            links = written(links.join(least.select(F.col("a").alias("b"), "m"), "b").select("a", F.col("m").alias("b")), "large")
        else:
            small = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            links = written(small.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))), "small")


def signatures(docs: DataFrame, words: int, per_band: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (a 128-bit digest of the set, null if it is empty), sketch, bands."""
    bands = REGISTERS // per_band

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, nodes, sketches = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, words)
                n.append(len(s))
                nodes.append(_node(s) if len(s) else None)
                sketches.append(sketch(s) if len(s) else np.zeros(REGISTERS, "<u2"))
            all_ = np.stack(sketches) if sketches else np.zeros((0, REGISTERS), "<u2")
            keys = np.zeros((len(all_), bands), np.uint64)
            for j in range(per_band):
                keys = mixed(keys + all_[:, j : j + bands * per_band : per_band].astype(np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(1 << 32))
            lists = pa.ListArray.from_arrays(np.arange(len(all_) + 1, dtype=np.int32) * bands, pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array([x.tobytes() for x in all_], pa.binary()), lists], ["doc_id", "text_hash", "n_shingles", "node", "sketch", "bands"])

    return docs.select("doc_id", "text", "text_hash").mapInArrow(sign, "doc_id long, text_hash long, n_shingles long, node binary, sketch binary, bands array<long>")


def _node(s: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return mixed(np.array([s.sum(dtype=np.uint64) + np.uint64(len(s)), np.bitwise_xor.reduce(mixed(s * _ORD[0]))])).tobytes()


def _candidate_links(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(bucket, p, q, node, n, sketch, block) -> stars of the likely pairs of every pair of blocks."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _grouped(batches, 3):
            nodes = t.column("node").to_pylist()
            size = t.column("n").to_numpy().astype(float)
            regs = np.frombuffer(b"".join(t.column("sketch").to_pylist()), "<u2").reshape(len(t), REGISTERS)
            q, out = t.column("_q").to_pylist(), []
            ends = np.append(at[1:], len(t))
            few = ends - at <= FEW  # most buckets: many at once
            for some in np.array_split(np.flatnonzero(few), max(1, few.sum() // 4000)):
                x, y = _pairs(at[some], ends[some] - at[some])
                ok = likely(regs[x], regs[y], size[x], size[y], similarity)
                out += [(q[i], nodes[i], nodes[j]) for i, j in _trees(x[ok], y[ok])]
            for a, b in zip(at[~few].tolist(), ends[~few].tolist()):
                out += [(q[a], nodes[a + i], nodes[a + j]) for i, j in _likely_forest(regs[a:b], size[a:b], similarity)]
            yield _stars(out)

    return find


def _true_links(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(group, p, q, node, set, block) -> stars of the pairs whose full sets have the similarity, in every pair of blocks."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _grouped(batches, 3, 2_000):
            nodes, sets = t.column("node").to_pylist(), t.column("set").to_pylist()
            q, out = t.column("_q").to_pylist(), []
            for a, b in zip(at.tolist(), [*at[1:].tolist(), len(t)]):
                own = [np.frombuffer(x, np.uint64) for x in sets[a:b]]
                size = np.array([len(x) for x in own], float)
                shared = intersections(own)
                links = 100 * shared >= round(100 * similarity) * (size[:, None] + size - shared) - 1e-6
                out += [(q[a], nodes[a + i], nodes[a + j]) for i, j in _forest(links)]
            yield _stars(out)

    return find


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of all intersections of a block's sets: products of 0/1 columns, of shingles that more than one set has."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count > 1
    keep, number, total = several[at], np.cumsum(several) - 1, int(several.sum())
    row, column = row[keep], number[at[keep]]
    shared = np.zeros((len(sets), len(sets)))
    for low in range(0, total, 8192):
        part = (column >= low) & (column < low + 8192)
        m = np.zeros((len(sets), min(8192, total - low)), np.float32)
        m[row[part], column[part] - low] = 1
        shared += m @ m.T
    return shared


def _full_sets(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(text, node) -> the text's full set."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, words).tobytes() for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sets, pa.binary())], ["node", "set"])

    return made


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every document with its group: doc_id, n_shingles, component_id, kept, text_hash, chosen.

    A document's set is its distinct runs of `words` words; documents are linked where 100 * intersection >= 100 * similarity *
    union, and a group is what links reach; component_id is its least doc_id and kept says that the row has that id. Texts
    without words (null too) are linked with nothing. Rows that repeat a doc_id count by their texts; a null doc_id is
    never a component's id unless all are null. chosen marks the row of every group to keep where ids repeat or are null: the one of least id,
    of least text_hash (xxhash64 of the text) among those; rows equal in both are one document, chosen or not together.

    1. Signatures; equal sets become one node. 2. Buckets of equal bands of registers, of more than one node, in blocks of
    bounded size: pairs that the joint likelihood doesn't rule out (a pair at the similarity fails to meet in a bucket
    with 1e-5 or less). 3. Groups of those pairs, in blocks again, now with full sets: exact links. 4. Groups of links.
    """
    per_band = bands_for(similarity)
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    signed = written(signatures(docs, words, per_band), "signatures")
    # A row by what orders it: rows with an id first, then by id and text.
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    sets = signed.where("node is not null").groupBy("node").agg(F.min(row).alias("first"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    sets = written(sets, "sets")

    banded = sets.select("node", F.explode("bands").alias("bucket"))
    full = written(banded.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "buckets")
    meet = written(banded.join(full, "bucket").withColumn("_blocks", F.ceil(F.col("members") / BLOCK).cast("int")).drop("members"), "meetings")
    in_rows = F.count("*") / BLOCK
    with_sketch = lambda rows, nodes: rows.join(sets.select("node", "n", "sketch"), "node")
    coarse = components(forest(meet, "bucket", with_sketch, ["n", "sketch"], _candidate_links(similarity), in_rows))

    member = coarse.unionByName(coarse.select(F.col("root").alias("node"), "root").distinct())
    member = written(member.join(sets.select("node", "first", "n"), "node"), "members")
    in_bytes = F.greatest(in_rows, F.sum("n") * 8 / BLOCK_BYTES)
    sizes = member.groupBy("root").agg(F.ceil(in_bytes).cast("int").alias("_blocks"))
    groups = written(member.select("node", "root", "n").join(written(sizes, "sizes"), "root").withColumnRenamed("root", "group"), "candidates")

    def with_set(rows: DataFrame, nodes: DataFrame | None) -> DataFrame:
        wanted = member if nodes is None else member.join(nodes, "node", "left_semi")
        key = wanted.select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"), "node")
        # Texts are dealt out by id, as the members have no bound; where the members asked for are counted to be few, texts stay where they are.
        few = nodes is not None and nodes.limit(KEYS + 1).count() <= KEYS
        key = F.broadcast(key) if few else key.hint("merge")
        some = docs.join(key, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("text", "node")
        # Rows equal in id and text give their set more than once; one of them is enough.
        return rows.join(some.mapInArrow(_full_sets(words), "node binary, set binary").dropDuplicates(["node"]), "node")

    linked = components(forest(groups, "group", with_set, ["set"], _true_links(similarity), in_bytes))

    named = linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct())
    named = written(named.join(sets.select("node", "first"), "node"), "named")
    least = written(named.groupBy("root").agg(F.min("first").alias("group_first")), "least")
    of_node = named.join(least, "root").select("node", "group_first")
    copied = sets.where("copies > 1").select("node", "first").join(of_node.select("node"), "node", "left_anti").select("node", F.col("first").alias("group_first"))
    groups = written(of_node.unionByName(copied), "groups")
    out = signed.select("doc_id", "text_hash", "n_shingles", "node").join(groups, "node", "left")
    component = F.coalesce("group_first.doc_id", "doc_id")
    chosen = F.col("group_first").isNull() | (F.col("group_first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("group_first.text_hash") == F.col("text_hash")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "text_hash", chosen.alias("chosen"))
