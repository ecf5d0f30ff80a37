import zlib

from pyspark.sql import functions as F

from tidemark.llm import sharding


def test_near_equal_bytes_gapless_slots(docs):
    rows = [(i, "word " * (i % 37)) for i in range(900)] + [(i, "copy of one text " * 5) for i in range(900, 1500)] + [(2000, None), (2001, ""), (2002, "é" * 3000)]
    out = sharding.sharded_documents(docs(rows), 16).collect()
    assert {r.doc_id for r in out} == {r[0] for r in rows} and len(out) == len(rows)
    text = {d: (x or "").encode() for d, x in rows}
    assert all(r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.law == "bytes" for r in out)
    total, largest = sum(r.size for r in out), max(r.size for r in out)
    for s in range(16):
        own = [r for r in out if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 16) <= largest + sharding.WHOLE * total / 16
    by_text, sizes = {}, {}
    for r in out:
        by_text.setdefault(text[r.doc_id], set()).add(r.shard)
        sizes[text[r.doc_id]] = sizes.get(text[r.doc_id], 0) + r.size
    assert all(len(s) == 1 for x, s in by_text.items() if sizes[x] <= sharding.WHOLE * total / 16)
    assert any(len(s) > 1 for s in by_text.values())  # a group that no shard takes is cut at boundaries


def test_groups_on_boundaries_stay_whole(docs):
    """Groups of five copies everywhere: none is parted, and sizes stay within half a group of equal at each end."""
    rows = [(k, f"text {k // 5} " * 12) for k in range(4000)]
    out = sharding.sharded_documents(docs(rows), 16).collect()
    by_text, size = {}, [0] * 16
    for r in out:
        by_text.setdefault(r.text_crc32, set()).add(r.shard)
        size[r.shard] += r.size
    group = 5 * max(r.size for r in out)
    assert all(len(s) == 1 for s in by_text.values()) and max(size) - min(size) <= 2 * group
    for s in range(16):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_empty_and_repeated(docs):
    assert sharding.sharded_documents(docs([(1, "a")]).limit(0)).collect() == []
    out = sharding.sharded_documents(docs([(1, "a"), (1, "a"), (None, "b")])).collect()
    assert len(out) == 3


def test_no_range_is_overfull_in_rows(spark, docs, monkeypatch):
    """Half of all rows empty, and rows that share id and text: the largest range has a few times the mean of rows."""
    seen, write = [], sharding.written
    monkeypatch.setattr(sharding, "written", lambda df, name: seen.append(write(df, name)) or seen[-1])
    text = F.when(F.col("id") % 2 == 0, F.lit("")).when(F.col("id") % 3 == 0, F.lit("one text")).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"), F.repeat(F.lit("x"), 40)))
    rows = spark.range(60_000).select(F.when(F.col("id") % 5 > 0, F.col("id")).alias("doc_id"), text.alias("text"))
    out = sharding.sharded_documents(rows)
    assert out.count() == 60_000
    ranges = next(x for x in seen if "range" in x.columns).groupBy("range").count().agg(F.max("count"), F.avg("count")).first()
    assert ranges[0] < 4 * ranges[1]
    slots = out.groupBy("shard").agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.sum("size").alias("s")).collect()
    assert all(x.a == 0 and x.b == x.n - 1 == x.d - 1 for x in slots) and max(x.s for x in slots) - min(x.s for x in slots) < 200


def test_one_very_long_text(docs):
    out = {r.doc_id: r for r in sharding.sharded_documents(docs([(1, "long " * 400_000), *((i, "short") for i in range(2, 60))])).collect()}
    assert len(out) == 59 and out[1].size == 2_000_001 and len({r.shard for r in out.values()}) >= 2
