"""Search in an index gives what search in the rows gives, and reads the buckets of its words alone."""

import random

from pyspark.sql import functions as F

from tidemark.operators import catalogue, postings

WEIGHTS = {"title": 8.0, "text": 1.0, "org": 3.0}


def rows(spark):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(80)] + ["Road", "road's", "ÉTÉ", "the"]
    said = lambda n: " ".join(rng.choice(words[: rng.choice([3, 20, 84])]) for _ in range(rng.randint(0, n)))
    made = [(f"r{k}", said(5), said(30) + " the", None if k % 9 == 0 else said(2), rng.choice(["a", "b", "c"]), rng.random() < 0.3) for k in range(400)] + [("x1", None, None, None, "a", False), ("x2", "", "", "", "b", True)]
    return spark.createDataFrame(made, "id string, title string, text string, org string, state string, votable boolean")


def told(df):
    return [(r.id, r.score) for r in df.collect()]


def test_same_as_in_the_rows(spark, tmp_path):
    docs, path = rows(spark), str(tmp_path / "i")
    postings.build_index(docs, path, list(WEIGHTS), ["state", "votable"], 16)
    for query, states, first in (("w0", None, None), ("the w1", ["b", "c"], "votable"), ("w2 w2 w3 the", ["a"], None), ("Road the", None, "votable"), ("été", None, None), ("the nowhere", None, None), ("the", ["none"], None), ("", None, None)):
        own = docs.where(F.col("state").isin(states)) if states else docs
        got = postings.search_index(spark, path, query, WEIGHTS, {"state": states} if states else None, 15, first=first)
        want = told(catalogue.ranked_search(own, query, WEIGHTS, 15, first=first)) if query else []
        assert told(got) == want, (query, states, first)


def test_reads_the_words_buckets(spark, tmp_path):
    docs, path = rows(spark), str(tmp_path / "i")
    postings.build_index(docs, path, list(WEIGHTS), ["state"], 32)
    got = postings.search_index(spark, path, "w5 the", WEIGHTS)
    plan = got._jdf.queryExecution().executedPlan().toString()
    wanted = {r[0] for r in spark.createDataFrame([("w5",), ("the",)], "t string").select(postings._bucket(F.col("t"), 32)).collect()}
    assert "PartitionFilters" in plan and len(wanted) <= 2
    everything = spark.read.parquet(f"{path}/postings").inputFiles()
    read = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(*wanted)).inputFiles()
    assert {f.split("bucket=")[1].split("/")[0] for f in everything} > {str(b) for b in wanted}
    metrics = [f for f in everything if int(f.split("bucket=")[1].split("/")[0]) in wanted]
    assert 0 < len(metrics) < len(everything) / 5 and set(metrics) <= set(read)


def test_empty_index(spark, tmp_path):
    docs, path = rows(spark).limit(0), str(tmp_path / "i")
    postings.build_index(docs.union(rows(spark).where("id = 'x1'")), path, list(WEIGHTS), ["state"])
    assert told(postings.search_index(spark, path, "the", WEIGHTS)) == []
    postings.build_index(docs, path, list(WEIGHTS), ["state"])
    assert told(postings.search_index(spark, path, "the", WEIGHTS)) == []


def test_terms_are_counted_in_their_rows(spark, tmp_path):
    """Counts by field are those of the words, and the postings are shuffled once: only to be dealt to buckets."""
    docs, path, plans = rows(spark), str(tmp_path / "i"), []
    class_ = type(docs)
    deal = class_.repartitionByRange
    class_.repartitionByRange = lambda df, *by: (plans.append(df._jdf.queryExecution().executedPlan().toString()), deal(df, *by))[1]
    try:
        postings.build_index(docs, path, list(WEIGHTS), ["state"], 16)
    finally:
        class_.repartitionByRange = deal
    assert len(plans) == 1 and "Exchange" not in plans[0]
    names = {f"n_{f}": f for f in WEIGHTS}
    want = {}
    for r in docs.select("id", *[catalogue.tokens(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in WEIGHTS]).collect():
        for f in WEIGHTS:
            for w in r[f]:
                want.setdefault((w, r.id), dict.fromkeys(WEIGHTS, 0))[f] += 1
    got = spark.read.parquet(f"{path}/postings").collect()
    assert len(got) == len(want) and {(r.term, r.id): {f: r[c] for c, f in names.items()} for r in got} == want


def dealt(spark, monkeypatch):
    """Plans of what repartitionByRange is given."""
    class_, plans = type(spark.range(1)), []
    deal = class_.repartitionByRange
    monkeypatch.setattr(class_, "repartitionByRange", lambda df, *by: (plans.append(df._jdf.queryExecution().executedPlan().toString()), deal(df, *by))[1])
    return plans


def test_words_are_cut_after_rows_are_dealt(spark, tmp_path, monkeypatch):
    """Finding ranges runs what is dealt once or twice more: it must be rows of text, not their words."""
    plans = dealt(spark, monkeypatch)
    postings.build_index(rows(spark), str(tmp_path / "i"), list(WEIGHTS), ["state"], 8)
    assert plans and not any(x in p for p in plans for x in ("split(", "Generate", "sort"))


def test_search_lists_its_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "i")
    postings.build_index(rows(spark), path, list(WEIGHTS), ["state"], 32)
    wanted = {str(r[0]) for r in spark.createDataFrame([("w5",), ("the",)], "t string").select(postings._bucket(F.col("t"), 32)).collect()}
    listed = postings.search_index(spark, path, "w5 the", WEIGHTS).inputFiles()
    assert {f.split("bucket=")[1].split("/")[0] for f in listed if "bucket=" in f} == wanted


def test_segments_of_parts(spark, tmp_path, monkeypatch):
    """Rows counted a few words at a time, in segments by the input's size, give the same postings; files are in order; totals count each row once."""
    docs = rows(spark).union(spark.createDataFrame([("big", "the " * 9, "road w1 " * 3000, "--", "c", True)], "id string, title string, text string, org string, state string, votable boolean"))
    docs.write.parquet(str(tmp_path / "docs"))
    docs, path = spark.read.parquet(str(tmp_path / "docs")), str(tmp_path / "i")
    monkeypatch.setattr(postings, "SEGMENT", 8000)
    monkeypatch.setattr(postings, "WORDS", 100)  # goes to the workers with the function
    postings.build_index(docs, path, list(WEIGHTS), ["state", "votable"], 4)
    want = {}
    for r in docs.select("id", *[catalogue.tokens(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in WEIGHTS]).collect():
        for f in WEIGHTS:
            for w in r[f]:
                want.setdefault((w, r.id), dict.fromkeys(WEIGHTS, 0))[f] += 1
    got = spark.read.parquet(f"{path}/postings").withColumn("file", F.input_file_name()).withColumn("at", F.col("_metadata.row_index")).orderBy("file", "at").collect()
    assert len(got) == len(want) and {(r.term, r.id): {f: r[f"n_{f}"] for f in WEIGHTS} for r in got} == want
    by_file = {}
    for r in got:
        by_file.setdefault(r.file, []).append((r.term.encode(), r.id.encode()))
    assert len(by_file) > 8 and all(x == sorted(x) for x in by_file.values())
    assert sum(r.leads for r in got) == len({r.id for r in got}) == len({i for _, i in want})
    lengths = [F.sum(F.size(catalogue.tokens(F.coalesce(F.col(f), F.lit(""))))).alias(f"len_{f}") for f in WEIGHTS]
    keys = ["state", "votable"]
    told_ = spark.read.parquet(f"{path}/totals").drop("buckets", "schema")
    assert sorted(map(tuple, told_.collect())) == sorted(map(tuple, docs.groupBy(*keys).agg(F.count("*"), *lengths).collect()))
