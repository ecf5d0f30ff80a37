"""Null ids, languages, sources and labels, repeated ids, and columns whose names the operators use themselves."""

import pytest

from tidemark.llm import decontaminate, licenses, near_dup, packing, quality, secrets, sharding, substring_dedup, toxicity

TEXT = "one two three four five six seven eight nine ten eleven. " * 3
ROWS = [(None, TEXT, None, None), (None, None, "en", None), (1, TEXT, "en", "s"), (1, None, "en", "s"), (2, "", "en", "s"), (2, TEXT + "x", "en", "s")]


@pytest.fixture
def odd(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return rows.selectExpr("*", "1 as n_chars", "'q' as node", "'z' as _found", "2 as range", "3 as secrets", "4 as d2", "'w' as _words")


def test_one_row_for_each(odd, spark):
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert near_dup.near_duplicates(odd).count() == quality.quality_verdicts(odd).count() == secrets.secret_digests(odd).count() == 6
    assert sharding.sharded_documents(odd).count() == toxicity.toxicity(odd, labels).count() == 6
    clean = secrets.redacted(odd)
    assert clean.columns == odd.columns and clean.count() == 6 and {r.secrets for r in clean.collect()} == {3}
    assert licenses.scanned(odd).collect() == []


def test_groups_and_copies(odd, spark):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dup.near_duplicates(odd, 3, 0.85).collect())
    assert got == [("1", 0, "1", True), ("1", 11, "1", True), ("2", 0, "2", True), ("2", 12, "1", False), ("None", 0, "None", False), ("None", 11, "1", False)]
    # The row without an id comes first, so its text is the first occurrence.
    found = {r.doc_id: r for r in substring_dedup.repeated_spans(odd).collect()}
    assert set(found) == {1, 2} and all(r.first_ids == [] for r in found.values()) and not found[1].text.strip() and found[2].text.strip() == "x"


def test_null_items(odd, spark):
    items = spark.createDataFrame([(None, TEXT), (3, None)], "item_id long, text string")
    found = decontaminate.contaminated(odd, items)
    assert sorted(str(r.doc_id) for r in found.collect()) == ["1", "2", "None"]
    assert sorted((str(r.doc_id), r.text) for r in decontaminate.without_contaminated(odd, found).collect() if r.text is not None) == [("2", "")] and decontaminate.without_contaminated(odd, found).count() == 3


def test_every_id_is_packed(odd):
    tokenizers = pytest.importorskip("public_tokenizers")
    pieces = packing.packed(odd, tokenizers.path("word_bpe_49k.json")).collect()
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)
