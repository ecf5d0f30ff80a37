import random

import pytest

import corpus_pipeline as cp
from tidemark.llm import decontaminate, secrets

pytest.importorskip("public_tokenizers")


def test_stages_against_brute_force(spark, docs, tmp_path):
    from tests.llm.test_near_dup import brute

    r = random.Random(11)
    voc = ["".join(r.choices("abcdefghijklmnopqrstuvw", k=r.randint(2, 9))) for _ in range(500)]
    say = lambda n: ". ".join(" ".join(r.choices(voc, k=10)) for _ in range(n)) + "."
    items = [(i, say(4)) for i in range(5)]
    rows = [(i, say(r.randint(3, 20))) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " extra") for i in range(10, 30)] + [(300, rows[1][1])]
    rows += [(400 + i, say(5) + "\n" + items[i][1].replace(" ", "\n", 5) + "\n" + say(3)) for i in range(5)]
    rows += [(500, say(5) + ' token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" ' + say(2)), (600, "too short"), (601, None), (602, "same same " * 200), (603, " ".join(w + "$$$" for w in r.choices(voc, k=90)))]
    docs(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in cp.STAGES] == ["quality rules", "MinHash near-dedup", "benchmark decontamination", "secret scans", "packing"]
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
        path = str(tmp_path / name.replace(" ", "-"))
        out.write.parquet(path)
        now = spark.read.parquet(path)
        seen.append({x.doc_id: x.text for x in now.collect()})
    text = dict(rows)
    assert set(seen[0]) == set(text) - {600, 601, 602, 603}
    kept = {d for d, v in brute(list(seen[0].items()), 5, 80).items() if v[2]}
    assert set(seen[1]) == kept and 300 not in kept
    known = [decontaminate.normal(t) for _, t in items]
    assert set(seen[2]) == {d for d in kept if not any(k in decontaminate.normal(text[d]) for k in known)}
    assert set(seen[3]) == set(seen[2]) and "<secret>" in seen[3][500] and "9b0b3c" not in seen[3][500] and all(seen[3][d] == text[d] for d in seen[3] if d != 500)
    pieces = cp.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(seen[3])
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    assert secrets.ORDER[:3] == ["assign", "access", "hex"]


def test_rows_that_share_an_id(spark, docs):
    """No stage takes a unique or clean text because of another row with its id; of equal rows one stays."""
    r = random.Random(12)
    voc = ["".join(r.choices("abcdefghijklmnopqrstuvw", k=r.randint(2, 9))) for _ in range(500)]
    say = lambda n: ". ".join(" ".join(r.choices(voc, k=10)) for _ in range(n)) + "."
    p, u, v, q, item = say(8), say(9), say(7), say(8), say(4)
    rows = docs([(1, p), (5, p), (5, u), (7, u + " tail"), (9, v), (9, v), (None, q), (None, q), (None, say(6)), (4, say(5) + " " + item), (4, say(6))])
    kept = cp.one_of_each(spark, rows, "")
    assert sorted((str(x.doc_id), x.text) for x in kept.collect() if x.text in (p, u, v, q)) == sorted([("1", p), ("5", u), ("9", v), ("None", q)]) and kept.count() == 7
    found = decontaminate.contaminated(rows, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert [x.doc_id for x in found.collect()] == [4] and decontaminate.without_contaminated(rows, found).count() == 10
