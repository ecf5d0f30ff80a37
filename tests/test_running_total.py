from itertools import accumulate

from tidemark.operators import checks


def test_running_total_by_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(2000).selectExpr("id", "case when id % 3 > 0 then md5(string(id)) end as h", "int(id % 97 + 1) as cost")
        got = checks.running_total(rows, "cost", ["h", "id"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got.sort(key=lambda x: (x.h or "", x.id))
    assert [x["_s"] for x in got] == list(accumulate(x.cost for x in got)) and len(got) == 2000
    assert max(sum(x["_p"] == p for x in got) for p in range(4)) < 1000 and [x["_p"] for x in got] == sorted(x["_p"] for x in got)
