"""Medians by narrowing ranges against sorted lists."""

import random

from loomctx.operators import report


def test_upper_medians(spark):
    rng = random.Random(1)
    groups = {"few": [3.0], "even": [1.0, 2.0], "same": [5.0] * 40, None: [rng.gauss(0, 1) for _ in range(31)], "skew": [10.0 ** rng.randint(-12, 12) for _ in range(500)] + [0.0] * 200, "ties": [rng.randint(0, 3) / 2 for _ in range(1000)], "none": []}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("few", None)]
    df = spark.createDataFrame(rows, "key string, value double")
    for bins in (1024, 3):
        got = {r["key"]: (r["n"], r["median"]) for r in report.upper_medians(df, "key", "value", bins).collect()}
        assert got == {k: (len(v), sorted(v)[len(v) // 2]) for k, v in groups.items() if v}
    assert report.upper_medians(df.limit(0), "key", "value").collect() == []
    one = report.savings(df.withColumnRenamed("value", "saved_pct").where("key = 'ties'")).first()
    assert (one["packs"], one["median_saved_pct"]) == (1000, sorted(groups["ties"])[500])
    empty = report.savings(df.limit(0).withColumnRenamed("value", "saved_pct")).first()
    assert (empty["packs"], empty["median_saved_pct"]) == (0, None)
