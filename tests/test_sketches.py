"""Daily sketches, stored and merged, against exact counts and ranks."""

import bisect
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerlake.operators import sketches


def events(spark):
    rnd = random.Random(3)
    rows = [
        ("hot" if k % 3 else "cold", datetime(2024, 1, 1) + timedelta(hours=k % 240), f"u{rnd.randrange(3_000)}", rnd.gauss(50, 20))
        for k in range(12_000)
    ]
    rows += [("hot", datetime(2024, 1, 2), None, None), ("cold", None, "u1", float("nan")), ("empty", datetime(2024, 1, 3), None, None)]
    return rows, spark.createDataFrame(rows, "kind string, at timestamp, user string, value double")


def test_merged_days_keep_the_bounds(spark, tmp_path):
    rows, df = events(spark)
    path = str(tmp_path / "sketches")
    sketches.store(sketches.daily(df, "at", ["kind"], "user", "value"), path)
    again = sketches.daily(df.filter(F.to_date("at") == "2024-01-02"), "at", ["kind"], "user", "value")
    sketches.store(again, path)  # a day loaded twice
    saved = sketches.stored(spark, path)
    assert saved.groupBy("day", "kind").count().filter("count > 1").count() == 0
    for by in (["kind"], []):
        for r in sketches.merged(saved, by, {"p50": 0.5, "p99": 0.99}).collect():
            own = [x for x in rows if not by or x[0] == r.kind]
            users, values = {x[2] for x in own} - {None}, sorted(x[3] for x in own if x[3] is not None and x[3] == x[3])
            assert r.n == len(own)
            assert abs(r.distinct_items - len(users)) <= sketches.DISTINCT_ERROR * len(users)
            for p, got in ((0.5, r.p50), (0.99, r.p99)):
                if values:
                    assert abs(bisect.bisect_right(values, got) / len(values) - p) <= sketches.RANK_ERROR
                else:
                    assert got is None


def test_merging_equals_the_direct_sketch(spark):
    """Distinct counts of merged days are those of one sketch over all rows, within the bound; no rows, no groups."""
    _, df = events(spark)
    direct = df.agg(F.hll_sketch_estimate(F.hll_sketch_agg("user", F.lit(sketches.PRECISION))).alias("n")).first().n
    got = sketches.merged(sketches.daily(df, "at", ["kind"], "user", "value"), [], {}).first().distinct_items
    assert abs(got - direct) <= sketches.DISTINCT_ERROR * direct
    assert sketches.merged(sketches.daily(df.limit(0), "at", ["kind"], "user", "value"), ["kind"], {"p": 0.5}).count() == 0
