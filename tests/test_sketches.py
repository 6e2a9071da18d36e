"""Merged sketches against exact counts and ranks."""

import bisect
import datetime as dt
import math
import random

from veilspark.operators import sketches as Q

T0 = dt.datetime(2024, 1, 1)


def test_rollup_within_the_stated_errors(spark):
    draw = random.Random(5)
    rows = [("hot" if i % 3 else "cold", T0 + dt.timedelta(minutes=i % 7000), draw.randrange(40_000), draw.lognormvariate(0, 2)) for i in range(120_000)]
    df = spark.createDataFrame(rows, "kind string, ts timestamp, user long, ms double").selectExpr("date_trunc('hour', ts) AS start", "*")
    hours = df.groupBy("start", "kind").agg(*Q.sketches(df.user, df.ms))
    out = Q.rollup(hours, "start", ["kind"], ["day"])
    got = out.select("level", "start", "kind", "n", Q.distinct_estimate().alias("users"), Q.quantile(0.5).alias("p50"), Q.quantile(0.99).alias("p99")).collect()
    assert {r.level for r in got} == {"", "day", "all"}
    held = {}
    for kind, ts, user, ms in rows:
        for key in (("", ts.replace(minute=0), kind), ("day", ts.replace(hour=0, minute=0), kind), ("all", None, kind)):
            held.setdefault(key, []).append((user, ms))
    assert {(r.level, r.start, r.kind) for r in got} == set(held) and len(got) == len(held)
    for r in got:
        mine = held[r.level, r.start, r.kind]
        users, values = len({u for u, _ in mine}), sorted(v for _, v in mine)
        assert r.n == len(mine) and abs(r.users - users) <= 4 * 1.04 / math.sqrt(2**Q.LG_K) * users + 1
        for p, q in ((r.p50, 0.5), (r.p99, 0.99)):
            assert bisect.bisect_left(values, p) / len(values) - Q.RANK_ERROR <= q <= bisect.bisect_right(values, p) / len(values) + Q.RANK_ERROR


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", None, None), ("a", 1, float("nan")), ("b", 1, 2.0), ("b", 2, None), (None, 3, 4.0)], "kind string, user long, ms double")
    fine = df.groupBy("kind").agg(*Q.sketches(df.user, df.ms))
    read = lambda held: {r.kind: (r.n, r.users, r.p50) for r in held.select("kind", "n", Q.distinct_estimate().alias("users"), Q.quantile(0.5).alias("p50")).collect()}
    want = {"a": (2, 1, None), "b": (2, 2, 2.0), None: (1, 1, 4.0)}
    assert read(fine) == want and read(Q.merged(fine, "kind")) == want
    assert read(fine.where("false")) == {} and Q.merged(fine.where("false"), "kind").count() == 0
