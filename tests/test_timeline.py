"""Order within groups of which one has nearly all rows, over several ranges, against plain Python."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from veilspark.operators import timeline as L

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    """``(g, ts, id, v)``: a hot group, a null one, single ones, and long stretches without a value."""
    out = []
    for i in range(6000):
        g = "hot" if i % 10 else (None if i % 20 else f"g{i % 300}")
        v = None if 1000 < i < 5500 and i % 3000 else i * 31 % 997
        out.append((g, T0 + dt.timedelta(seconds=i * 7919 % 6007 // 3), i, v))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "g string, ts timestamp, id long, v long").repartition(5)


def test_a_hot_group_is_many_ranges(df):
    parts = [r["count"] for r in L.ranged(df, ["g"], ["ts", "id"]).where("g = 'hot'").groupBy("_part").count().collect()]
    assert len(parts) >= 3 and max(parts) < 0.5 * sum(parts)


def test_carried(df, rows):
    want, last = {}, {}
    for g, _, i, v in in_order(rows):
        last[g] = v if v is not None else last.get(g)
        want[i] = last[g]
    assert {r.id: r.c for r in L.carried(df, ["g"], ["ts", "id"], "v", "c").collect()} == want


@pytest.mark.parametrize("n", [1, 3, 8])
def test_recent(df, rows, n):
    want, seen = {}, {}
    for g, _, i, v in in_order(rows):
        seen.setdefault(g, []).append(v)
        want[i] = [x for x in seen[g][-n:] if x is not None]
    assert {r.id: r.c for r in L.recent(df, ["g"], ["ts", "id"], "v", n, "c").collect()} == want


def test_recent_beyond_a_range(spark):
    """More rows are asked for than any range has."""
    df = spark.range(40).withColumn("g", F.lit(1))
    got = {r.id: r.c for r in L.recent(df, ["g"], ["id"], "id", 30, "c").collect()}
    assert got == {i: list(range(max(0, i - 29), i + 1)) for i in range(40)}


def test_following(df, rows):
    want, before = {}, {}
    for g, ts, i, v in in_order(rows):
        if g in before:
            want[before[g]] = (i, v)
        want[i] = None
        before[g] = i
    assert {r.id: r.c and tuple(r.c) for r in L.following(df, ["g"], ["ts", "id"], ["id", "v"], "c").collect()} == want


def test_as_of(spark, df, rows):
    asks, facts = df.where("id % 4 = 0").drop("v"), df.where("id % 4 <> 0").select("g", "ts", "v")
    for within in (None, 2.0):
        want = {}
        told = [(g, ts, v) for g, ts, i, v in rows if i % 4 and g is not None and v is not None]
        by = {}
        for g, ts, v in told:
            by.setdefault(g, []).append((ts, v))
        for g, ts, i, _ in rows:
            if i % 4 == 0:
                at = max((f for f in by.get(g, []) if f[0] <= ts), default=None)
                want[i] = at[1] if at and (within is None or (ts - at[0]).total_seconds() <= within) else None
        got = L.as_of(asks, facts, ["g"], "ts", "v", within)
        assert got.columns == ["g", "ts", "id", "v"]
        assert {r.id: r.v for r in got.collect()} == want


def test_empty(df):
    none = df.where("false")
    assert L.carried(none, ["g"], ["ts"], "v", "c").count() == L.recent(none, ["g"], ["ts"], "v", 3, "c").count() == L.following(none, ["g"], ["ts"], ["v"], "c").count() == 0
    assert {r.v for r in L.as_of(df.drop("v"), none, ["g"], "ts", "v").collect()} == {None}


def test_edges_are_broadcast_and_no_window_is_over_a_whole_group(df):
    plan = L.carried(df, ["g"], ["ts", "id"], "v", "c")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "CartesianProduct" not in plan
