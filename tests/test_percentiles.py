"""Percentiles by rank over counts, without a group in one array."""

import pytest

from veilspark.operators import metrics as M


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_percentiles_rank_counts(spark):
    rows = [(g, v) for g in ("a", None) for v in (5.0, 1.0, 1.0, 2.0, 9.0, -3.0, 1e9, None)] + [("none", None), ("one", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    out = M.percentiles(df, ["k"], "v", 0.95)
    assert "collect_list" not in _plan(out) and "percentile" not in _plan(out)
    got = {r.k: tuple(r)[1:] for r in out.collect()}
    assert got["a"] == got[None] == (1e9, pytest.approx(9.0 + 0.7 * (1e9 - 9.0)), 1e9, 1e9)
    assert got["none"] == (None,) * 4 and got["one"] == (4.0,) * 4


def test_bench_summary_ranks_counts(spark):
    rows = [("a", float(i), None if i % 2 else f"e{i}", True, False) for i in range(10)] + [("b", None, None, None, None)]
    out = M.bench_summary(spark.createDataFrame(rows, "k string, ms double, error string, valid boolean, correct boolean"), "k")
    assert {tuple(r) for r in out.collect()} == {("a", 10, 5, 10, 0, 4.0, 9.0, "e0|e2|e4"), ("b", 1, 0, 0, 0, None, None, "")}
