"""Queries of streams over tables of one file, of three and of 130, whose events are dealt out at random."""

import pytest

from veilspark.plans import QUERIES

STREAMS = ["h1_rate_limit", "h2_replay_guard", "h2_first_uses", "h3_stage_clock", "h4_run_budget", "h5_freshness_join", "h6_audit_windows", "h6_late_rows", "h7_action_history_stream", "h11_value_reference", "h12_step_gate_stream"]


@pytest.fixture(scope="module")
def layouts(spark, sf, tmp_path_factory):
    events, out = spark.read.parquet(f"{sf}/events.parquet"), {}
    for files in (3, 130):
        out[files] = f"file://{tmp_path_factory.mktemp('layout')}"
        events.selectExpr("*", f"pmod(xxhash64(event_id), {files}) AS part").repartition(files, "part").drop("part").write.parquet(f"{out[files]}/events.parquet")
    return out


@pytest.mark.parametrize("name", STREAMS)
def test_answers_are_the_same_at_any_layout(spark, sf, layouts, name):
    whole = sorted(map(tuple, QUERIES[name](spark, sf).collect()), key=str)
    assert whole
    for folder in layouts.values():
        assert sorted(map(tuple, QUERIES[name](spark, folder).collect()), key=str) == whole
