"""Registered queries against their DuckDB SQL on the smallest tables: one of each family, and every key's shape."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from veilspark.plans import ORACLE, QUERIES

SAMPLE = (
    "a4_parse_annotations a9_parse_controls a10_page_text b1_pii_candidates b20_token_windows b22_canonical_text b26_best_label_per_word c3_mint_tokens c6_propagate_certain c15_leak_check d2_click_tier d7_plan_checks d12_release_rule "
    "d18_action_options e3_union_area e9_coverage f5_token_multiset_match f10_sliced_metrics f12_auroc f18_latency_percentiles f30_evidence_freshness g3_dedupe_rows g4_pair_positive_negative g10_split_manifest g16_contamination "
    "h3_stage_durations h3_stage_clock h7_action_history h4_run_budget h4_run_budget_table h6_audit_windows h6_late_rows h12_step_gate_stream h8_run_sessions u1_sql_functions u1_sql_boxes u1_sql_gates j3_as_of"
).split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = duck.sql(ORACLE[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(want.columns) == columns
    assert sorted(tuple(map(plain, r)) for r in got.select(*columns).collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry_and_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["doc_id", "kind", "start", "end"]
