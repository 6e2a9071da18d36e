"""Raked marginals, draws, and the lookup table against a plain replay."""

from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from veilspark.llm import mixing as M
from veilspark.llm import sharding as S


def test_marginals_meet_their_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = M.sampled(docs).withColumn("m", F.col("weight") * F.col("n_tokens")).cache()
    total = got.agg(F.sum("n_tokens")).first()[0]
    for column, targets in (("lang", M.LANGS), ("topic", M.TOPICS)):
        mass = {r[0]: r[1] / total for r in got.groupBy(column).agg(F.sum("m")).collect()}
        scale = sum(targets[k] for k in mass)
        assert all(share == pytest.approx(targets[k] / scale, abs=2e-3) for k, share in mass.items())
    spent = got.agg(F.sum(F.col("probability") * F.col("n_tokens"))).first()[0]
    assert spent == pytest.approx(M.BUDGET * total, rel=1e-3)
    kept = {r.doc_id for r in got.where("kept").select("doc_id").collect()}
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.select("doc_id").collect()} == kept


def test_mixing_edge_cases(spark):
    schema = "doc_id long, text string, lang string, source string, a int, m_source int"
    rows = [(1, None, None, None, 1, 1), (2, "", "xx", "s", 2, 2), (3, "some words", "en", "s", 3, 3), (3, "some words", "en", "s", 3, 3), (None, "word " * 200000, "de", "t", 4, 4)]
    docs = spark.createDataFrame(rows, schema)
    got = M.sampled(docs).collect()
    assert len(got) == 5 and all(0 <= r.probability <= 1 for r in got)
    assert len({r.kept for r in got if r.doc_id == 3}) == 1
    assert M.mix(docs).columns == docs.columns
    assert M.sampled(docs.limit(0)).collect() == [] and M.mix(docs.limit(0)).collect() == []
    assert all(r.weight == 1 for r in M.sampled(docs.where("doc_id = 1")).collect())


def replay(shards, slots):
    """Turns over whole preference lists."""
    prefs = []
    for s in shards:
        d = md5(s.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:], "big") % (slots - 1) + 1
        prefs.append([(offset + j * skip) % slots for j in range(slots)])
    owner = {}
    while len(owner) < slots:
        for i, p in enumerate(prefs):
            if len(owner) < slots:
                owner[next(x for x in p if x not in owner)] = i
    return [owner[i] for i in range(slots)]


def test_fill_is_the_turns_replayed():
    names = tuple(f"n{i}" for i in range(7))
    assert S.fill(names, 101) == replay(names, 101)
    counts = Counter(S.fill())
    assert max(counts.values()) - min(counts.values()) <= 1
    before, after = S.fill(names, 10007), S.fill(names[:-1], 10007)
    assert sum(a != b for a, b in zip(before, after, strict=True)) < 0.35 * 10007
    with pytest.raises(ValueError):
        S.fill(names, 100)


def test_placing(spark):
    schema = "doc_id long, text string, shard int"
    got = S.place(spark.createDataFrame([(1, "a", 9), (1, "b", 9), (None, None, None)], schema))
    assert got.columns == ["doc_id", "text", "slot", "shard"]
    rows = got.collect()
    assert len(rows) == 3 and len({r.shard for r in rows if r.doc_id == 1}) == 1 and all(r.shard is not None for r in rows)
    assert S.place(spark.createDataFrame([], schema)).collect() == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_given_targets_are_met(spark):
    """Weights of sources from a table, topics from a column, lists of languages and topics of the caller's own."""
    rows = [(i, "word " * (5 + i % 11), ("xx", "yy", "zz", None)[i % 4], ("a", "b", "c", None)[i // 4 % 4], ("t1", "t2", None)[i // 16 % 3]) for i in range(960)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, theme string")
    langs, topics, sources = {"xx": 0.5, "yy": 0.3, "rest": 0.2}, {"t1": 0.6, "else": 0.4}, {"a": 3.0, "b": 1.0, "": 4.0}
    table = spark.createDataFrame(list(sources.items()), "source string, weight double")
    got = M.sampled(docs, topic="theme", langs=langs, topics=topics, sources=table).collect()
    total = sum(r.n_tokens for r in got)
    share = lambda key, value: sum(r.weight * r.n_tokens for r in got if r[key] == value) / total
    assert all(abs(share("lang", k) - v) < 1e-3 for k, v in langs.items())
    assert all(abs(share("topic", k) - v) < 1e-3 for k, v in topics.items())
    assert all(abs(share("source", k) - v / 8) < 1e-3 for k, v in sources.items())
    assert {r.weight for r in got if r.source == "c"} == {0.0}
    kept = {r.doc_id for r in got if r.kept}
    assert {r.doc_id for r in M.mix(docs, topic="theme", langs=langs, topics=topics, sources=table).collect()} == kept and kept
