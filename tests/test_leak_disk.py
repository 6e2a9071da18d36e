"""A text goes over the wire once in the leak check, however many values it holds and however many blocks these are."""

import uuid

from pyspark.sql import functions as F

from veilspark.operators import matching as M
from veilspark.operators import tokens as K
from veilspark.streaming.streams import leak_alerts


def _shuffled(spark, job):
    """Bytes that ``job`` leaves in shuffle files."""
    store = spark.sparkContext._jsc.sc().statusStore()
    before = {s.stageId() for s in _stages(store)}
    job()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(s.shuffleWriteBytes() for s in _stages(store) if s.stageId() not in before)


def _stages(store):
    found = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None)
    return [found.apply(i) for i in range(found.size())]


def test_texts_are_dealt_out_once(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_VALUES", 40)
    n, chars = 300, 8000
    noise = F.concat(*(F.sha2(F.concat("id", F.lit(f"-{i}")), 256) for i in range(chars // 64)))
    addresses = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.concat(F.lit("user"), (F.col("id") + i * 15) % n, F.lit("@x.com"))), " ")
    bodies = spark.range(n).select(F.lit("s").alias("scope"), F.col("id").alias("doc_id"), F.concat(noise, F.lit(" "), addresses).alias("text"))
    path = spark.conf.get("spark.checkpoint.dir") + f"/bodies-{uuid.uuid4().hex}"
    bodies.repartition(3).write.parquet(path)
    bodies = spark.read.parquet(path)
    values = spark.range(n).select(F.lit("s").alias("scope"), F.concat(F.lit("user"), "id", F.lit("@x.com")).alias("value"))
    got = {}
    written = _shuffled(spark, lambda: got.update({r.value: r.n for r in K.leak_check(bodies, values, "scope").collect()}))
    assert got == {f"user{i}@x.com": 20 for i in range(n)}
    assert written < 1.5 * n * chars, written


def test_copies_parts_and_kept_columns(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_VALUES", 2)
    monkeypatch.setattr(M, "PART_CHARS", 50)
    monkeypatch.setattr(M, "BATCH_FINDS", 3)
    rows = [(s, i, {"k": str(i)}, t) for i, (s, t) in enumerate([("s", "Ann met ann")] * 30 + [("t", "ann"), (None, "ann"), ("s", None), ("s", ""), ("u", "ann")])]
    bodies = spark.createDataFrame(rows, "scope string, ord int, m map<string,string>, text string")
    values = spark.createDataFrame([("s", "ANN", "P#1"), ("s", "met", "P#2"), ("s", "ann", "P#3"), ("s", "none", "P#4"), (None, "ann", "P#1"), ("t", "n", "P#1")], "scope string, value string, token string")
    got = {(r.scope, r.value): r.n for r in K.leak_check(bodies, values, "scope").collect()}
    assert got == {("s", "ANN"): 60, ("s", "ann"): 60, ("s", "met"): 30, ("s", "none"): 0, (None, "ann"): 0, ("t", "n"): 2}
    alerts = sorted((r.scope, r.ord, r.m["k"], r.token) for r in leak_alerts(bodies, values, "scope").collect())
    assert alerts == sorted([("s", i, str(i), t) for i in range(30) for t in ("P#1", "P#2", "P#3")] + [("t", 30, "30", "P#1")])
