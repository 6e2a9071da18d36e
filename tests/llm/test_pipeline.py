"""Each stage of the pipeline against brute force on its own input, and the run against the stages one by one."""

from hashlib import md5

from pyspark.sql import functions as F

import corpus_pipeline as C
from veilspark.llm import common, langid, mixing, sharding

from .test_decontaminate import plain as plain_hits
from .test_langid import marked, nystrom
from .test_simhash import plain_kept


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(90_001, None, None, None, 0), (90_002, "12 34 !", "en", "s", 7), (None, "un texte sans nom", None, None, 3)], docs.schema)
    docs = docs.unionByName(odd)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert [n for n, _ in C.STAGES] == ["language", "near_duplicates", "contamination", "mixture", "shards"]
    for name, stage in C.STAGES:
        rows = {r.doc_id: r for r in docs.collect()}
        out = common.materialize(stage(spark, docs, sf), name)
        got = {r.doc_id for r in out.collect()}
        assert out.count() == len(got)
        if name == "language":
            langs, features = langid.sample(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 0, "doc_id", "text", "lang")
            ids = [d for d, r in rows.items() if langid.has_letter(r.text)]
            _, value = nystrom(langs, [set(langid.unpacked(f).tolist()) for f in features], marked([rows[d].text for d in ids]))
            top = dict(zip(ids, value.max(axis=1), strict=True))
            near = {d for d, v in top.items() if abs(v) < 2e-3}
            want = {d for d, v in top.items() if v >= 0} - near | got & near
            assert len(ids) * 0.95 < len(want) < len(rows)
        elif name == "near_duplicates":
            want = plain_kept([(d, r.text) for d, r in rows.items()])
        elif name == "contamination":
            want = {d for d, *_, hit in plain_hits([(d, r.text) for d, r in rows.items()], items) if not hit}
        elif name == "mixture":
            want = {r.doc_id for r in mixing.sampled(docs).where("kept").collect()}
        else:
            table = sharding.fill()
            place = {r.doc_id: r.shard for r in out.collect()}
            assert place == {d: table[int(md5(("" if d is None else str(d)).encode()).hexdigest()[:12], 16) % sharding.SLOTS] for d in rows}
            want = set(rows)
        assert got == want, name
        assert out.columns[: len(docs.columns)] == docs.columns
        docs = out


def test_run_is_the_stages_in_turn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in C.STAGES:
        docs = common.materialize(stage(spark, docs, sf), "stage")
    assert sorted(map(tuple, C.run(spark, sf).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        docs = common.materialize(stage(spark, docs, sf), "stage")
    assert docs.collect() == []
