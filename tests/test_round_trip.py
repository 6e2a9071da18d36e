"""The round trip deals texts out once to render them and once to find their spans; odd rows come back as they were."""

import time
import uuid

from pyspark.sql import functions as F

from veilspark.functions import spans as S
from veilspark.operators import detection as D
from veilspark.operators import tokens as K
from veilspark.plans import QUERIES, redaction

from .test_leak_disk import _shuffled

ODD = [("s", 1, "u@x.com and u@x.com, v@x.com5"), ("s", 2, None), (None, 3, "u@x.com"), ("s", None, "u@x.com EMAIL#1"), ("s", 4, ""), ("t", 4, "EMAIL#1 u@x.com"), ("t", 5, "A⁠#1")]


def test_texts_are_dealt_out_once_to_be_rendered(spark):
    n, chars = 400, 6400
    noise = F.concat(*(F.translate(F.sha2(F.concat("id", F.lit(f"-{i}")), 256), "0123456789", "ghijklmnop") for i in range(chars // 64)))
    folder = spark.conf.get("spark.checkpoint.dir") + f"/odd-{uuid.uuid4().hex}"
    docs = spark.range(n).select(F.col("id").alias("doc_id"), noise.alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("src"), F.col("id") % 3).alias("source"), F.lit(chars).cast("long").alias("n_chars"))
    docs.repartition(2).write.parquet(f"{folder}/documents.parquet")
    for name, rows in (("c16_redaction_roundtrip", 0), ("c13_rehydrate", n)):
        got = []
        written = _shuffled(spark, lambda: got.extend(QUERIES[name](spark, folder).collect()))  # noqa: B023
        assert len(got) == rows and written < 2.9 * n * chars, (name, written / n / chars)


def test_rehydrate_by_source(spark):
    docs = D.document_spans(spark.createDataFrame(ODD, "scope string, source_ord int, text string"))
    spans = docs.select("scope", "source_ord", F.inline("spans")).withColumn("type", F.upper("kind"))
    vault = K.mint_tokens(spans.where("scope IS NOT NULL AND source_ord IS NOT NULL"))
    decided = spans.join(vault.select("scope", "type", "value", "token"), ["scope", "type", "value"]).withColumn("decision", F.lit("replace"))
    rendered = K.render(docs.select("scope", "source_ord", "text"), decided, keep=True)
    for by in ([], ["source_ord"]):
        back = K.rehydrate(rendered, vault, by=by).collect()
        key = lambda r: (r[0] or "", r[1] or 0)
        assert sorted(((r.scope, r.source_ord, r.restored) for r in back), key=key) == sorted(ODD, key=key), by
    texts = spark.createDataFrame([("s", 1, "A#1 A#2 A#1"), ("s", 2, "A#9"), ("t", 1, "A#1"), ("t", 5, None), (None, 6, "A#1"), ("s", None, "no")], "scope string, ord int, rendered string")
    vault = spark.createDataFrame([("s", f"A#{i}", f"v{i}") for i in (1, 2)], "scope string, token string, value string")
    got = {(r.scope, r.ord): (r.rejected, r.restored) for r in K.rehydrate(texts, vault, by=["ord"]).collect()}
    assert got == {("s", 1): (False, "v1 v2 v1"), ("s", 2): (True, None), ("t", 1): (True, None), ("t", 5): (None, None), (None, 6): (True, None), ("s", None): (False, "no")}


def test_losses_are_told(spark, monkeypatch):
    rows = [("s", 1, "u@x.com", "EMAIL#1"), ("s", 2, "v@x.com", "v@x.com"), ("s", 3, "w", "EMAIL#1"), ("s", 4, "x@y.com", "EMAIL#9"), ("s", 5, None, None), ("s", 6, "a", None), (None, 7, "v@x.com", "to v@x.com")]
    vault = spark.createDataFrame([("s", "EMAIL#1", "u@x.com")], "scope string, token string, value string")
    monkeypatch.setattr(redaction, "_rendered", lambda *a, **k: (spark.createDataFrame(rows, "scope string, source_ord long, text string, rendered string"), vault))
    got = sorted(tuple(r) for r in QUERIES["c16_redaction_roundtrip"](spark, "").collect())
    assert got == [(2, "span left"), (3, "not restored"), (4, "not restored"), (6, "not restored"), (7, "not restored"), (7, "span left")]


def test_many_tokens_of_one_text(spark):
    """A text of many tokens is read once, not once for each."""
    def took(n):
        df = spark.createDataFrame([("EMAIL#1 and " * n,)], "text string").repartition(1)
        began = time.time()
        assert df.select(F.length(S.blanked(F.col("text"), "[A-Z]+#[0-9]+"))).first()[0] == 12 * n
        return time.time() - began

    took(10)
    assert took(16_000) < 40 * max(took(2_000), 0.1)
