"""Rendered texts: a text of very many spans takes time in proportion, and the spans are found once."""

import time

from pyspark.sql import functions as F

from veilspark.functions import spans as S
from veilspark.operators import tokens as K
from veilspark.plans import redaction


def test_many_spans_of_a_text_are_put_in_by_stretches(spark):
    def rendered(n):
        spans = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * 16 + 5).alias("start"), (i * 16 + 13).alias("end"), F.concat(F.lit("T#"), i).alias("token")))
        docs = spark.range(1).select(F.concat(F.repeat(F.lit("éail ab@cd.ef x "), n), F.lit("9")).alias("text"), spans.alias("spans")).cache()
        return docs.select(S.rendered(F.col("text"), F.col("spans"), lambda s: s["token"], K._parted)).first()[0]

    def seconds(n):
        start = time.time()
        assert rendered(n).startswith("éail T#0 x éail T#1 ")
        return time.time() - start

    for n in (1, 63, 64, 65, 128, 129, 200):
        assert rendered(n) == "".join(f"éail T#{i} x " for i in range(n)) + "9"
    seconds(2000)
    assert seconds(16_000) < 40 * max(seconds(2000), 0.1)


def test_rendered_texts_find_their_spans_once(spark, sf, monkeypatch):
    calls, spans_of = [], redaction._spans
    monkeypatch.setattr(redaction, "_spans", lambda *a: calls.append(spans_of(*a)) or calls[-1])
    rendered, _ = redaction._rendered(spark, sf)
    plan = rendered._jdf.queryExecution().optimizedPlan().toString()
    assert len(calls) == 1 and "ArrowEvalPython" not in plan and "scan(" not in plan
