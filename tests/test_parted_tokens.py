"""Texts whose tokens would run into the letters and digits around them, or that hold what reads as a token, come back."""

from pyspark.sql import functions as F

from veilspark.operators import detection as D
from veilspark.operators import tokens as K

TEXTS = ["X9876543210 a", "mail u@x.com5 or C#1 and EMAIL#1", "EMAIL#1", "A\u2060#\u20601 \u2060\u2060", "u@x.com\u20605\n", "9876543210+919876543210", "plain", "", "X#\u20601 Z\n9876543210"]


def test_render_is_reversible(spark):
    docs = D.document_spans(spark.createDataFrame([(1, i, t) for i, t in enumerate(TEXTS)], "scope int, source_ord int, text string"))
    spans = docs.select("scope", "source_ord", F.inline("spans")).withColumn("type", F.upper("kind"))
    vault = K.mint_tokens(spans)
    decided = spans.join(vault.select("scope", "type", "value", "token"), ["scope", "type", "value"]).withColumn("decision", F.lit("replace"))
    back = K.rehydrate(K.render(docs.select("scope", "source_ord", "text"), decided), vault).collect()
    assert spans.count() >= 5 and {r.source_ord: (r.rejected, r.restored) for r in back} == {i: (False, t) for i, t in enumerate(TEXTS)}
