"""A model's spans are all hits, not a part of them."""

from veilspark.plans import redaction


def test_model_spans_are_all_hits(spark, sf):
    rows = redaction._model_spans(spark, sf)
    assert rows.where("start % 11 <> 0").count() > 0
