"""The table function against the span columns."""

from pyspark.sql import functions as F

from veilspark.functions import register as U
from veilspark.functions import rules as R
from veilspark.operators import detection as D
from veilspark.operators import geometry as E

from .test_detection import TEXTS


def test_table_function_gives_document_spans(spark):
    U.register_udtf(spark)
    docs = spark.createDataFrame([*enumerate(TEXTS)], "doc_id long, text string")
    docs.createOrReplaceTempView("udtf_texts")
    got = spark.sql("SELECT doc_id, start, end, kind FROM udtf_texts, LATERAL veil_pii_spans(text)").collect()
    want = D.document_spans(docs).select("doc_id", F.inline("spans")).select("doc_id", "start", "end", "kind").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and "card" in {r.kind for r in got}


def agree(df, pairs):
    """Each SQL function against the operator's column, on every row."""
    got = df.select(*(F.expr(sql).alias(f"a{i}") for i, (sql, _) in enumerate(pairs)), *(c.alias(f"b{i}") for i, (_, c) in enumerate(pairs))).collect()
    assert got
    for i, (sql, _) in enumerate(pairs):
        wrong = [(r[f"a{i}"], r[f"b{i}"]) for r in got if r[f"a{i}"] != r[f"b{i}"] and str(r[f"a{i}"]) != str(r[f"b{i}"])]
        assert not wrong, (sql, wrong[:3])


def test_sql_gates_equal_the_columns(spark):
    U.register_sql(spark)
    tiers = [None, "odd", "reversible", "navigational", "state-changing", "destructive"]
    df = spark.createDataFrame([(v, a, b, p) for v in (None, "accept", "ask", "reject", "x") for a in tiers for b in tiers for p in (None, -0.1, 0.5, float("nan"))], "v string, a string, b string, p double")
    v, a, b, p = (F.col(c) for c in "vabp")
    agree(df, [("veil_gate_dual(v, a, b)", R.gate_dual(v, a, b)), ("veil_permits_unattended(a)", R.permits_unattended(a)), ("veil_is_probability(p)", R.is_probability(p)), ("veil_escalate(v, p, 0.1D)", R.escalate(v, p, F.lit(0.1))), ("veil_stricter_tier(a, b)", R.stricter_tier(a, b))])


def test_sql_texts_equal_the_columns(spark):
    U.register_sql(spark)
    texts = [None, "", "  ", "Page connection lost", "restricted about:", "ActiveTab", "e\u0301 a\u200bb_c/d", "Caf\u00e9 - X:Y", "pairing token"]
    df = spark.createDataFrame([(t, k) for t in texts for k in (None, "Password", "checkbox", "text", "navigated_since_gesture")], "t string, k string")
    t, k = F.col("t"), F.col("k")
    agree(df, [("veil_error_class(t, k)", R.classify_error(t, k)["code"]), ("veil_canonical_text(t)", D.canonical(t)), ("veil_value_field_pii(k, t)", D.value_field_pii(k, t))])


def test_sql_boxes_equal_the_columns(spark):
    U.register_sql(spark)
    sides = [-3.5, 0.0, 2.25, 99.5, 400.0]
    df = spark.createDataFrame([(x, y, w, h) for x in sides for y in sides for w in (0.0, 1.5, 300.0) for h in (0.25, 120.0, float("inf"), float("nan"))], "x double, y double, w double, h double")
    x, y, w, h = (F.col(c) for c in "xywh")
    plain = df.where("NOT isnan(h) AND h < 1000")
    agree(df, [("veil_ratio_to_px(x, y, w, h, 640D, 480D)", E.ratio_to_px(x, y, w, h, 640.0, 480.0))])
    agree(plain, [("veil_clip_rect(x, y, w, h, 300D, 200D, 1.5D)", E.clip_rect(F.lit(300.0), F.lit(200.0), 1.5)), ("veil_scale_mask(x, y, w, h, 1.5D, 0.3D)", E.scale_mask(F.lit(1.5), F.lit(0.3)))])
    spans = spark.createDataFrame([(i, i + j, k, k + 5) for i in range(8) for j in (0, 3, 9) for k in range(9)], "a0 long, a1 long, b0 long, b1 long")
    span = lambda s: F.struct(F.col(f"{s}0").alias("start"), F.col(f"{s}1").alias("end"))
    agree(spans, [("veil_interval_iou(a0, a1, b0, b1)", E.interval_iou(span("a"), span("b")))])
