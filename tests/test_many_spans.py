"""Coverage and matches of texts with very many spans on both sides; codes and rules from one reading of a text."""

import random
import time

from pyspark.sql import functions as F

from veilspark.functions import scan
from veilspark.functions import spans as S
from veilspark.operators import detection as D
from veilspark.operators import metrics as M

SPANS = "array<struct<start:int,end:int>>"


def made(spark, rows):
    return spark.createDataFrame(rows, f"id int, chars int, truth {SPANS}, pred {SPANS}")


def plain(truth, pred):
    shared = {i for a, b in truth for i in range(a, b)} & {i for a, b in pred for i in range(a, b)}
    used = set()
    for p in pred:
        scored = []
        for i, t in enumerate(truth):
            both = max(0, min(p[1], t[1]) - max(p[0], t[0]))
            union = p[1] - p[0] + t[1] - t[0] - both
            scored += [(both / union if union else 0.0, -i)] if i not in used else []
        if scored and max(scored)[0] >= 0.5:
            used.add(-max(scored)[1])
    return len(shared), len(used)


def test_many_spans_are_matched_as_the_plain_rule_says(spark):
    rng = random.Random(5)
    side = lambda n: [(a, a + rng.randrange(0, 12)) for a in (rng.randrange(4 * n) for _ in range(n))]
    rows = [(i, 10_000, side(n), side(m)) for i, (n, m) in enumerate(((1, 1), (1, 0 or 3), (20, 30), (64, 65), (130, 90), (300, 300)))] + [(9, 10, [], []), (10, 10, [(1, 2)], []), (11, 10, [], [(1, 2)])]
    got = {r.id: (r.covered_chars, r.tp) for r in M.char_coverage(M.span_prf(made(spark, rows)), "chars").collect()}
    assert got == {i: plain(t, p) for i, _, t, p in rows}


def test_many_spans_take_no_product_of_both_sides(spark):
    def seconds(n):
        spans = [(i * 10, i * 10 + 8) for i in range(n)]
        df = made(spark, [(1, n * 10, spans, spans)]).cache()
        df.count()
        start = time.time()
        r = M.char_coverage(M.span_prf(df), "chars").first()
        assert (r.tp, r.fp, r.fn, r.coverage) == (n, 0, 0, 1.0)
        return time.time() - start

    seconds(100)
    assert seconds(4000) < 20


def test_rules_and_codes_come_from_one_reading(spark):
    texts = ["otp is 123456 code 9876", "code 1234 otp pin", "pin code otp 4321", "", None, "otp: " + "code 55667 " * 200]
    text, found = F.col("text"), F.col("found")
    docs = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("found", S.labelled_and_codes(text)).withColumn("rules", S.labelled(text))
    rows = docs.select("*", scan.codes(text).alias("codes"), S.nearby_otp(text, F.col("rules")).alias("near"), S.fresh_otp(S.codes_of(found), S.rules_of(found)).alias("fresh")).collect()
    for r in rows:
        assert r.found == r.rules + r.codes and r.near == r.fresh and len(set(r.codes)) == len(r.codes)
    plan = D.sensitive_spans(docs.select("text"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
