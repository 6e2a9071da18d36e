"""Claims, suppressions and layers of texts with few spans and with very many: the sweep says what the plain rules say."""

import random
import time

import pytest
from pyspark.sql import functions as F

from veilspark.functions import spans as S
from veilspark.functions.patterns import SPECIFICITY
from veilspark.operators import detection as D
from veilspark.operators import tokens as K

SPAN = "array<struct<start:int,end:int,kind:string,rule:string,value:string,pass:int>>"


def passes(rng, n, room):
    out = []
    for p in range(6):
        at = 0
        while at < room and len(out) < n * (p + 1):
            at += rng.randrange(1, 12)
            end = at + rng.randrange(1, 9)
            out.append((at, end, f"k{p}", "r", "v", p))
            at = end
    return out


def plain_claims(spans):
    kept = []
    for s in spans:
        if all(s[1] <= k[0] or k[1] <= s[0] for k in kept):
            kept.append(s)
    return sorted(kept)


def plain_suppressed(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (-SPECIFICITY.get(s[2], 0), s[0] - s[1], s[0], s[5])):
        if any(k[0] <= s[0] and s[1] <= k[1] for k in kept) or s[2] == "aadhaar" and any(k[2] == "card-like" and s[0] < k[1] and k[0] < s[1] for k in kept):
            continue
        kept.append(s)
    return sorted(kept)


@pytest.fixture(scope="module")
def rules():
    rng = random.Random(3)
    lists = [passes(rng, n, room) for n, room in ((2, 40), (8, 90), (30, 900), (60, 300), (200, 4000))] + [[]]
    labelled = []
    for n in (3, 20, 70, 300, 700):
        row = []
        for _ in range(n):
            at, kind = rng.randrange(n * 6), rng.choice([*SPECIFICITY, "other"])
            size = rng.randrange(13, 25) if kind == "card-like" else 12 if kind == "aadhaar" else rng.randrange(1, 30)
            row.append((at, at + size, kind, "r", "v", rng.randrange(20)))
        labelled.append(sorted(set(row), key=lambda s: (s[5], s[0], s)))
    return lists, labelled


def test_claims(spark, rules):
    for spans, want in ((rules[0], plain_claims), (rules[1], plain_suppressed)):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(spans)], f"i int, s {SPAN}")
        rule = S.claimed if want is plain_claims else S.suppressed
        got = {r.i: [tuple(s) for s in r.out] for r in df.select("i", rule(F.col("s")).alias("out")).collect()}
        assert got == {i: want(x) for i, x in enumerate(spans)}


def test_layers(spark, rules):
    rng, schema = random.Random(4), "doc_id int, start int, end int, type string, value string, label string, score double"
    regex = [(i, s, e, "T", "v", "l", 1.0) for i, x in enumerate(rules[0]) for s, e, *_ in plain_claims(x) if rng.random() < 0.5]
    model = [(i, at, at + rng.randrange(1, 15), "M", "v", f"l{k}", 0.5) for i, x in enumerate(rules[0]) for k in range(len(x)) for at in [rng.randrange(5000)]]
    got = sorted(tuple(r) for r in K.merge_layers(spark.createDataFrame(regex, schema), spark.createDataFrame(model, schema)).collect())
    want = []
    for i in range(len(rules[0])):
        kept = [(*s, "regex") for s in regex if s[0] == i]
        for s in sorted((s for s in model if s[0] == i), key=lambda s: s[1:]):
            if all(s[2] <= k[1] or k[2] <= s[1] for k in kept):
                kept.append((*s, "model"))
        want += kept
    assert got == sorted(want)


def test_time_is_in_proportion_to_the_hits_of_a_text(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, " ".join(f"user{i}@example.test +91 9{i:09}" for i in range(n)))], "doc_id long, text string")
        began = time.time()
        assert D.document_spans(df).select(F.size("spans")).first()[0] == 2 * n
        return time.time() - began

    seconds(200)
    small, large = seconds(2000), seconds(16_000)
    assert large < 40 * small, (small, large)
