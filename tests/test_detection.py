"""Span columns against the rules written out in Python, on rows of our own invention."""

import re

import pytest
from pyspark.sql import functions as F

from veilspark.functions import patterns as P
from veilspark.functions import spans as S
from veilspark.operators import detection as D
from veilspark.operators import tokens as K
from veilspark.plans.inputs import probed

TEXTS = [
    "mail me at jo.doe@example.test or on +91 98765 43210",
    "card 4111 1111 1111 1112 and 4111 1111 1111 1111, pan ABCDE1234F.",
    "my aadhaar is 123412341234 and 1234 1234 1234",
    "bare 123412341234 without the word",
    "short +1 23 45, long +44 20 7946 0958, é+91-9876543210é",
    "", "K1234567 xK1234567 K12345678", "😀 a@b.co 😀 c@d.co",
]


def luhn(v):
    d = [int(c) for c in v if c.isdigit()]
    return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2) for i, x in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    vetoes = {"luhn": luhn, "seven": lambda v: len(re.sub("[ -]", "", v)) >= 7}
    passes = [(p.name, p.regex, vetoes.get(p.veto)) for p in P.PASSES]
    if re.search(P.AADHAAR_WORDS, text):
        passes.append(("aadhaar", P.AADHAAR_BARE, None))
    for name, regex, veto in passes:
        for m in re.finditer(regex, text):
            if (veto is None or veto(m[0])) and not any(m.start() < e and s < m.end() for s, e, _, _ in out):
                out.append((m.start(), m.end(), name, m[0]))
    return sorted(out)


def test_claimed_spans(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: [(s["start"], s["end"], s["kind"], s["value"]) for s in r.spans] for r in D.document_spans(docs).collect()}
    assert got == {i: plain(t) for i, t in enumerate(TEXTS)}


def test_claimed_spans_on_the_table(spark, sf):
    rows = D.document_spans(probed(spark, sf)).select("doc_id", "text", "spans").collect()
    for r in rows:
        assert [(s["start"], s["end"], s["kind"], s["value"]) for s in r.spans] == plain(r.text)


def test_known_quirks(spark):
    docs = spark.createDataFrame([(0, "4111 1111 1111 1112"), (1, "+91 98765 43210"), (2, "+1 23 45")], "doc_id long, text string")
    got = {r.doc_id: [(s["kind"], s["value"]) for s in r.spans] for r in D.document_spans(docs).collect()}
    assert got[0][0] == ("aadhaar", "4111 1111 1111")  # an invalid card's first twelve digits
    assert got[1] == [("phone", "98765 43210")]  # the prefix stays
    assert got[2] == []


def test_masking_and_round_trip(spark):
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(TEXTS)], "doc_id long, scope string, text string")
    masked = {r.doc_id: r.masked for r in K.masked_text(D.document_spans(docs)).collect()}
    for i, t in enumerate(TEXTS):
        want, last = "", 0
        for s, e, _, _ in plain(t):
            want, last = want + t[last:s] + K.MASK, e
        assert masked[i] == want + t[last:]
    spans = D.document_spans(docs).select("scope", F.col("doc_id").alias("source_ord"), F.inline("spans"))
    spans = spans.select("scope", "source_ord", "start", "end", F.upper("kind").alias("type"), "value", F.col("kind").alias("label"), F.lit(1.0).alias("score"), F.lit("regex").alias("layer"), F.lit(True).alias("certain"))
    vault = K.mint_tokens(spans)
    rows = vault.collect()
    assert len({(r.type, r.value) for r in rows}) == len(rows) == len({r.token for r in rows})
    decided = K.apply_answers(spans, vault, spark.createDataFrame([], "scope string, token string, answer string"))
    rendered = K.render(docs.withColumnRenamed("doc_id", "source_ord"), decided)
    back = {r.source_ord: r.restored for r in K.rehydrate(rendered, vault).collect()}
    assert back == dict(enumerate(TEXTS))


def test_unknown_token_rejects(spark):
    texts = spark.createDataFrame([("s", "see EMAIL#1 and EMAIL#9"), ("s", "see EMAIL#1"), ("t", "none")], "scope string, rendered string")
    vault = spark.createDataFrame([("s", "EMAIL#1", "a@b.c")], "scope string, token string, value string")
    got = {r.rendered: (r.rejected, r.restored) for r in K.rehydrate(texts, vault).collect()}
    assert got == {"see EMAIL#1 and EMAIL#9": (True, None), "see EMAIL#1": (False, "see a@b.c"), "none": (False, "none")}


def test_whole_words_only(spark):
    labels = spark.createDataFrame([("s", "Ravi and Ravishankar (Ravi)")], "scope string, label string")
    vault = spark.createDataFrame([("s", "PERSON#1", "Ravi"), ("s", "PERSON#2", "a.b")], "scope string, token string, value string")
    assert K.replace_known_values(labels, vault).first().new_label == "PERSON#1 and Ravishankar (PERSON#1)"
    assert K.replace_substring_values(labels, vault).first().new_label == "PERSON#1 and PERSON#1shankar (PERSON#1)"


def test_model_layer_yields_to_rules_and_itself(spark):
    schema = "doc_id long, start int, end int, type string, value string, label string, score double"
    regex = spark.createDataFrame([(1, 10, 20, "EMAIL", "x", "email", 1.0)], schema)
    model = spark.createDataFrame([(1, 15, 25, "P", "a", "person name", 0.9), (1, 0, 5, "P", "b", "person name", 0.3), (1, 4, 8, "P", "c", "person name", 0.9)], schema)
    got = sorted((r.start, r.layer) for r in K.merge_layers(regex, model).collect())
    assert got == [(0, "model"), (10, "regex")]
    bands = spark.range(1).select(K.band(F.lit(0.13), F.lit("person name"), F.lit("model")), K.band(F.lit(0.13), F.lit("city"), F.lit("model")), K.band(F.lit(0.6), F.lit("city"), F.lit("model"))).first()
    assert tuple(bands) == ("uncertain", "ignored", "certain")


def test_labelled_rules(spark):
    cases = {
        "otp is 123456": ["otp"], "enter your 6-digit code: 445566": ["otp"], "cvv: 123": ["cvv"], "password: hunter22": ["password"], "GSTIN 22ABCDE1234F1Z5": ["gstin"], "pay to jo@okaxis": ["upi-vpa"],
        "ifsc HDFC0001234": ["sensitive-label", "ifsc"], "4111 1111 1111 1111": ["card-like"], "nothing here": [],
    }
    docs = spark.createDataFrame([(t,) for t in cases], "text string")
    got = {r.text: [s["kind"] for s in r.spans] for r in D.sensitive_spans(docs).collect()}
    assert got == cases


def test_chunks_cover_every_line(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    texts = {r.doc_id: r.text for r in docs.collect()}
    chunks = {}
    for r in D.chunk_lines(docs, most=20).collect():
        chunks.setdefault(r.doc_id, []).append((r.start, r.end, r.words))
    for doc, text in texts.items():
        covered = "".join(text[s:e] for s, e, _ in sorted(chunks.get(doc, [])))
        assert re.sub(r"\s", "", covered) == re.sub(r"\s", "", text)
        assert all(n <= 20 or not re.search(r"\s", text[s:e]) for s, e, n in chunks.get(doc, []))


@pytest.mark.parametrize(("glob", "path", "hit"), [("a/*.md", "a/b.md", True), ("a/*.md", "a/c/b.md", False), ("**/b.md", "x/y/b.md", True), ("docs/", "docs/x/y", True)])
def test_globs(glob, path, hit):
    assert bool(re.search(D.glob_regex(glob), path)) is hit


def test_form_fields(spark):
    rows = [("password", "p", "", "", "x"), ("text", "user_email", "email", "", ""), ("tel", "", "", "", ""), ("text", "code", "", "numeric", ""), ("text", "pan card", "", "", ""), ("text", "q", "", "", "")]
    df = spark.createDataFrame(rows, "type string, name string, autocomplete string, inputmode string, id string")
    got = [r[0] for r in df.select(D.classify_form_field(*(F.col(c) for c in df.columns))).collect()]
    assert got == [["password"], ["email"], ["tel"], ["otp"], ["card-like", "pan"], []]


def test_leaks_are_counted_in_either_case(spark):
    bodies = spark.createDataFrame([("s", "Ann ann ANNA aaaa"), ("s", "Ann ann ANNA aaaa"), ("s", None), ("t", "jo.doe@example.test, JO.DOE@example.tests x"), ("t", "")], "scope string, text string")
    values = [("s", "Ann"), ("s", "aa"), ("s", "zz"), ("s", "anna aaaa"), ("t", "jo.doe@example.test"), ("t", "jo.doe@example.tests"), ("t", "Ann"), ("t", "x"), ("t", ""), ("u", "x")]
    got = {(r.scope, r.value): r.n for r in K.leak_check(bodies, spark.createDataFrame(values + values[:2], "scope string, value string"), "scope").collect()}
    assert got == {("s", "Ann"): 6, ("s", "aa"): 4, ("s", "zz"): 0, ("s", "anna aaaa"): 2, ("t", "jo.doe@example.test"): 2, ("t", "jo.doe@example.tests"): 1, ("t", "Ann"): 0, ("t", "x"): 3, ("t", ""): 0, ("u", "x"): 0}
