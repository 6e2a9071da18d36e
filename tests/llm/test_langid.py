"""Held-out accuracy and the stated edge cases."""

import math

import numpy as np
from pyspark.sql import functions as F

from veilspark.llm import langid as L
from veilspark.llm import queries


def held():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    got = L.predict(docs, ~held()).where(held()).collect()
    known = [r for r in got if r.lang_pred != "und"]
    assert len(known) > 0.95 * len(got)
    assert sum(r.lang == r.lang_pred for r in known) >= 0.97 * len(known)
    assert all(0 <= r.score <= 1 for r in got)


def test_edge_cases(spark):
    rows = [(i, t, la, 0.5) for i, (t, la) in enumerate([("the cat sat here", "en"), ("le chat est assis", "fr")] * 20)]
    rows += [(100, None, "en", 1.0), (101, "", "fr", None), (102, "123 !? \n", None, None), (103, "the hat", None, None), (None, "le chien", None, None), (104, "the " * 400000, None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in L.predict(docs, ~held()).collect()}
    assert {got[i].lang_pred for i in (100, 101, 102)} == {"und"} and {got[i].score for i in (100, 101, 102)} == {0.0}
    assert [got[i].lang_pred for i in (103, None, 104)] == ["en", "fr", "en"]
    kept = L.keep_known(docs, ~held())
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(got) - {100, 101, 102}
    assert L.predict(docs.limit(0), ~held()).collect() == []
    assert {r.lang_pred for r in L.predict(docs.withColumn("lang", F.lit(None).cast("string")), ~held()).collect()} == {"und"}


def marked(texts):
    out = []
    for t in texts:
        table = np.zeros(L.BUCKETS, dtype=bool)
        L.mark(t, table)
        out.append(set(np.flatnonzero(table).tolist()))
    return out


def packs(sets):
    out = []
    for s in sets:
        table = np.zeros(L.BUCKETS, dtype=bool)
        table[list(s)] = True
        out.append(L.packed(table))
    return out


def kernel(a, b):
    return np.array([[len(x & y) / math.sqrt(max(1, len(x)) * max(1, len(y))) for y in b] for x in a])


def balanced(langs):
    return np.array([1 / langs.count(x) for x in langs])


def exact(langs, sets, others, ridge=L.RIDGE):
    """Kernel ridge over all pairs of texts, in its dual form; a constant is a feature like any other."""
    names = sorted(set(langs))
    y = np.array([[1.0 if x == n else -1.0 for n in names] for x in langs])
    alpha = np.linalg.solve(kernel(sets, sets) + 1 + ridge * np.diag(1 / balanced(langs)), y)
    return (kernel(others, sets) + 1) @ alpha


def nystrom(langs, sets, others, ridge=L.RIDGE):
    """The same through the first landmarks of each language, with sets for kernels."""
    names = sorted(set(langs))
    each = min(L.LANDMARKS, L.ALL_LANDMARKS // len(names))
    marks = [sets[i] for n in names for i in [j for j, x in enumerate(langs) if x == n][:each]]
    value, vector = np.linalg.eigh(kernel(marks, marks))
    keep = value > 1e-6 * value.max()
    fold = vector[:, keep] / np.sqrt(value[keep])
    x = np.column_stack([kernel(sets, marks) @ fold, np.ones(len(langs))])
    y = np.array([[1.0 if a == n else -1.0 for n in names] for a in langs])
    b = balanced(langs)[:, None]
    w = np.linalg.solve((x * b).T @ x + ridge * np.eye(x.shape[1]), (x * b).T @ y)
    return names, np.column_stack([kernel(others, marks) @ fold, np.ones(len(others))]) @ w


def dense(model, sets):
    return np.array([np.isin(model.vocabulary, list(s)) for s in sets], dtype=np.float32), np.array([len(s) for s in sets])


def test_kernel_ridge_is_exact_when_all_texts_are_landmarks(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text IS NOT NULL AND length(text) < 3000").select("text", "lang").limit(90).collect()
    langs, texts = [r.lang for r in rows[:60]], [r.text for r in rows]
    sets = marked(texts)
    model = L.fit(langs, packs(sets[:60]), landmarks=60)
    assert np.allclose(model.values(*dense(model, sets)), exact(langs, sets[:60], sets), atol=2e-3)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    langs, features = L.sample(docs, ~held(), "doc_id", "text", "lang")
    trained = [r for r in docs.where(~held()).collect() if r.lang and L.has_letter(r.text)]
    assert sorted(langs) == sorted(r.lang for r in trained) and sorted(features) == sorted(packs(marked([r.text for r in trained])))
    rows = docs.collect()
    names, want = nystrom(langs, [set(L.unpacked(f).tolist()) for f in features], marked([r.text or "" for r in rows]))
    got = {r.doc_id: r for r in queries.op5_string_kernel(spark, "/root/testdata/sf0.001").collect()}
    for r, value in zip(rows, want, strict=True):
        g = got[r.doc_id]
        if not L.has_letter(r.text):
            assert (g.lang_pred, g.score) == ("und", 0.0)
            continue
        share = np.exp(L.SHARPNESS * (value - value.max()))
        assert abs(g.score - share.max() / share.sum()) < 5e-3
        assert g.lang_pred == names[int(value.argmax())] or np.ptp(np.sort(value)[-2:]) < 2e-3
    assert len(got) == len(rows)


def test_equal_values_take_the_first_name(spark):
    rows = [(i, "same words here", "bb" if i % 2 else "aa") for i in range(40)]
    got = L.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True)).collect()
    assert {r.lang_pred for r in got} == {"aa"} and {round(r.score, 3) for r in got} == {0.5}


def test_unclaimed_texts_and_unwanted_languages_go(spark):
    rows = [(i, f"the cat sat on the mat {i % 7}", "en") for i in range(60)] + [(100 + i, f"le chien est dans la maison {i % 7}", "fr") for i in range(60)]
    rows += [(200 + i, f"der hund ist in dem haus {i % 7}", "de") for i in range(60)]
    rows += [(500, "\u0416\u0443\u043a \u0438\u0434\u0451\u0442 \u0434\u043e\u043c\u043e\u0439 \u0449\u0430\u0441", None), (501, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in L.keep_known(docs, F.lit(True)).collect()} == {r[0] for r in rows} - {500, 501}
    assert {r.doc_id for r in L.keep_known(docs, F.lit(True), langs=["fr"]).collect()} == set(range(100, 160))


def test_no_language_is_lost_however_rare(spark):
    """Five hundred languages, of which a hundred have two texts each, beside frequent ones."""
    rows = [(k * 1000 + i, f"w{k}".translate(str.maketrans("0123456789", "abcdefghij")) * 3, f"l{k:03}") for k in range(500) for i in range(2 if k % 5 == 0 else 60 if k < 20 else 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, features = L.sample(df, F.lit(True), "doc_id", "text", "lang")
    assert set(langs) == {r[2] for r in rows} and len(langs) == len(features)
    assert max(langs.count(x) for x in set(langs)) <= L.SAMPLE // 500
