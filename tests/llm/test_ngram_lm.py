"""The automaton against a plain backoff model, and its distributions' sums."""

import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilspark.llm import ngram_lm as L

def train():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 != 2


def plain(texts, order=3, prior=L.PRIOR):
    """log10 p(word | history) by recursion over all n-grams of the training texts."""
    docs = [L.tokens((t or "").encode()) for t in texts]
    counts = [Counter(tuple(x[i : i + n]) for x in docs for i in range(len(x) - n + 1)) for n in range(1, order + 1)]
    total, distinct = sum(counts[0].values()), len(counts[0])

    def p(word, history):
        if not history:
            return (counts[0][(word,)] + 1) / (total + distinct + 1)
        n, rest = len(history), p(word, history[1:])
        return (counts[n][history + (word,)] + prior * rest) / (counts[n - 1][history] + prior)

    def score(text):
        words = L.tokens((text or "").encode())
        return sum(math.log10(p(w, tuple(words[max(0, i - order + 1) : i]))) for i, w in enumerate(words))

    return counts, total, distinct, p, score


TEXTS = ["the cat sat on the mat", "the cat sat on a hat the cat", "A cat on the mat the cat sat", None, "", "rare words only", "the cat sat"] * 3


def test_scores_match_plain_backoff(spark):
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learned = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    counts, total, distinct, p, score = plain(learned)
    got = {r.doc_id: r for r in L.score_documents(docs, train()).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        words = L.tokens((t or "").encode())
        assert got[i].n_tokens == len(words) and got[i].train_tokens == total
        assert got[i].n_known == sum(counts[0][(w,)] > 0 for w in words)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
        base = sum(math.log10((counts[0][(w,)] + 1) / (total + distinct + 1)) for w in words)
        assert got[i].base_score == pytest.approx(base, abs=1e-9)
        assert got[i].score == pytest.approx(score(t), abs=1e-9)
    vocabulary = [g[0] for g in counts[0]] + [b"<unseen>"]
    for history in ((), (b"the",), (b"the", b"cat"), (b"cat", b"sat"), (b"zzz",)):
        assert sum(p(w, history) for w in vocabulary) == pytest.approx(1, abs=1e-9)


def test_beats_unigrams_on_held_out_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = L.score_documents(docs, train()).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_whole_table_matches_the_plain_model(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    *_, score = plain([t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2])
    got = {r.doc_id: r.score for r in L.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), train()).collect()}
    assert got == pytest.approx({i: score(t) for i, t in rows}, rel=1e-9)


def test_empty_and_odd_tables(spark):
    schema = "doc_id long, text string, word string, n int"
    assert L.score_documents(spark.createDataFrame([], schema), train()).collect() == []
    rows = [(None, "a", "w", 1), (5, "word " * 50000, None, None), (5, "word", "x", 2)]
    assert len(L.score_documents(spark.createDataFrame(rows, schema), train()).collect()) == 3


def test_rare_ngrams_stay_in_a_large_corpus(spark):
    texts = ["filler " * 500_000, "once in a blue moon", "once in a blue moon", "a blue moon once in a while"]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    *_, score = plain(texts)
    got = {r.doc_id: r.score for r in L.score_documents(docs, F.lit(True)).collect()}
    for i in (1, 2, 3):
        assert got[i] == pytest.approx(score(texts[i]), abs=1e-9)


def test_many_blocks_and_orders(spark, monkeypatch):
    monkeypatch.setattr(L, "_BLOCK_TOKENS", 9)
    docs = spark.createDataFrame([*enumerate(TEXTS)], "doc_id long, text string")
    for order in (1, 2, 4):
        *_, score = plain(TEXTS, order)
        got = {r.doc_id: r.score for r in L.score_documents(docs, F.lit(True), order=order).collect()}
        assert [got[i] for i in range(len(TEXTS))] == pytest.approx([score(t) for t in TEXTS], abs=1e-9)
