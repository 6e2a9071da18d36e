"""Very long texts beside short ones, and columns named like those that operators use inside."""

import pytest
from pyspark.sql import functions as F

from veilspark.llm import decontaminate, mixing, ngram_lm, pii, records, simhash

WORDS = 150_000


@pytest.fixture(scope="module")
def docs(spark):
    """Three documents, of which one has 150,000 words; the other columns' names clash with the operators' own."""
    long = " ".join(f"w{i * 7919 % 1000}" for i in range(WORDS - 11)) + " one two three four five six seven eight nine ten end@example.test"
    rows = [(1, "short text", "en", "web"), (2, long, "en", "web"), (3, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(7) for c in ("id", "row", "w", "p", "n", "fp", "block", "words", "spans", "item_id", "token", "gram", "key", "kind", "m_source")}).cache()


def test_mixing(docs):
    got = {r.doc_id: r.n_tokens for r in mixing.sampled(docs).collect()}
    assert set(got) == {1, 2, 3} and got[3] == 0 and got[2] > 10_000 * got[1] > 0


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(5, "one two three four five six seven eight nine ten"), (6, None)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in decontaminate.report(docs, items).collect()}
    assert got == {1: (2, 0, False), 2: (WORDS + 2, 10, True), 3: (0, 0, False)}


def test_personal_data(docs):
    got = {r.doc_id: r.n_email for r in pii.find(docs).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def test_fingerprints_and_scores(docs):
    prints = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert prints[3] == ("0" * 16, 3) and prints[2][1] == 2
    scores = {r.doc_id: (r.n_tokens, r.train_tokens) for r in ngram_lm.score_documents(docs, F.lit(True)).collect()}
    assert scores == {1: (3, WORDS + 5), 2: (WORDS + 1, WORDS + 5), 3: (1, WORDS + 5)}


def test_records(docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    got = {r.doc_id: r.n_tokens for r in records.round_trip(docs, str(public_tokenizers.path("word_bpe_49k.json"))).collect()}
    assert got[3] == 1 and got[2] > WORDS and set(got) == {1, 2, 3}
