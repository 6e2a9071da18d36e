import hashlib
import random
import re

import pytest

from veilspark.llm import queries, repeats


def plain(rows, window=20):
    """Rows of (id, text), in the order in which documents count."""
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen, out = {}, []
    for k, (i, words) in enumerate(docs):
        gone = set()
        for at in range(len(words) - window + 1):
            key = tuple(words[at : at + window])
            if seen.setdefault(key, (k, at)) != (k, at):
                gone.update(range(at, at + window))
        out.append((i, len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone)))
    return out


def longest(rows, window=20):
    out, size, docs = [0] * len(rows), window, [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    while True:
        where = {}
        for k, words in enumerate(docs):
            for at in range(len(words) - size + 1):
                where.setdefault(tuple(words[at : at + size]), []).append(k)
        again = {k for ks in where.values() if len(ks) > 1 for k in ks}
        if not again:
            return out
        for k in again:
            out[k] = size
        size *= 2


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, block string, kept int").repartition(3)
    return [tuple(r) for r in repeats.find(df, **more).orderBy("doc_id").collect()]


@pytest.mark.parametrize("block", [300, 1_000_000])
def test_like_a_plain_search_over_several_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(repeats, "_BLOCK_WORDS", block)
    rng = random.Random(block)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 3)
    said = [" ".join(word() for _ in range(rng.randrange(15, 90))) for _ in range(12)]
    texts = []
    for _ in range(90):
        parts = [rng.choice(said) if rng.random() < 0.5 else "\n".join(word() for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 6))]
        texts.append(rng.choice([" ", "\t", " \r\n\x0b\x0c"]).join(parts))
    texts += [texts[4]] * 25 + ["spin " * 70, "ä b   x " * 30, "", None, "one", "w " * 19, "v " * 20, "v " * 21]
    rows = [(i * 7 % 211 - 20, t) for i, t in enumerate(texts)]
    rows.sort()
    got = found(spark, rows)
    assert [r[:4] for r in got] == plain(rows)
    assert [r[4] for r in got] == longest(rows)


def test_odd_rows(spark):
    assert found(spark, []) == [] and found(spark, [(1, None)]) == [(1, 0, 0, "", 0)]
    text = " ".join(map(str, range(50)))
    twice = found(spark, [(5, text), (5, text), (None, "x y"), (9, text + " tail")])
    assert sorted(r[2] for r in twice) == [0, 0, 50, 50] and twice[0][:3] == (None, 2, 0)
    assert found(spark, [(2, "a b c d a b c d")], window=4) == [(2, 8, 4, "a b c d", 4)]


def test_a_very_long_text_and_words_across_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_PIECE", 1000)
    rng = random.Random(2)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(60_000))
    rows = [(1, long), (2, "begin " + long[: len(long) // 2]), (3, "x" * 5000 + " " + "y " * 40)]
    assert [r[:4] for r in found(spark, rows)] == plain(rows)


def test_whole_smallest_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    want = [(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in plain(rows)]
    assert [tuple(r) for r in queries.op13_doubled_windows(spark, sf).orderBy("doc_id").collect()] == want
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("veil_repeats")]
