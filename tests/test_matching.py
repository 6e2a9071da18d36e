"""The matcher of many values, with blocks and parts of a few rows, against plain searches."""

import random
import re

from pyspark.sql import functions as F

from veilspark.operators import matching as M
from veilspark.operators import tokens as K


def data(rng):
    words = ["an", "ana", "banana", "nan", "b", "na na", "ä", "äx", "𝄞a", "x+y", "end."]
    values = [(s, w) for s in (1, 2) for w in words if rng.random() < 0.8] + [(3, "zz"), (1, ""), (1, None), (1, "an")]
    texts = [(rng.choice((1, 2, 4)), "".join(rng.choice(["an", "a", "n", "b", " ", "ä", "x", "𝄞", "+y", "end."]) for _ in range(rng.randrange(30)))) for _ in range(60)]
    return values, texts + [(1, ""), (1, None), (3, "nothing"), (2, "banana banana"), (2, "banana banana")]


def test_every_find(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_VALUES", 2)
    monkeypatch.setattr(M, "PART_CHARS", 100)
    values, texts = data(random.Random(1))
    v, t = spark.createDataFrame(values, "s int, value string"), spark.createDataFrame(texts, "s int, text string")
    got = sorted((r.s, r.text, r.value, r.starts) for r in M.occurrences(t, v, "s").collect())
    want = []
    for s, text in set(texts):
        for s2, value in set(values):
            if s == s2 and text and value and value in text:
                want.append((s, text, value, [m.start() for m in re.finditer(f"(?={re.escape(value)})", text)]))
    assert got == sorted(want)


def test_known_values_and_leaks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_VALUES", 3)
    values, texts = data(random.Random(2))
    vault = {(s, v): f"T#{i}" for i, (s, v) in enumerate(sorted({x for x in values if x[1]}))}
    v = spark.createDataFrame([(s, x, t) for (s, x), t in vault.items()], "scope int, value string, token string")
    t = spark.createDataFrame([(s, x, i) for i, (s, x) in enumerate(texts)], "scope int, label string, ord int")
    got = {r.ord: r.new_label for r in K.replace_known_values(t, v).collect()}
    for i, (s, text) in enumerate(texts):
        known = sorted((x for k, x in vault if k == s), key=lambda x: (-len(x), x))
        word = lambda c: c == "_" or c.isalnum()
        bound = lambda x: (r"(?<!\w)" if word(x[0]) else "") + re.escape(x) + (r"(?!\w)" if word(x[-1]) else "")
        want = text if not known or text is None else re.sub("|".join(map(bound, known)), lambda m: vault[s, m[0]], text)
        assert got[i] == want, (text, known)
    bodies = spark.createDataFrame([(s, (x or "").upper()) for s, x in texts], "scope int, text string")
    leaks = {(r.scope, r.value): r.n for r in K.leak_check(bodies, v, "scope").collect()}
    assert leaks == {(s, x): sum((y or "").upper().lower().count(x.lower()) for k, y in texts if k == s) for s, x in vault}


def test_a_large_vault_of_one_scope(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_VALUES", 20_000)
    vault = spark.range(200_000).select(F.lit(1).alias("scope"), F.concat(F.lit("user"), "id", F.lit("@example.test")).alias("value"))
    texts = spark.range(500).select(F.lit(1).alias("scope"), F.concat(F.lit("to user"), F.col("id") * 7, F.lit("@example.test and none@example.test")).alias("text"))
    found = M.occurrences(texts, vault, "scope")
    assert found.count() == 500
