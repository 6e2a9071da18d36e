"""Windows against a plain search of every document for every window."""

import hashlib
import re

from veilspark.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def norm(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items):
    grams = {}
    for item, text in items:
        w = norm(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    lengths, out = {len(g) for g in grams}, []
    for doc, text in docs:
        w, hit, ids = norm(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    ids |= grams[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


LONG = "one two three four five six seven eight nine ten eleven twelve"
DOCS = [(1, f"x {LONG} y"), (2, LONG.upper().replace(" ", ", ")), (3, "short one here now"), (4, None), (5, ""), (6, "..."), (7, "a b"), (7, "a b"), (8, "ÉCOLE école"), (None, LONG), (9, ("pad " * 30000) + LONG)]
ITEMS = [(1, LONG), (2, "one " + LONG), (10, LONG), (3, "Short one"), (4, None), (5, "?!"), (6, "école"), (7, "a b"), (None, "b")]


def test_matches_plain_search(spark, monkeypatch):
    docs = spark.createDataFrame([(*d, i) for i, d in enumerate(DOCS)], "doc_id long, text string, row int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = plain(DOCS, ITEMS)
    assert sorted((tuple(r) for r in D.report(docs, items).collect()), key=str) == want
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == sum(not r[-1] for r in want)
    monkeypatch.setattr(D, "BLOCK", 4)  # several blocks of windows
    assert sorted((tuple(r) for r in D.report(docs, items).collect()), key=str) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.report(docs.limit(0), items).collect() == []
    assert {r.n_hit for r in D.report(docs, items.limit(0)).collect()} == {0}
    assert D.drop_contaminated(docs, items.limit(0)).count() == len(DOCS)
