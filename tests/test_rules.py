"""Tiers, gates and metrics on rows with answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from veilspark.functions import rules as R
from veilspark.operators import datasets as G
from veilspark.operators import geometry as E
from veilspark.operators import metrics as M

LABELS = {
    "Erase this page": "destructive", "मसौदा मिटाएँ": "destructive", "मसौदा मि\u200dटाएँ": "destructive", "Kick the bot": "destructive", "Leave my household": "destructive", "परिवार छो\u095cें": "destructive", "परिवार छो\u0921\u093cें": "destructive",
    "Leave by noon": "state-changing", "Nudge": "state-changing", "Clear formatting": "state-changing", "Pay rent": "state-changing", "Open drawer": "navigational", "Back to list": "navigational", "Permanent link": "navigational", "cancel_subscription": "destructive",
}


def test_label_tiers(spark):
    df = spark.createDataFrame([(k,) for k in LABELS], "label string")
    got = {r.label: r.t["tier"] for r in df.select("label", R.click_tier({"visible": F.col("label")}).alias("t")).collect()}
    assert got == LABELS


def test_gates(spark):
    rows = [("accept", "navigational", "navigational", "unattended"), ("accept", "odd", "navigational", "confirm"), ("ask", "navigational", "navigational", "ask"), ("reject", "x", "navigational", "reject"), ("accept", "navigational", "odd", "reject"), ("accept", "destructive", "navigational", "confirm"), (None, "navigational", "navigational", "confirm")]
    df = spark.createDataFrame(rows, "v string, r string, l string, want string")
    assert all(x.p == x.want for x in df.select("want", R.gate_dual(F.col("v"), F.col("r"), F.col("l"))["path"].alias("p")).collect())


def test_mismatch(spark):
    df = spark.createDataFrame([("Delete", "Next", True), ("Next page", "next", False), ("", "Next", False)], "a string, b string, want boolean")
    assert all(r[0] == r[1] for r in df.select("want", R.name_mismatch(F.col("a"), F.col("b"))).collect())


def plain_area(boxes):
    xs = sorted({v for x, _, w, _ in boxes for v in (x, x + w)})
    total = 0.0
    for left, right in zip(xs, xs[1:], strict=False):
        spans = sorted((y, y + h) for x, y, w, h in boxes if x < right and x + w > left)
        end, length = float("-inf"), 0.0
        for a, b in spans:
            length += max(0.0, b - max(a, end))
            end = max(end, b)
        total += (right - left) * length
    return total


def test_union_area(spark):
    cases = {1: [(0, 0, 10, 10), (5, 5, 10, 10)], 2: [(0, 0, 4, 4), (0, 0, 4, 4)], 3: [(0, 0, 1, 1), (5, 5, 2, 3)], 4: [(0, 0, 0, 5)]}
    rows = [(i, *map(float, b)) for i, bs in cases.items() for b in bs]
    got = {r.image: r.area for r in E.union_area(spark.createDataFrame(rows, "image int, x double, y double, w double, h double"), "image").collect()}
    assert got == {i: plain_area(b) for i, b in cases.items() if i != 4}


def test_greedy_match_ties(spark):
    schema = "image int, box_id long, confidence double, x double, y double, w double, h double"
    pred = spark.createDataFrame([(1, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.8, 0.0, 0.0, 10.0, 10.0), (2, 3, 0.5, 0.0, 0.0, 1.0, 1.0)], schema)
    truth = spark.createDataFrame([(1, 11, 0.0, 0.0, 0.0, 10.0, 10.0), (1, 12, 0.0, 50.0, 0.0, 10.0, 10.0), (3, 13, 0.0, 0.0, 0.0, 1.0, 1.0)], schema)
    assert sorted(tuple(r) for r in E.greedy_match(pred, truth).collect()) == [(1, 1, 1, 1), (2, 0, 1, 0), (3, 0, 0, 1)]


def test_merge_to_a_fixpoint(spark):
    rows = [(1, "a", 0.0, 0.0, 10.0, 10.0), (1, "a", 30.0, 0.0, 10.0, 10.0), (1, "a", 10.0, 0.0, 20.0, 5.0), (1, "b", 0.0, 0.0, 5.0, 5.0)]
    got = sorted(tuple(r) for r in E.merge_overlapping(spark.createDataFrame(rows, "image int, kind string, x double, y double, w double, h double")).collect())
    assert got == [(1, "a", 0.0, 0.0, 40.0, 10.0), (1, "b", 0.0, 0.0, 5.0, 5.0)]


def test_auroc_by_pairs(spark):
    rows = [(0.1, False), (0.4, False), (0.35, True), (0.8, True), (0.4, True), (0.0, False)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = round(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)), 4)
    df = spark.createDataFrame(rows, "s double, y boolean")
    assert M.auroc(df, "s", "y").first().auroc == want
    assert M.auroc(df.where("y"), "s", "y").first().auroc is None


def test_ece(spark):
    pairs = [(0.0, False), (0.1, True), (0.95, True), (0.93, False), (0.5, True)]
    total = 0.0
    for b in range(10):
        sel = [(p, c) for p, c in pairs if b / 10 < p <= (b + 1) / 10 or (b == 0 and p == 0)]
        if sel:
            total += len(sel) / len(pairs) * abs(sum(p for p, _ in sel) / len(sel) - sum(c for _, c in sel) / len(sel))
    assert M.ece(spark.createDataFrame(pairs, "p double, c boolean"), "p", "c").first().ece == round(total, 4)


def test_empty_cases_count_as_right(spark):
    span = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame([(1, [], []), (2, [(0, 4)], [(0, 4), (10, 12)]), (3, [(0, 4)], [])], f"id int, truth {span}, pred {span}")
    got = {r.id: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in M.span_prf(df).collect()}
    assert got == {1: (0, 0, 0, 1.0, 1.0), 2: (1, 1, 0, 0.5, 1.0), 3: (0, 0, 1, None, 0.0)}


def test_accept_patterns(spark):
    df = spark.createDataFrame([("type #name Anna", True), ("type #name Bob", False), ("click #y", True), ("click #yy", False)], "k string, want boolean")
    accept = F.array(F.lit("type #name * anna"), F.lit("click #y"))
    assert all(r[0] == r[1] for r in df.select("want", M.accepted(F.col("k"), accept)).collect())


def test_splits_are_stable_and_leaks_found(spark):
    df = spark.createDataFrame([(i, f"p{i % 7}", f"q{i}") for i in range(200)], "id long, a string, b string")
    one = {r.id: r.split for r in G.stable_split(df, "id", "s").collect()}
    two = {r.id: r.split for r in G.stable_split(df.orderBy(F.desc("id")), "id", "s").collect()}
    assert one == two and {"test", "train"} == set(one.values())
    train, test = df.where("id < 3"), df.where("id >= 3")
    assert {r.id for r in G.split_leak(train, test, ("a", "b")).collect()} == {i for i in range(3, 200) if i % 7 < 3}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9])
def test_banks(spark, n):
    got = [r.part for r in G.bank_split(spark.createDataFrame([("b", i) for i in range(n)], "bank string, i int"), "bank", "i").orderBy("i").collect()]
    assert got == {1: ["both"], 2: ["train", "val"], 3: ["train", "train", "val"], 4: ["train"] * 3 + ["val"], 9: (["train"] * 3 + ["val"]) * 2 + ["train"]}[n]


def test_shared_phrases_and_their_share_of_an_item(spark):
    words = [f"w{i}" for i in range(30)]
    docs = [(1, " ".join(words)), (2, "A  b\nC d"), (3, " ".join(words[:9]) + " x " + " ".join(words[:9])), (4, None), (5, ""), (None, "a b c d e"), (1, "q " + " ".join(words[20:]) + " zz"), (6, " ".join(["a"] * 50_000 + words[5:13]))]
    items = [(10, " ".join(words[5:20])), (11, "a b c"), (12, None), (13, " ".join(words[22:]) + " zz " + " ".join(words[22:])), (14, "a a a a a a a a a")]
    want = {}
    grams = lambda t, n: {tuple(w[i : i + n]) for w in [(t or "").lower().split()] for i in range(len(w) - n + 1)}
    for n in (3, 8):
        want = {}
        for d in {d for d, _ in docs}:
            for i, t in items:
                both = set().union(*(grams(x, n) for k, x in docs if k == d)) & grams(t, n)
                if both:
                    want[d, i] = (len(both), round(len(both) / len(grams(t, n)), 9))
        got = G.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), n)
        assert {(r.doc_id, r.item_id): (r.shared, round(r.ratio, 9)) for r in got.collect()} == want
