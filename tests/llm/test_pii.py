"""Fixed spans against the rules as written down, and what the votes add."""

import hashlib
import re

import numpy as np

from veilspark.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain(text):
    text, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and plain_luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    out.sort()
    return out, hashlib.sha256(",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e in out).encode()).hexdigest()


ODD = [
    None, "", "a@b.c@d.e", "x@y a@@b.c .%@a-.b", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0000004", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+49 (30) 123456-78 +1 2 ++3 123.456.7890", "é😀 mail me: née@x.fr, ünï@bücher.de", "1 2-3 4" * 10, "a" * 3000 + "@", "9" * 3000 + ".1.2.3",
]


def test_fixed_spans_match_the_rules(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r, text in zip(sorted(P.find(docs).collect(), key=lambda r: r.doc_id), [t for _, t in sorted(rows, key=lambda r: r[0])], strict=True):
        spans, digest = plain(text)
        assert r.base_sha256 == digest
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        found = r.spans.split(",")
        assert all(f"{P.KINDS[k]}:{s}:{e}" in found for s, k, e in spans)
        assert spans or not r.spans or len(found) > 0


def test_votes_add_spans_and_leave_clean_text(spark):
    rows = [(i, f"Please call my phone 415-555-01{i:02d} or mail jo.doe(at)mail(dot)com. SSN 123-45-6{i:03d}") for i in range(30)]
    rows += [(100 + i, f"The year 2020 had {i} days of rain, at sea and on dot land.") for i in range(30)]
    got = {r.doc_id: r.spans for r in P.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("phone:21:33" in got[i] and "ssn:" in got[i] and "email:" in got[i] for i in range(30))
    assert all(got[100 + i] == "" for i in range(30))


def test_empty_and_extra_columns(spark):
    schema = "doc_id long, text string, kind string, spans int"
    assert P.find(spark.createDataFrame([], schema)).collect() == []
    got = P.find(spark.createDataFrame([(1, "a@b.c", "k", 1)] * 2 + [(None, None, None, None)], schema)).collect()
    assert sorted(r.spans for r in got) == ["", "email:0:5", "email:0:5"]


def test_reliabilities_tell_good_labelers_from_noise():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    votes = np.stack([np.where(rng.random(4000) < right, truth, ~truth) * 2 for right in (0.95, 0.9, 0.55)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    p, chance = P.reliabilities(patterns, counts.astype(float))
    assert chance[1, 0, 2] > 0.85 > chance[1, 2, 2]
    assert p[(patterns == 2).all(axis=1)][0] > 0.9 and p[(patterns == 0).all(axis=1)][0] < 0.1


def planted(n, seed=3):
    """Texts with spans that are personal data, and with spans of the same forms that aren't."""
    import random

    draw, out = random.Random(seed), []
    digits = lambda k: "".join(draw.choices("0123456789", k=k))
    hexes = lambda k: "".join(draw.choices("0123456789abcdef", k=k))
    word = lambda: "".join(draw.choices("aeioulmnrst", k=draw.randint(3, 8)))
    good = (
        lambda: ("phone", "call my phone ", f"{draw.randint(2, 9)}{digits(2)}-{draw.randint(2, 9)}{digits(2)}-{digits(4)}"),
        lambda: ("ssn", "his social security number is ", f"{draw.randint(100, 665)}-{draw.randint(10, 99)}-{draw.randint(1000, 9999)}"),
        lambda: ("secret", "the ", f"password={hexes(18)}"),
        lambda: ("secret", "set ", f'token = "{hexes(40)}"'),
        lambda: ("email", "mail to ", f"{word()}.{word()}(at){word()}(dot)com"),
        lambda: ("name", "a letter from ", f"Dr. {draw.choice(['Anna', 'Peter', 'Maria', 'Zora'])} {word().title()}"),
    )
    bad = (
        lambda: ("phone", "order ", f"0{digits(2)}-0{digits(2)}-{digits(4)}"),
        lambda: ("ssn", "part no ", f"000-00-{digits(4)}"),
        lambda: ("secret", "the ", f"password={draw.choice(['changeme', 'none', 'placeholder'])}{draw.choice(['', 's', '123'])}xxxx"),
    )
    for i in range(n):
        text, spans = "", []
        for _ in range(4):
            text += " ".join(word() for _ in range(draw.randint(3, 9))) + " "
            kind, lead, value = draw.choice(good + bad[: 3 if i % 2 else 1])()
            is_good = not (lead in ("order ", "part no ") or "xxxx" in value)
            text += lead
            start = len(text) + (value.index("=") + 1 + 2 * (value[value.index("=") + 1] == " ") if "=" in value else 4 if kind == "name" else 0)
            text += value
            end = len(text) - value.endswith('"')
            if is_good:
                spans.append((kind, start, end))
            text += ". "
        out.append((i, text, spans))
    return out


def test_precision_and_recall_of_added_spans(spark):
    rows = planted(400)
    got = {r.doc_id: r.spans for r in P.find(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    found = {(i, *x.split(":")) for i, spans in got.items() for x in spans.split(",") if x}
    true = {(i, kind, str(start), str(end)) for i, _, spans in rows for kind, start, end in spans}
    hit = len(found & true)
    assert hit / len(found) > 0.95 and hit / len(true) > 0.95, (hit, len(found), len(true))


def test_classifier_can_accept_what_the_strict_form_refuses(spark):
    rows = [(i, f"the password={i:09d}abcdef{i % 7} x") for i in range(300)] + [(1000 + i, f'token = "{i:020d}abcdef0123{i % 9}"') for i in range(300)]
    got = {r.doc_id: r.spans for r in P.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum("secret:13:29" in got[i] for i in range(300)) > 280  # sixteen characters are fewer than the strict form wants


def test_overlapping_candidates_of_one_start(spark):
    text = "reach anna at mail dot com dot org or anna(at)mail(dot)com, call 212-555-0199"
    rows = [(i, text) for i in range(50)]
    spans = {r.spans for r in P.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(spans) == 1
    places = sorted(tuple(map(int, x.split(":")[1:])) for x in spans.pop().split(","))
    assert all(a[1] <= b[0] for a, b in zip(places, places[1:], strict=False))
