"""The scanner's hits against those of the patterns as columns, over odd texts; and how texts are dealt out."""

import random
import re
import time

from pyspark.sql import functions as F

from veilspark.functions import patterns as P
from veilspark.functions import scan
from veilspark.functions import spans as S
from veilspark.plans import inputs

PARTS = ["6-digit code 1234", "one-time password: 9999", "login code 4321", "security code = 123", "4111 1111 1111 1111", "1234 5678 9012", "98765 43210", *(
    "a.b+c@d.example.com x@y.co-z@w.org @@ .a@b.upi ab@ybl A@UPI -q.r@ok.in a@b.c1.comx é@ü.de 😀u@v.net ABCDE1234F abcde1234f ABCDEF1234G K1234567 kk1234567 "
    "4111 1111 1111 1111 4111-1111-1111-1112 1234 5678 9012 1234-5678-9012 123456789012 aadhaar UIDAI +919876543210 +91 6876543210 987 654 3210 98765 43210 9876543210 "
    "+44 20 7946 0958 +1-2345678 +12 34 SBIN0123456 sbin0abcdef ABC1234567 22ABCDE1234F1Z5 otp is 123456 one-time password: 9999 login code 4321 6-digit code 1234 6 digit pin 12345678 "
    "cvv 123 security code = 1234 password: hunter22 secret=s3cr3t token पैन आधार pin code 0 00 . - + ( ) \n \t _ İ ſ K é 😀 x 7 -- .. 1 2 3 12 34"
).split(" ")]


def odd_texts(n, seed=3):
    r = random.Random(seed)
    return ["", "@", "0", "a@", *("".join(r.choice(PARTS) + r.choice(["", " ", "", "\n", "-", " "]) for _ in range(r.randint(1, 30))) for _ in range(n))]


def as_columns(text):
    passes = [S.pattern_hits(text, p, i) for i, p in enumerate(P.PASSES)]
    bare = F.when(text.rlike(P.AADHAAR_WORDS), S.hits(text, P.AADHAAR_BARE, "aadhaar", "aadhaar", len(P.PASSES))).otherwise(S.no_spans())
    return F.concat(*passes, bare), F.concat(*(S.hits(text, regex, kind, rule, i) for i, (rule, kind, regex) in enumerate(P.LABELLED)))


def test_scanned_hits_are_those_of_the_columns(spark):
    docs = spark.createDataFrame([(t,) for t in [*odd_texts(1500), None]], "text string").repartition(8)
    text = F.col("text")
    found, rules = as_columns(text)
    rows = docs.select(text, S.candidates(text).alias("a"), found.alias("b"), S.labelled(text).alias("c"), rules.alias("d")).collect()
    assert len(rows) == 1505 and sum(len(r.a) for r in rows) > 1500 and {s.rule for r in rows for s in r.c} == {rule for rule, _, _ in P.LABELLED}
    for r in rows:
        assert r.a == r.b and r.c == r.d, r.text


def test_long_runs_take_time_in_proportion():
    find = [scan.places(p.regex) for p in P.PASSES] + [scan.places(regex) for _, _, regex in P.LABELLED[:2]]
    for text in ("a." * 100_000, "a" * 200_000 + "@", "1" * 200_000, "a@" * 100_000):
        start = time.time()
        assert all(len(list(f(text))) <= 1 for f in find)
        assert time.time() - start < 10


def test_scanning_is_faster_than_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text").repartition(8).cache()
    docs = docs.crossJoin(spark.range(3)).select("text")

    def seconds(column):
        start = time.time()
        docs.select(F.sum(F.size(column))).collect()
        return time.time() - start

    text = F.col("text")
    ways = (F.concat(S.candidates(text), S.labelled(text)), F.concat(*as_columns(text)))
    fast, slow = (min(seconds(w) for _ in range(2)) for w in ways)
    assert fast * 1.5 < slow


def test_prose_is_read_once_for_all_patterns():
    text = "Er of tionatti the of, inoran erin nt hawhti. " * 40_000 + "one pin is 1234"
    found = [scan.places(p.regex) for p in P.PASSES] + [scan.places(regex, P.LABEL_NEEDS.get(rule)) for rule, _, regex in P.LABELLED]
    mark, digits = scan.marker(found), re.compile("[0-9]+")

    def seconds(read):
        times = []
        for _ in range(3):
            start = time.time()
            read()
            times.append(time.time() - start)
        return min(times)

    def all_patterns():
        marks = mark(text)
        return [hit for find in found for hit in find(text, marks)]

    assert [text[a:b] for a, b in all_patterns()] == ["pin"]
    assert seconds(all_patterns) < 15 * seconds(lambda: list(digits.finditer(text)))


def test_first_words_are_what_a_pattern_begins_with():
    assert scan.first_words(r"(?i)(?<![a-z])(?:otp|one[\s-]?time\s(?:code|pin)|auth(?:ent)?\s|pins?|2fa\scode)(?![a-z])x|y") == ("otp", "one", "auth", "pin", "2fa")
    assert scan.first_words(P.AADHAAR_WORDS) == ("aadhaar", "aadhar", "uidai") and not scan.first_words(P.AADHAAR_BARE)


def test_texts_of_one_row_group_are_dealt_out(spark, sf, monkeypatch):
    """A row group is read by one task, however many blocks its file has."""
    monkeypatch.setattr(inputs, "BLOCK_BYTES", 1 << 10)
    assert inputs.texts(spark, sf).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
