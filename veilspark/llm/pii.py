"""Personal data by weak supervision.

Fixed rules find e-mail addresses, IP addresses, card and phone numbers; these spans always stay. Wider patterns
propose further spans (addresses spelled out, phone and card numbers in other shapes, secrets, social security
numbers, names after a title), and on each of them labelers vote for, against or not at all: a strict form of the
pattern (regex), lists of words and values (gazetteer), the words around it (context), and what it is made of (shape).

The votes of all candidates in all texts are counted by kind and pattern of votes, a table whose size doesn't depend
on the corpus. On it, expectation-maximisation estimates each labeler's reliability and each pattern's probability. A
logistic classifier of each kind, over the votes, the span's shape and the words around it, is trained to those
probabilities on a bounded sample of candidates (``TRAIN`` of each kind, by a digest of their places). The candidates
that it accepts and that touch no fixed span, nor an accepted one before them, are added.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, ship, uniform

ship(__name__)

KINDS = ("email", "ip", "card", "phone")
MORE = ("email", "card", "phone", "ssn", "secret", "name")
LABELERS = ("regex", "listed", "context", "shape")
ACCEPT = 0.5
TRAIN = 2000
FEATURES = 256
_ROUNDS = 50
_WINDOW = 40  # characters before a span that give its context; half as many behind it

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Kind, what a text must hold to be searched (lower case), the wide pattern, its strict form.
_WIDE = (
    ("email", (" at ", "(at)", "[at]"), re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(]? ?at ?[\])]? ?[A-Za-z0-9-]{1,63}(?: ?[\[(]? ?dot ?[\])]? ?[A-Za-z]{2,24}){1,3}"), re.compile(r"[a-z0-9._]{2,} ?[\[(]at[\])] ?\w+ ?[\[(]dot[\])] ?(?:com|org|net|de|fr|es|io|example|test)", re.I)),
    ("card", None, re.compile(r"(?<![0-9.])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9]|\.[0-9])"), re.compile(r"[3-6].*")),
    ("phone", None, re.compile(r"(?<![0-9.+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-]|\.[0-9])"), re.compile(r"\(?[2-9][0-9]{2}\)?[ .-][2-9].*")),
    ("ssn", None, re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}")),
    ("secret", ("token", "secret", "key", "password"), re.compile(r"""(?i:token|secret|api_?key|password)\s{0,3}[:=]\s{0,3}["']?([A-Za-z0-9_/+=-]{8,200})"""), re.compile(r"(?=.*[0-9])(?=.*[a-z])[A-Za-z0-9_/+=-]{20,}")),
    ("name", ("mr. ", "mrs. ", "ms. ", "dr. "), re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr)\. ([A-Z][a-z]{1,20}(?: [A-Z][a-z]{1,20})?)"), re.compile(r"[A-Z][a-z]+ [A-Z][a-z]+")),
)
#: Words that name each kind; a candidate's context votes by them.
_CONTEXT = {
    "email": ("mail", "contact", "write", "reach", "address"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "contact"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("token", "secret", "key", "password", "credential"),
    "name": ("name", "dear", "patient", "contact", "by"),
}
#: Words around a candidate that speak against any personal data.
_OTHER = ("order", "invoice", "version", "isbn", "part no", "item", "page", "room", "model", "serial", "release", "chapter", "score", "born in", "street")
#: Values, or parts of them, that speak for a kind; for cards and phones their first digits.
_LISTED = {
    "email": ("gmail", "example", "mail", "yahoo", "outlook", "proton", "icloud", "web"),
    "card": ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65"),
    "phone": ("800", "888", "877", "212", "213", "310", "312", "415", "512", "617", "646", "702", "718", "917"),
    "ssn": (),
    "secret": ("sk_", "ghp_", "akia", "xox", "bearer", "eyj"),
    "name": tuple("anna ben carla carlos claire daniel david elena emma eric eva frank grace hans helen ines james jan john jorge jose juan julia karl laura lena linda lucas luis maria mark martin mary michael nina olga oscar paul pedro peter robert rosa sara simon sofia thomas".split()),
}
_AGAINST = ("xxxx", "0000", "1234567", "example_key", "your_", "changeme", "placeholder", "none", "null", "true", "false", "dummy")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from the ``@`` outwards, which is linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind's place, end)`` of the fixed rules' spans, in order."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    first = _DIGIT.search(text)
    if first:
        for m in _IP.finditer(text, first.start()):
            if all(len(p) < 4 and int(p or 0) < 256 for p in (x.lstrip("0") for x in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text, first.start()):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _for(test: bool, against: bool = False) -> int:
    return 2 if test else 0 if against else 1


def _shaped(kind: str, value: str, digits: str) -> int:
    """The vote of what a value is made of."""
    kinds = len(set(value.lower()))
    if kind == "secret":
        letters, length = any(c.isalpha() for c in value), len(value)
        return _for(bool(digits) and letters and kinds >= 6 and length >= 10, kinds < 5 or not digits and length < 16)
    if kind == "name":
        return _for(" " in value, len(value) < 3)
    if kind == "email":
        return _for(value.count(" ") <= 4 and ("(" in value or "[" in value), value.count(" ") > 6)
    return _for(len(set(digits)) >= 4, len(set(digits)) < 3)


def _features(value: str, before: str, after: str, votes: tuple[int, ...]) -> list[int]:
    """Places of the classifier's columns that are one: votes, length band, form of the value, words around it."""
    size = len(value)
    out = {0, *(1 + 3 * i + v for i, v in enumerate(votes)), 13 + (0 if size < 12 else 1 if size < 24 else 2)}
    form = re.sub(r"(.)\1+", r"\1", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", value))))
    names = [f"form {form[:24]}", *(f"in {form[i : i + 3]}" for i in range(min(8, len(form))))]
    names += [f"before {w}" for w in re.findall(r"\w+", before)[-3:]] + [f"after {w}" for w in re.findall(r"\w+", after)[:1]]
    return sorted(out | {16 + zlib.crc32(n.encode("utf-8", "surrogatepass")) % (FEATURES - 16) for n in names})


def candidates(text: str) -> Iterator[tuple[int, int, int, int, int, int, int, list[int]]]:
    """``(kind's place in MORE, start, end, the four labelers' votes, features)``; a vote is 0 against, 1 none, 2 for."""
    lowered, found = None, _DIGIT.search(text)
    for place, (kind, needed, wide, strict) in enumerate(_WIDE):
        if needed is None:
            if not found:
                continue
        else:
            lowered = text.lower() if lowered is None else lowered
            if not any(n in lowered for n in needed):
                continue
        for m in wide.finditer(text):
            start, end = m.span(m.lastindex or 0)
            value = text[start:end]
            low, digits = value.lower(), "".join(c for c in value if c in "0123456789")
            before, after = text[max(0, start - _WINDOW) : start].lower(), text[end : end + _WINDOW // 2].lower()
            exact = strict.fullmatch(value) is not None and (kind != "card" or luhn(digits))
            known = digits.startswith(_LISTED[kind]) if kind in ("card", "phone") else any(w in low for w in _LISTED[kind])
            near = any(w in before or w in after for w in _CONTEXT[kind])
            votes = (_for(exact, True), _for(known, any(a in low for a in _AGAINST)), _for(near, any(w in before for w in _OTHER)), _shaped(kind, value, digits))
            if any(a in low for a in _AGAINST):
                votes = (votes[0], 0, *votes[2:])
            yield place, start, end, *votes, _features(value, before, after, votes)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``fixed`` spans and ``more`` candidates. Null texts are empty."""
    at = docs.columns.index(text)
    fixed = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    names = ("kind", "start", "end", *LABELERS)
    more = pa.list_(pa.struct([*((n, pa.int64()) for n in names), ("features", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for raw in batch.column(at):
                value = raw.as_py() or ""
                a.append([dict(zip(("start", "kind", "end"), x, strict=True)) for x in fixed_spans(value)])
                b.append([dict(zip((*names, "features"), x, strict=True)) for x in candidates(value)])
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(a, fixed), pa.array(b, more)], [*(n for n in batch.schema.names if n != text), "fixed", "more"])

    fields = [f for f in docs.schema.fields if f.name != text]
    return docs.mapInArrow(run, T.StructType([*fields, *T._parse_datatype_string(f"fixed array<struct<start:long,kind:int,end:long>>, more array<struct<{','.join(f'{n}:long' for n in names)},features:array<int>>>").fields]))


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = _ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over patterns of votes (rows) that occur ``counts`` times.

    Returns each pattern's probability of being right, and each labeler's chances of its three votes on wrong and on
    right spans. It starts from the share of votes for and smooths all chances by one count.
    """
    cast = (votes == 2).sum(axis=1) + (votes == 0).sum(axis=1)
    p = ((votes == 2).sum(axis=1) + 0.5) / (cast + 1)
    for _ in range(rounds):
        weight = np.stack([(1 - p) * counts, p * counts])
        prior = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        chance = np.stack([[[(w * (votes[:, j] == v)).sum() + 1 for v in range(3)] for j in range(votes.shape[1])] for w in weight])
        chance /= chance.sum(axis=2, keepdims=True)
        log = np.log(prior)[:, None] + sum(np.log(chance[:, j, votes[:, j]]) for j in range(votes.shape[1]))
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return p, chance


def classifier(x: np.ndarray, p: np.ndarray, counts: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression on rows ``x`` to probabilities ``p``, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counts * (q - p)) + ridge * w
        bend = (x * (counts * q * (1 - q) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(bend, slope)
    return w


def trained(scanned: DataFrame) -> np.ndarray:
    """The weights of each kind's classifier, a row of ``FEATURES``; a kind without candidates accepts none."""
    rows = scanned.select("id", F.inline("more"))
    counts = rows.groupBy("kind", *LABELERS).count().collect()  # 6 kinds x 81 patterns at most
    weights = np.zeros((len(MORE), FEATURES))
    weights[:, 0] = -30.0
    chance: dict[tuple[int, ...], float] = {}
    rates = [0.0] * len(MORE)
    for kind in range(len(MORE)):
        own = sorted((*(r[x] for x in LABELERS), r["count"]) for r in counts if r.kind == kind)
        if own:
            table = np.array(own)
            p, _ = reliabilities(table[:, :-1], table[:, -1].astype(float))
            chance |= {(kind, *map(int, v[:-1])): float(q) for v, q in zip(table, p, strict=True)}
            rates[kind] = TRAIN / table[:, -1].sum()
    if not chance:
        return weights
    drawn = uniform(F.concat_ws(":", F.col("id").cast("string"), F.col("start").cast("string")), "pii:")
    rate = F.get(F.array(*map(F.lit, rates)), F.col("kind").cast("int"))
    picked = rows.where(drawn < rate).limit(2 * TRAIN * len(MORE)).collect()  # about TRAIN of each kind
    for kind in range(len(MORE)):
        own = sorted(((tuple(r.features), chance[(kind, *(r[x] for x in LABELERS))]) for r in picked if r.kind == kind))
        if own:
            x = np.zeros((len(own), FEATURES))
            for i, (at, _) in enumerate(own):
                x[i, list(at)] = 1
            weights[kind] = classifier(x, np.array([q for _, q in own]), np.ones(len(own)), rounds=12)
    return weights


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: counts and digest of the fixed spans, and all spans.

    Null texts are empty and hold nothing; rows are judged each, repeats alike; of added spans that overlap the first
    stays, of one start the longest, of one place the kind named first; a very long text is scanned whole, in one task;
    columns of other names are left behind; an empty table gives an empty table.
    """
    scanned = materialize(scan(docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))), "spans")
    sent = docs.sparkSession.sparkContext.broadcast(trained(scanned))
    columns = ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, least, order = sent.value, np.log(ACCEPT / (1 - ACCEPT)), [*KINDS, *(k for k in MORE if k not in KINDS)]
        for batch in batches:
            out: list[tuple] = []
            for fixed, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = [(s["start"], s["kind"], s["end"]) for s in fixed]
                base = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
                taken = list(spans)
                for c in sorted(more, key=lambda c: (c["start"], -c["end"], c["kind"])):
                    if weights[c["kind"], c["features"]].sum() >= least and all(c["end"] <= s or e <= c["start"] for s, _, e in taken):
                        taken.append((c["start"], order.index(MORE[c["kind"]]), c["end"]))
                counts = [sum(k == i for _, k, _ in spans) for i in range(len(KINDS))]
                out.append((*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{order[k]}:{s}:{e}" for s, k, e in sorted(taken))))
            kinds = [*[pa.int64()] * len(KINDS), pa.string(), pa.string()]
            rest = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rest], columns)

    id_type = scanned.schema["id"].dataType.simpleString()
    return scanned.select("id", "fixed", "more").mapInArrow(run, f"id {id_type}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string").withColumnRenamed("id", id_col)
