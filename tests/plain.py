"""The rules written out in Python, one text or one group at a time, for tests of queries that SQL can't say."""

import re

from veilspark.functions import patterns as P
from veilspark.operators import tokens as K


def luhn(v):
    d = [int(c) for c in v if c.isdigit()]
    return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2) for i, x in enumerate(reversed(d))) % 10 == 0


def claimed(text, passes=P.PASSES):
    """(start, end, kind, value, pass) by start."""
    out = []
    vetoes = {"luhn": luhn, "seven": lambda v: len(re.sub("[ -]", "", v)) >= 7}
    rules = [(p.name, p.regex, vetoes.get(p.veto)) for p in passes]
    if re.search(P.AADHAAR_WORDS, text):
        rules.append(("aadhaar", P.AADHAAR_BARE, None))
    for i, (name, regex, veto) in enumerate(rules):
        for m in re.finditer(regex, text, re.A):
            if (veto is None or veto(m[0])) and not any(m.start() < e and s < m.end() for s, e, *_ in out):
                out.append((m.start(), m.end(), name, m[0], i))
    return sorted(out)


def labelled(text):
    """(start, end, kind, rule, value, place of the rule), overlaps kept, in the order of the rules."""
    return [(m.start(), m.end(), kind, rule, m[0], i) for i, (rule, kind, regex) in enumerate(P.LABELLED) for m in re.finditer(regex, text, re.A)]


def nearby(text, spans):
    out = []
    for m in re.finditer(P.OTP_WORDS, text, re.A):
        d = re.search(r"(?<![A-Za-z0-9_])[0-9]{4,8}(?![A-Za-z0-9_])", text[m.start() : m.start() + P.OTP_REACH], re.A)
        if d:
            s, e = m.start() + d.start(), m.start() + d.end()
            row = (s, e, "otp", "otp-nearby-digits", d[0], len(P.LABELLED))
            if not any(k[2] == "otp" and k[0] <= s and k[1] >= e for k in spans) and row not in out:
                out.append(row)
    return out


def sensitive(text):
    """The labelled spans that count, by start."""
    rules = labelled(text)
    kept = []
    for s in sorted(rules + nearby(text, rules), key=lambda s: (-P.SPECIFICITY.get(s[2], 0), s[0] - s[1], s[0], s[5])):
        inside = any(s[0] >= k[0] and s[1] <= k[1] for k in kept)
        on_card = s[2] == "aadhaar" and any(k[2] == "card-like" and s[0] < k[1] and k[0] < s[1] for k in kept)
        if not inside and not on_card:
            kept.append(s)
    return sorted(kept)


def replaced(text, spans, put):
    """Spans (sorted, disjoint) replaced by what ``put`` says of each."""
    out, at = "", 0
    for s in spans:
        out, at = out + text[at : s[0]] + put(s), s[1]
    return out + text[at:]


def model_spans(doc, text):
    """(start, end, type, value, label, score)."""
    out = []
    for m in re.finditer(r"[A-Z][a-z]{4,7}(?![A-Za-z])", text):
        city = m.start() % 2
        out.append((m.start(), m.end(), "CITY" if city else "PERSONNAME", m[0], "city" if city else "person name", (m.start() * 7 + doc) % 100 / 100.0))
    return out


def merged(rules, model):
    """Rules' spans, then the model's that overlap nothing kept: (start, end, type, value, label, score, layer)."""
    kept = [(*s, "regex") for s in rules]
    for s in sorted(model):
        if not any(s[0] < k[1] and k[0] < s[1] for k in kept):
            kept.append((*s, "model"))
    return kept


def band(score, label, layer):
    floor = K.FLOOR_BY_LABEL.get(label, K.FLOOR)
    return "certain" if layer == "regex" or score >= K.STRIP_THRESHOLD else "uncertain" if score >= floor else "ignored"


def minted(spans):
    """(scope, type, value) -> (token, number), from (scope, source, start, type, value)."""
    first = {}
    for scope, source, start, kind, value in spans:
        key = (scope, kind, value)
        first[key] = min(first.get(key, (source, start)), (source, start))
    out, n = {}, {}
    for key in sorted(first, key=lambda k: (k[0], k[1], first[k], k[2])):
        n[key[:2]] = n.get(key[:2], 0) + 1
        out[key] = (f"{key[1]}#{n[key[:2]]}", n[key[:2]])
    return out


def iou(a, b):
    """Of boxes (x, y, w, h)."""
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    shared = w * h if w > 0 and h > 0 else 0.0
    union = a[2] * a[3] + b[2] * b[3] - shared
    return shared / union if union > 0 else 0.0


def cells(boxes):
    """The unit-free area under boxes, by the grid of all their edges."""
    xs = sorted({v for x, _, w, _ in boxes for v in (x, x + w)})
    ys = sorted({v for _, y, _, h in boxes for v in (y, y + h)})
    area = 0.0
    for x0, x1 in zip(xs, xs[1:], strict=False):
        over = [b for b in boxes if b[0] < x1 and b[0] + b[2] > x0]
        area += (x1 - x0) * sum(y1 - y0 for y0, y1 in zip(ys, ys[1:], strict=False) if any(b[1] < y1 and b[1] + b[3] > y0 for b in over))
    return area
