"""Span columns: pattern hits with code-point offsets, their vetoes, claims, and texts rebuilt around them.

A text's parts between hits and the hits themselves, laid end to end, give every hit's offsets. The registry's own patterns are found by :mod:`.scan`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan
from .patterns import LABELLED, PASSES, SPECIFICITY, Pattern

EMPTY_SPANS = "array<struct<start:int,end:int,kind:string,rule:string,value:string,pass:int>>"


def spread(df: DataFrame, *keep: str | Column, items: Column | str, test: str = "start") -> DataFrame:
    """A row for each item of an array of structs.

    A plain explosion has Spark test the array's size first, which computes a costly array once more; here rows
    without items are made and dropped.
    """
    return df.select(*keep, F.inline_outer(items)).where(F.col(test).isNotNull())


def no_spans() -> Column:
    return F.array().cast(EMPTY_SPANS)


_BOUNDED = re.compile(r"^(\(\?i\))?\(\?<!(\[[^\]]*\])\)(\[[^\]]*\]|\\\+)(?:\{(\d+)\})?")


_RUN = re.compile(r"^(\(\?i\))?(\[[^\]]*\])\+@")


def quick(regex: str) -> str:
    """The same pattern with a leading "not after" moved behind its first character, if what follows may follow.

    The matcher then drops most places at their first character and looks back only from the rest. A pattern that begins
    with a run before an ``@`` is tried once for each run, from its start or from where the last hit ended.
    """
    run = _RUN.match(regex)
    if run is not None:
        flag, before = run.groups()
        return f"{flag or ''}(?:\\G|(?<!{before})){before}++@{regex[run.end() :]}"
    m = _BOUNDED.match(regex)
    if m is None:
        return regex
    flag, before, first, n = m.groups()
    rest = regex[m.end() :]
    if n is None and rest[:1] in ("+", "*", "?", "{"):
        return regex
    more = f"{first}{{{int(n) - 1}}}" if n and int(n) > 1 else ""
    follows = re.match(r"\[[^\]]*\](?:\{[1-9][0-9]*\}|(?![{*?+]))", more or rest)
    ahead = f"(?={follows[0]})" if follows else ""
    return f"{flag or ''}{first}{ahead}(?<!{before}{first}){more}{rest}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


_CHUNK = 64


def scanned(values: Column, zero: int, step: Callable[[Column, Column], Column]) -> Column:
    """For each item what ``step`` makes of all items before it; ``step`` is associative, and whole numbers are its items.

    Arrays can only be appended to by a copy, so it runs within chunks, and from chunk to chunk.
    """

    def running(items: Column, start: Column) -> Column:
        first = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        put = lambda a, v: F.struct(step(a["at"], v).cast("int").alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(items, first, put, lambda a: a["out"])

    def chunked(z: Column) -> Column:
        part = lambda k: F.slice(z, k * _CHUNK + 1, F.lit(_CHUNK))
        total = lambda k: F.aggregate(part(k), F.lit(zero), lambda t, v: step(t, v).cast("int"))
        chunks = F.sequence(F.lit(0), F.floor((F.greatest(F.size(z), F.lit(1)) - 1) / _CHUNK).cast("int"))
        return let(running(F.transform(chunks, total), F.lit(zero)), lambda bases: F.flatten(F.transform(bases, lambda base, k: running(part(k), base))))

    return let(values, chunked)


def offsets(sizes: Column) -> Column:
    """Where each item begins when items of these sizes are laid end to end."""
    return scanned(sizes, 0, lambda a, b: a + b)


_FAR = (1 << 31) - 1


def clear_of(spans: Column, taken: Callable[[Column], Column], body: Callable[[Column], Column] = lambda s: s) -> Column:
    """Of spans in order of their start: those that are ``taken``, and the others that overlap none of these.

    A sweep, in time proportional to the spans: a span is clear if none of the taken ones before it ends behind its start
    and none of those after it begins before its end.
    """
    ends = lambda b: scanned(F.transform(b, lambda s: F.when(taken(s), body(s)["end"]).otherwise(F.lit(0))), 0, F.greatest)
    starts = lambda b: F.reverse(scanned(F.reverse(F.transform(b, lambda s: F.when(taken(s), body(s)["start"]).otherwise(F.lit(_FAR)))), _FAR, F.least))

    def sweep(b: Column) -> Column:
        clear = lambda e, n: F.filter(b, lambda s, i: taken(s) | ((F.get(e, i) <= body(s)["start"]) & (F.get(n, i) >= body(s)["end"])))
        return let(ends(b), lambda e: let(starts(b), lambda n: clear(e, n)))

    return let(spans, sweep)


def disjoint(spans: Column, kind: str) -> Column:
    """Of spans in order of their start, greedily, those that begin behind the last one taken; ``kind`` is the array's type.

    Appending copies, so taken spans are kept in chunks.
    """
    state = lambda end, out: F.struct(end.alias("end"), out.alias("out"))
    nothing = F.array().cast(kind)

    def chunked(z: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.greatest(F.size(z), F.lit(1)) - 1) / _CHUNK).cast("int"))
        take = lambda a, s: F.when(s["start"] >= a["end"], state(s["end"], F.concat(a["out"], F.array(s)))).otherwise(a)
        one = lambda end, k: F.aggregate(F.slice(z, k * _CHUNK + 1, F.lit(_CHUNK)), state(end, nothing), take)
        whole = F.aggregate(chunks, state(F.lit(0), F.array().cast(f"array<{kind}>")), lambda a, k: let(one(a["end"], k), lambda x: state(x["end"], F.concat(a["out"], F.array(x["out"])))), lambda a: a["out"])
        return F.flatten(whole)

    return let(spans, chunked)


def hits(text: Column, regex: str, kind: str = "", rule: str = "", order: int = 0) -> Column:
    """Every hit as ``(start, end, kind, rule, value, pass)``, in order; offsets are half-open."""
    regex = quick(regex)
    gaps, found = F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    pairs = F.arrays_zip(found.alias("hit"), gaps.alias("gap"))  # the last gap has no hit after it

    def placed(pairs: Column) -> Column:
        starts = offsets(F.transform(pairs, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))))

        def span(starts: Column) -> Callable[[Column, Column], Column]:
            def at(x: Column, i: Column) -> Column:
                start = (F.get(starts, i) + F.length(x["gap"])).cast("int")
                return F.struct(start.alias("start"), (start + F.length(x["hit"])).cast("int").alias("end"), F.lit(kind).alias("kind"), F.lit(rule).alias("rule"), x["hit"].alias("value"), F.lit(order).alias("pass"))

            return at

        return let(starts, lambda s: F.filter(F.transform(pairs, span(s)), lambda x: x["value"].isNotNull()))

    return F.when(F.size(found) > 0, let(pairs, placed)).otherwise(no_spans())


def luhn(value: Column) -> Column:
    digits = F.regexp_replace(value, "[ -]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


VETOES: dict[str, Callable[[Column], Column]] = {
    "luhn": luhn,
    "seven": lambda v: F.length(F.translate(v, " -", "")) >= 7,
}


def guarded(text: Column, needs: str | None, spans: Column) -> Column:
    """``spans`` where the text passes the cheap test, else none: the test is far cheaper than the pattern."""
    if needs is None:
        return spans
    test = F.contains(text, F.lit(needs)) if needs.isalnum() or needs == "@" else text.rlike(needs)
    return F.when(test, spans).otherwise(no_spans())


def pattern_hits(text: Column, pattern: Pattern, order: int) -> Column:
    spans = hits(text, pattern.regex, pattern.name, pattern.name, order)
    if pattern.veto:
        check = VETOES[pattern.veto]
        spans = F.filter(spans, lambda s: check(s["value"]))
    return guarded(text, pattern.needs, spans)


def candidates(text: Column, passes: Sequence[Pattern] = PASSES, alone: bool = False) -> Column:
    """All passes' hits, in order of pass and place; bare twelve-digit numbers last, where the text names their card. A column
    ``alone`` is taken into no later filter, but may not stand in an aggregate."""
    return scan.candidates(text, tuple(passes), alone)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def meeting(spans: Column, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``body`` of a function from a span to those of ``spans`` that overlap it, as ``(start, end, i)``, ``i`` their place.

    They are held in chunks by their start, each with what it reaches over: a span is compared with few of very many.
    """
    sorted_ = F.sort_array(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.alias("i"))))
    reach = lambda part: F.struct(F.get(part, 0)["start"].alias("start"), F.array_max(F.transform(part, lambda x: x["end"])).alias("end"), part.alias("part"))

    def chunked(xs: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.greatest(F.size(xs), F.lit(1)) - 1) / _CHUNK).cast("int"))
        return F.transform(chunks, lambda k: let(F.slice(xs, k * _CHUNK + 1, F.lit(_CHUNK)), reach))

    def find(held: Column) -> Callable[[Column], Column]:
        return lambda s: F.flatten(F.transform(F.filter(held, lambda c: overlaps(c, s)), lambda c: F.filter(c["part"], lambda x: overlaps(x, s))))

    return let(let(sorted_, chunked), lambda held: body(find(held)))


def claimed(spans: Column) -> Column:
    """Earlier passes win; spans of later ones that overlap a winner go; the rest by start. A pass's own never overlap.

    Few spans are held against each other, many are swept pass by pass; the answer is the same.
    """
    fold = F.aggregate(spans, no_spans(), lambda acc, s: F.when(F.exists(acc, lambda k: overlaps(s, k)), acc).otherwise(F.concat(acc, F.array(s))))

    def one_pass(acc: Column, p: Column) -> Column:
        marked = lambda xs, old: F.transform(xs, lambda s: F.struct(s["start"].alias("at"), F.lit(old).alias("old"), s.alias("s")))
        both = F.array_sort(F.concat(marked(acc, True), marked(F.filter(spans, lambda s: s["pass"] == p), False)))
        return F.transform(clear_of(both, lambda x: x["old"], lambda x: x["s"]), lambda x: x["s"])

    passes = F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["pass"])))
    return F.when(F.size(spans) > _CHUNK, F.aggregate(passes, no_spans(), one_pass)).otherwise(F.array_sort(fold))


def labelled(text: Column) -> Column:
    """The labelled rules' hits, overlaps kept."""
    return scan.labelled(text)


def labelled_and_codes(text: Column) -> Column:
    """:func:`labelled`'s hits and all codes near words that speak of one, from one reading of the text."""
    return scan.labelled_and_codes(text)


def rules_of(found: Column) -> Column:
    return F.filter(found, lambda s: s["pass"] < len(LABELLED))


def codes_of(found: Column) -> Column:
    return F.filter(found, lambda s: s["pass"] == len(LABELLED))


def fresh_otp(codes: Column, spans: Column) -> Column:
    """Those of ``codes`` that no otp span covers."""
    covers = lambda k, s: (k["start"] <= s["start"]) & (k["end"] >= s["end"])
    return meeting(F.filter(spans, lambda k: k["kind"] == "otp"), lambda near: F.filter(codes, lambda s: ~F.exists(near(s), lambda k: covers(k, s))))


def nearby_otp(text: Column, spans: Column) -> Column:
    """For each word that speaks of a code, the first free-standing 4 to 8 digits within reach that no otp span covers."""
    return F.filter(scan.codes(text), lambda s: ~F.exists(spans, lambda k: (k["kind"] == "otp") & (k["start"] <= s["start"]) & (k["end"] >= s["end"])))


_RANKS = sorted({*SPECIFICITY.values(), 0}, reverse=True)


def suppressed(spans: Column) -> Column:
    """Spans inside a more specific or longer one go, as do twelve digits that overlap a card-like run.

    Few are held against each other in that order. Many are swept by their start: a span is inside another if one of those
    before it, of its own rank or a higher one, ends behind it. No card-like run lies in twelve digits, so such runs are
    settled first.
    """
    rank = lambda s: F.coalesce(*(F.when(s["kind"] == k, v) for k, v in SPECIFICITY.items()), F.lit(0))
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct((-rank(s)).alias("r"), (s["start"] - s["end"]).alias("n"), s["start"].alias("a"), s["pass"].alias("p"), s.alias("s"))))

    def keep(acc: Column, s: Column) -> Column:
        inside = F.exists(acc, lambda k: (s["start"] >= k["start"]) & (s["end"] <= k["end"]))
        on_card = (s["kind"] == "aadhaar") & F.exists(acc, lambda k: (k["kind"] == "card-like") & overlaps(s, k))
        return F.when(inside | on_card, acc).otherwise(F.concat(acc, F.array(s)))

    def outer(xs: Column) -> Column:
        by_start = F.array_sort(F.transform(xs, lambda x: F.struct(x["a"].alias("a"), x["n"].alias("n"), x["r"].alias("r"), x["p"].alias("p"), x["s"].alias("s"))))

        def sweep(b: Column) -> Column:
            ends = F.transform(F.array(*map(F.lit, _RANKS)), lambda v: scanned(F.transform(b, lambda x: F.when(x["r"] <= -v, x["s"]["end"]).otherwise(F.lit(0))), 0, F.greatest))
            place = lambda x: F.array_position(F.array(*map(F.lit, _RANKS)), -x["r"]).cast("int")
            return let(ends, lambda e: F.filter(b, lambda x, i: F.get(F.element_at(e, place(x)), i) < x["s"]["end"]))

        return let(by_start, sweep)

    def many(xs: Column) -> Column:
        is_bare = lambda x: x["s"]["kind"] == "aadhaar"
        before = lambda k, x: F.struct(k["n"], k["a"], k["p"]) < F.struct(x["n"], x["a"], x["p"])  # noqa: E731  of one rank
        cards = F.filter(outer(F.filter(xs, lambda x: ~is_bare(x))), lambda x: x["s"]["kind"] == "card-like")
        free = lambda c: F.filter(xs, lambda x: ~is_bare(x) | ~F.exists(c, lambda k: before(k, x) & overlaps(k["s"], x["s"])))
        return F.transform(outer(let(cards, free)), lambda x: x["s"])

    few = F.aggregate(F.transform(keyed, lambda x: x["s"]), no_spans(), keep)
    return F.array_sort(F.when(F.size(spans) > _CHUNK, let(keyed, many)).otherwise(few))


def kinds_of(spans: Column) -> Column:
    return F.array_distinct(F.transform(spans, lambda s: s["kind"]))


def rendered(text: Column, spans: Column, put: Callable[[Column], Column], keep: Callable[[Column, Column, Column], Column] = lambda g, before, after: g) -> Column:
    """The text with every span (sorted, disjoint) replaced by ``put`` of it, and what lies between by ``keep`` of it and of
    whether a span goes before and after it."""

    def pieces(text: Column, spans: Column) -> Column:
        last = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))

        def part(k: Column) -> Column:
            """Later spans are cut from their own stretch of the text, for a place in a text is counted from its begin."""
            lo, n = last(k * _CHUNK), F.least(F.size(spans), (k + 1) * _CHUNK)
            stretch = F.when(k > 0, F.substr(text, lo + 1, last(n) - lo)).otherwise(text)
            one = lambda t, s, b, i: F.concat(keep(F.substr(t, b - lo + 1, s["start"] - b), i > 0, F.lit(True)), put(s))
            return let(stretch, lambda t: F.transform(F.slice(spans, k * _CHUNK + 1, F.lit(_CHUNK)), lambda s, i: one(t, s, last(k * _CHUNK + i), k * _CHUNK + i)))

        chunks = F.filter(F.sequence(F.lit(0), F.floor((F.greatest(F.size(spans), F.lit(1)) - 1) / _CHUNK).cast("int")), lambda k: k * _CHUNK < F.size(spans))
        tail = keep(F.substr(text, last(F.size(spans)) + 1, F.length(text)), F.size(spans) > 0, F.lit(False))
        return F.when(spans.isNotNull(), F.array_join(F.concat(F.flatten(F.transform(chunks, part)), F.array(tail)), ""))

    return let(text, lambda t: let(spans, lambda s: pieces(t, s)))


def rebuilt(text: Column, regex: str, put: Callable[[Column], Column], keep: Callable[[Column], Column] = lambda g: g) -> Column:
    """The text with every hit of ``regex`` replaced by ``put`` of its value, and what lies between by ``keep`` of it."""
    gaps, found = F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    pairs = F.arrays_zip(found.alias("hit"), gaps.alias("gap"))  # the last gap has no hit after it
    return F.array_join(F.transform(pairs, lambda x: F.concat(keep(x["gap"]), F.coalesce(put(x["hit"]), F.lit("")))), "")


def blanked(text: Column, regex: str) -> Column:
    """Hits replaced by as many spaces."""
    return rebuilt(text, regex, lambda v: F.repeat(F.lit(" "), F.length(v)))


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)
