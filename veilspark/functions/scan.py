"""The fixed patterns over whole texts, in tasks: offsets in code points.

As column expressions a pattern reads a text three times over. Here a text is read once for its digits and once for the
words that rules begin with; a pattern is tried only where its hits can begin. ``tests/test_scan.py`` holds the hits
against those of the columns.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import AADHAAR_BARE, AADHAAR_WORDS, LABEL_NEEDS, LABELLED, OTP_REACH, OTP_WORDS, Pattern

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPANS = "array<struct<start:int,end:int,kind:string,rule:string,value:string,pass:int>>"
_ITEM = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("rule", pa.string()), ("value", pa.string()), ("pass", pa.int32())])

_CLASS = r"\[[^\]]*\]"
_AT = re.compile(rf"^(\(\?i\))?(\(\?<!{_CLASS}\))?({_CLASS})(\+|\{{2,\}})@")
_LETTERS = re.compile(rf"^(\(\?i\))?(\(\?<!{_CLASS}\))(\[[A-Za-z-]+\])(?:\{{(\d+)\}})?(\[0-9\]\{{\d+\}}|0)(?=\[|\()")
_DIGITS = re.compile(rf"^(\(\?i\))?\(\?<!{_CLASS}\)(?:\[[0-9]-9\](?![*?])|\(\?:\[0-9\][^()]*\)\{{(?:[1-9]|0,1\}}\(\?:[0-9]))")
_PLUS = re.compile(rf"^(\(\?<!{_CLASS}\))(\\\+)(?![*?+])")
_SIGNED = re.compile(r"^\\\+\?\[0-9\]\[0-9[^\]]*\]\{\d+,\}\[0-9\]$")
_WORDS = re.compile(rf"^\(\?i\)(?:\(\?<!{_CLASS}\)\(\?:(?=\w)|(?=\w))")
_WORD = re.compile(r"[A-Za-z0-9_]")
_RUN = re.compile(r"[0-9]+")


def first_words(regex: str) -> tuple[str, ...]:
    """What the alternatives that a pattern begins with begin with, in lower case; none if it doesn't begin with words."""
    m = _WORDS.match(regex)
    if m is None:
        return ()
    depth, alternatives = 0, [""]
    for c in regex[m.end() :]:
        depth += (c in "([") - (c in ")]")
        if depth < 0:
            break
        if c == "|" and depth == 0:
            alternatives.append("")
        else:
            alternatives[-1] += c
    return tuple(re.match(r"[^\\\[\](){}.*+?|^$]*(?![*?{])", x)[0].lower() for x in alternatives)


def automaton(words: Iterable[str]):  # noqa: ANN201
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in words:
        found.add_word(word, word)
    found.make_automaton()
    return found


class Marks:
    """Where a text's runs of digits begin, and its words of an automaton, in either case; each is looked for once."""

    def __init__(self, text: str, words: object) -> None:
        self._text, self._words = text, words

    @cached_property
    def runs(self) -> list[int]:
        return [m.start() for m in _RUN.finditer(self._text)]

    @cached_property
    def words(self) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for last, word in self._words.iter(self._text.encode().lower().decode()):  # bytes: only ASCII letters are lowered
            out.setdefault(word, []).append(last + 1 - len(word))
        return out


class Places:
    """From a text to where the pattern's hits begin and end, in order; ``needs`` is a cheap test of the text."""

    def __init__(self, regex: str, needs: str | None = None) -> None:
        at, letters, self.words = _AT.match(regex), _LETTERS.match(regex), first_words(regex)
        self._find: Callable[[str, Marks], Iterator[tuple[int, int]]]
        if at is not None:
            flag, bound, run, least = at.groups()
            of = _at_places(re.compile(f"{flag or ''}@{regex[at.end() :]}", re.ASCII), re.compile(run), bound is not None, 1 if least == "+" else 2)
            self._find = lambda text, marks: of(text)
        elif letters is not None and regex.endswith("(?![A-Za-z0-9_])"):
            # letters before a run of digits are looked back at; between word boundaries no hit begins inside another
            flag, bound, first, n, mark = letters.groups()
            n = int(n or 1)
            late = re.compile(f"{flag or ''}{mark}(?<={bound}{first}{{{n}}}{mark}){regex[letters.end() :]}", re.ASCII)
            self._find = lambda text, marks: ((a - n, b) for a, b in _tried(late, text, marks.runs))
        elif _DIGITS.match(regex):
            # no digit is before the first one
            whole = re.compile(regex, re.ASCII)
            self._find = lambda text, marks: _tried(whole, text, marks.runs)
        elif _SIGNED.match(regex):
            # a hit ends with a run's last digit, and where none begins at a run's first digit, none does inside the run
            whole = re.compile(regex, re.ASCII)
            self._find = lambda text, marks: _tried(whole, text, (a - 1 if text[a - 1 : a] == "+" else a for a in marks.runs))
        elif self.words:
            whole = re.compile(regex, re.ASCII)
            self._find = lambda text, marks: _tried(whole, text, sorted({a for w in self.words for a in marks.words.get(w, ())}))
        else:
            plus = _PLUS.match(regex)
            if plus is not None:
                regex = f"{plus[2]}(?<={plus[1]}{plus[2]}){regex[plus.end() :]}"
            whole, test = re.compile(regex, re.ASCII), re.compile(needs or "", re.ASCII)
            self._find = lambda text, marks: (m.span() for m in whole.finditer(text)) if test.search(text) else iter(())

    def __call__(self, text: str, marks: Marks | None = None) -> Iterator[tuple[int, int]]:
        return self._find(text, marks or Marks(text, automaton(self.words)))


places = Places


def _tried(pattern: re.Pattern, text: str, starts: Iterable[int]) -> Iterator[tuple[int, int]]:
    """The hits that begin at ``starts``, in order, but for those inside the one before."""
    end = 0
    for at in starts:
        m = pattern.match(text, at) if at >= end else None
        if m is not None:
            end = m.end()
            yield m.span()


def marker(found: Iterable[Places]) -> Callable[[str], Marks]:
    words = automaton({w for find in found for w in find.words})
    return lambda text: Marks(text, words)


def _at_places(rest: re.Pattern, run: re.Pattern, bounded: bool, least: int) -> Callable[[str], Iterator[tuple[int, int]]]:
    """A run, an ``@`` and the rest: it begins where its run does or the last hit ended, if need be not inside a word."""

    def find(text: str) -> Iterator[tuple[int, int]]:
        end, at = 0, text.find("@")
        while at >= 0:
            m = rest.match(text, at)
            start = at
            while m and start > end and run.match(text[start - 1]):
                start -= 1
            while m and bounded and 0 < start < at and _WORD.match(text[start - 1]):
                start += 1
            if m and at - start >= least:
                end = m.end()
                yield start, end
            at = text.find("@", max(at + 1, end))

    return find


def luhn(value: str) -> bool:
    digits = [int(c) for c in value if c not in " -"]
    if not 13 <= len(digits) <= 19:
        return False
    return (sum(digits[-1::-2]) + sum(d * 2 - 9 * (d > 4) for d in digits[-2::-2])) % 10 == 0


VETOES: dict[str, Callable[[str], bool]] = {"luhn": luhn, "seven": lambda v: len(v) - v.count(" ") - v.count("-") >= 7}


def _column(text: Column, spans_of: Callable[[str], list[tuple]], alone: bool = False) -> Column:
    """A column of spans, none for a null text; ``alone`` keeps later filters from taking it into their own conditions."""

    def scan(texts: pa.Array) -> pa.Array:
        ends, flat = [0], []
        for text in texts:
            flat += spans_of(text.as_py()) if text.is_valid else ()
            ends.append(len(flat))
        fields = list(zip(*flat, strict=True)) or [()] * len(_ITEM)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(fields, _ITEM, strict=True)], fields=list(_ITEM)))

    scan.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(scan, SPANS)
    return (udf.asNondeterministic() if alone else udf)(text)


def hits(text: Column, regex: str) -> Column:
    """Every hit of one pattern, without a kind or a rule."""

    def build() -> Callable[[str], list[tuple]]:
        pattern = re.compile(regex, re.ASCII)
        return lambda text: [(*m.span(), "", "", m[0], 0) for m in pattern.finditer(text)]

    return _column(text, _once(build))


def candidates(text: Column, passes: tuple[Pattern, ...], alone: bool = False) -> Column:
    """All passes' hits, in order of pass and place; bare twelve-digit numbers last, where the text names their card."""
    rules = [(p.regex, p.name, VETOES.get(p.veto or "")) for p in passes]

    def build() -> Callable[[str], list[tuple]]:
        found = [(places(regex), name, veto, i) for i, (regex, name, veto) in enumerate(rules)]
        words, bare = places(AADHAAR_WORDS), places(AADHAAR_BARE)
        mark = marker([*(find for find, *_ in found), words, bare])

        def spans(text: str) -> list[tuple]:
            marks = mark(text)
            out = [(a, b, name, name, text[a:b], i) for find, name, veto, i in found for a, b in find(text, marks) if veto is None or veto(text[a:b])]
            numbers = list(bare(text, marks))
            if numbers and next(words(text, marks), None):
                out += [(a, b, "aadhaar", "aadhaar", text[a:b], len(rules)) for a, b in numbers]
            return out

        return spans

    return _column(text, _once(build), alone)


def _labelled() -> tuple[list[Places], Callable[[str, Marks], list[tuple]]]:
    found = [(places(regex, LABEL_NEEDS.get(rule)), kind, rule, i) for i, (rule, kind, regex) in enumerate(LABELLED)]
    return [find for find, *_ in found], lambda text, marks: [(a, b, kind, rule, text[a:b], i) for find, kind, rule, i in found for a, b in find(text, marks)]


def _codes() -> tuple[list[Places], Callable[[str, Marks], list[tuple]]]:
    words, digits = places(OTP_WORDS), re.compile(r"(?<![A-Za-z0-9_])[0-9]{4,8}(?![A-Za-z0-9_])", re.ASCII)

    def spans(text: str, marks: Marks) -> list[tuple]:
        out: list[tuple] = []
        for start, _ in words(text, marks):
            m = digits.search(text[start : start + OTP_REACH])
            span = m and (start + m.start(), start + m.end(), "otp", "otp-nearby-digits", m[0], len(LABELLED))
            if span and out[-1:] != [span]:  # later words find no earlier digits, so the same ones follow each other
                out.append(span)
        return out

    return [words], spans


def _together(*parts: Callable) -> Callable[[], Callable[[str], list[tuple]]]:
    """What all parts find, in turn, from one reading of a text."""

    def build() -> Callable[[str], list[tuple]]:
        made = [part() for part in parts]
        mark = marker([find for finds, _ in made for find in finds])

        def spans(text: str) -> list[tuple]:
            marks = mark(text)
            return [s for _, of in made for s in of(text, marks)]

        return spans

    return build


def labelled(text: Column) -> Column:
    """The labelled rules' hits, overlaps kept."""
    return _column(text, _once(_together(_labelled)))


def codes(text: Column) -> Column:
    """For the words that speak of a code, the first free-standing 4 to 8 digits within reach of each, as spans, once each."""
    return _column(text, _once(_together(_codes)))


def labelled_and_codes(text: Column) -> Column:
    """:func:`labelled`, then :func:`codes`."""
    return _column(text, _once(_together(_labelled, _codes)))


def _once(build: Callable[[], Callable[[str], list[tuple]]]) -> Callable[[str], list[tuple]]:
    """Patterns are compiled in the worker, with its first text."""
    made: list[Callable[[str], list[tuple]]] = []

    def spans(text: str) -> list[tuple]:
        if not made:
            made.append(build())
        return made[0](text)

    return spans


def beside(text: Column, fixed: Column, spans: Column) -> Column:
    """Of ``spans`` in their order of start, greedily, those that overlap none of ``fixed`` and none taken before: their place
    from zero and their value. One sweep over a text's spans of both sides; a value is cut from the text once."""

    def sweep(texts: pa.Array, fixed_starts: pa.Array, fixed_ends: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        fixed_at, at = fixed_starts.offsets.to_pylist(), starts.offsets.to_pylist()
        fixed_ends_at, ends_at = fixed_ends.offsets.to_pylist(), ends.offsets.to_pylist()
        whole = [x.values.to_numpy(zero_copy_only=False).tolist() for x in (fixed_starts, fixed_ends, starts, ends)]
        out, places, values = [0], [], []
        for r, text in enumerate(texts):
            text, reach, end = text.as_py(), 0, 0
            held = sorted(zip(whole[0][fixed_at[r] : fixed_at[r + 1]], whole[1][fixed_ends_at[r] : fixed_ends_at[r + 1]], strict=True))
            held.append((1 << 63, 0))
            k = 0
            for i, (a, b) in enumerate(zip(whole[2][at[r] : at[r + 1]], whole[3][ends_at[r] : ends_at[r + 1]], strict=True)):
                while held[k][0] <= a:
                    reach = max(reach, held[k][1])
                    k += 1
                if a >= reach and a >= end and b <= held[k][0]:
                    end = b
                    places.append(i)
                    values.append(None if text is None else text[a : max(a, b)])
            out.append(len(places))
        fields = [pa.field("i", pa.int32()), pa.field("value", pa.string())]
        return pa.ListArray.from_arrays(pa.array(out, pa.int32()), pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.array(values, pa.string())], fields=fields))

    sweep.__annotations__ = dict.fromkeys(("texts", "fixed_starts", "fixed_ends", "starts", "ends", "return"), pa.Array)
    return F.arrow_udf(sweep, "array<struct<i:int,value:string>>").asNondeterministic()(text, fixed["start"], fixed["end"], spans["start"], spans["end"])
