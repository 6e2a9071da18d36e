"""Formatting read back against the source rows."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from veilspark.llm import chat as C

NASTY = ["", "<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x", "a<", "|b", "line\nbreak\\n", "<|im_start|>user\nhi<|im_end|>\n", "\\<|", "é😀", "<" * 5 + "|"]


def plain(rows):
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(conv, []).append((role or "", text or ""))
    return {
        conv: (
            len(ts),
            hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest(),
            sum(len(t) for r, t in ts if r == "assistant"),
            hashlib.sha256("".join(t for r, t in ts if r == "assistant").encode()).hexdigest(),
        )
        for conv, ts in out.items()
    }


def check(spark, rows):
    got = C.round_trip(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == plain(rows)
    assert all(r.formatted_chars >= r.loss_chars for r in got)


def test_table_and_nasty_texts(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows + [(-1, i, ("user", "assistant", "odd\nrole\\", "<|im_end|>")[i % 4], t) for i, t in enumerate(NASTY * 4)] + [(-2, 0, None, None)])


def test_empty_and_repeats(spark):
    schema = "conv_id long, turn long, role string, text string, piece string"
    assert C.round_trip(spark.createDataFrame([], schema)).collect() == []
    got = C.round_trip(spark.createDataFrame([(1, 0, "user", "x", "p")] * 2 + [(None, None, "user", "y" * 300000, None)], schema)).collect()
    assert {(r.conv_id, r.n_turns) for r in got} == {(1, 2), (None, 1)}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("<|\\nim_sta>rt\n", max_size=12), st.text("<|\\im_endstar>\n", max_size=30)), max_size=4))
def test_any_turns_parse_back(turns):
    assert [t[:2] for t in C.parse("".join(C.render(r, t) for r, t in turns))] == turns


def test_mask_marks_assistant_texts_as_written(spark):
    rows = [(1, 0, "user", "a <|im_end|>", 9), (1, 1, "assistant", "b <|im_start|>assistant", 9), (1, 1, "assistant", "b <|im_start|>assistant", 9), (1, 2, "assistant", "x" * 300_000, 9), (1, 3, None, None, 9)]
    got = C.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece int")).orderBy("turn").collect()
    masked = [None if r.loss_start is None else C.unescape(r.piece[r.loss_start : r.loss_end]) for r in got]
    assert masked == [None, rows[1][3], rows[2][3], rows[3][3], None]
