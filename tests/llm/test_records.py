"""Record files read back, against encoding whole texts at once."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veilspark.llm import records as R
from veilspark.llm.common import fresh_path

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
ODD = ["", None, "a\x1cb  c d\te\x0bf", "ΣΑΣ. ΣΑΣ, İstanbul.", "don't I'LL 3.14 <|endoftext|> x", "é ́", "\n\n", "x" * 5000, "漢字 かな"]


def plain(rows):
    tok, start, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_table_and_odd_texts(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(ODD)]
    got = R.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert sorted(map(tuple, got)) == plain(rows)


def test_edge_cases(spark):
    schema = "doc_id long, text string, ids int"
    assert R.round_trip(spark.createDataFrame([], schema), PATH).collect() == []
    rows = [(1, "b", 1), (1, "a", None), (None, "n", 2), (2, None, 3)]
    got = R.round_trip(spark.createDataFrame(rows, schema), PATH).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain([r[:2] for r in rows]), key=str)


def test_shuffled_read_and_damage(spark):
    folder = fresh_path(spark, "records-test")
    texts = [f"word{i} and more" for i in range(50)]
    files = R.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), folder, PATH).orderBy("part", "seq").collect()
    tok = Tokenizer.from_file(PATH)
    at = 0
    for f in files:
        for nth in reversed(range(f.records)):
            assert R.read_record(folder, f.file, nth).tolist() == [*tok.encode(texts[at + nth], add_special_tokens=False).ids, 1]
        at += f.records
    framed = bytearray(R.frame(b"payload"))
    framed[14] ^= 1
    import io

    with pytest.raises(ValueError):
        R.unframe(io.BytesIO(bytes(framed)).read)
    with pytest.raises(ValueError):
        R.unframe(io.BytesIO(R.frame(b"payload")[:-1]).read)


def test_special_tokens_in_other_spellings(spark):
    texts = ["<|ENDOFTEXT|>", "A <|EndOfText|>, b. C<|endoftext|>D", "<|STARTOFTEXT|> <|startoftext|>.\nx"]
    rows = [*enumerate(texts)]
    assert sorted(map(tuple, R.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect())) == plain(rows)


def test_marks_that_compose_only_with_small_letters(spark):
    texts = ["T\u0308", "H\u0331amza, x", "J\u030covan. Y\u030a W\u030a", "\u0389\u0345 a\u0301 A\u0301", "\u1e9e \u0130\u0307 \ufb01\u0301", "\u0308x \u0308,\u0301 .\u0308"]
    rows = [*enumerate(texts)]
    assert sorted(map(tuple, R.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect())) == plain(rows)


def test_random_unicode_is_encoded_as_whole_texts_are():
    tok, encoder, draw = Tokenizer.from_file(PATH), R.WordEncoder(PATH, 2), random.Random(7)
    letters = [chr(c) for a, b in ((0x20, 0x7F), (0xA0, 0x250), (0x300, 0x370), (0x370, 0x530), (0x5D0, 0x600), (0x900, 0x980), (0x1100, 0x1200), (0x1E00, 0x2000), (0x2000, 0x2070), (0x3040, 0x3100), (0xAC00, 0xAC80), (0xF900, 0xF940), (0xFB00, 0xFB50), (0x1D400, 0x1D420)) for c in range(a, b)]
    letters += list(" ., \n") * 60 + [chr(c) for c in range(0x300, 0x346)] * 4
    texts = ["".join(draw.choices(letters, k=draw.randint(1, 30))) for _ in range(20_000)]
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == tok.encode(text, add_special_tokens=False).ids, ascii(text)


def test_reading_back_is_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(R, "FILE_BYTES", 200)
    docs = spark.createDataFrame([(i, f"some words {i} and more of them") for i in range(300)], "doc_id long, text string")
    assert R.round_trip(docs, PATH).rdd.getNumPartitions() > 4
