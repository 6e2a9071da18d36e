"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A data file is a magic number, the bytes of an id, then records: the payload's length (8 bytes), the masked checksum
of that length (4), the payload, its masked checksum (4); all little-endian. Its index holds, for each record, a flag
for a null id, the id, the record's offset and its number of token ids, so that any record can be read alone.

Documents are dealt out by ranges of their ids and sorted, so the files in order hold the ids in order. Tasks write
files of names of their own; the table of the files that count is what the committed tasks report, so retried and
speculative tasks leave no trace in it. Files go through the file system of the folder's URI.
"""

from __future__ import annotations

import re
import struct
import sys
import types
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import Any
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialize, ship

ship(__name__)

MAGIC = b"VEILREC1"
END_ID = 1
FILE_BYTES = 64 << 20
READ_TASKS = 20_000
_INDEX = np.dtype([("null", "u1"), ("id", "<i8"), ("at", "<u8"), ("n", "<u8")])
_CACHE = 600_000
_MARKS = re.compile(r"[^a-z0-9\u00df-\u00f6\u00f8-\u00ff \t\n\r][,.][ \n]")  # after which a mark may not be parted


def masked(data: bytes) -> int:
    """A checksum rotated and offset, so that checksums of data that holds checksums stay unlike."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(read: Callable[[int], bytes]) -> bytes:
    """The next payload of a stream; a damaged or cut record raises ``ValueError``."""
    head = read(12)
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise ValueError("damaged record length")
    size = struct.unpack("<Q", head[:8])[0]
    body = read(size + 4)
    if len(body) < size + 4 or struct.unpack("<I", body[size:])[0] != masked(body[:size]):
        raise ValueError("damaged record")
    return body[:size]


class WordEncoder:
    """Ids of a text as little-endian bytes, from the ids of its words.

    The tokenizer's own splitting never joins characters across white space, nor letters with the comma or full stop
    after them, and it lower-cases; so a text's ids are those of its lower-cased words and marks in order. Words
    repeat, so each is encoded once for as long as a bounded table holds it.
    """

    def __init__(self, path: str, width: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.known = Tokenizer.from_file(path), f"<u{width}", {"": b""}
        self.model, self.width = self.tokenizer.model, width

    @staticmethod
    def parts(text: str | None) -> list[str]:
        """Pieces that the tokenizer would part too; marks stay with anything but plain letters and digits.

        The tokenizer composes letters and marks before it lower-cases, so texts that aren't composed before and after
        are only cut at spaces. So are those with the two letters that Python lower-cases by their place or into two,
        and those that may hold a special token, which the tokenizer knows in one spelling only.
        """
        whole = text or ""
        text = whole.lower()
        odd = "\u0130" in whole or "\u03a3" in whole or "<|" in whole
        if odd or not (whole.isascii() or is_normalized("NFC", whole) and is_normalized("NFC", text)):
            return whole.replace("\n", " ").split(" ")
        if not _MARKS.search(text):
            text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ")
        return text.replace("\n", " ").split(" ")

    def learn(self, parts: set[str]) -> None:
        if len(self.known) > _CACHE:
            self.known = {"": b""}
        known, kind, model = self.known, self.kind, self.model
        odd = []
        for part in parts.difference(known):
            if part.isascii() and part.isalpha() and part.islower():  # nothing to normalise or to split
                known[part] = b"".join(t.id.to_bytes(self.width, "little") for t in model.tokenize(part))
            else:
                odd.append(part)
        for part, got in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            known[part] = np.array(got.ids, dtype=kind).tobytes()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        split = [self.parts(t) for t in texts]
        self.learn(set().union(*split))
        get = self.known.__getitem__
        for parts in split:
            yield b"".join(map(get, parts))


def _encoder(path: str, width: int) -> WordEncoder:
    """This worker process's encoder: tasks that follow one another in a process share its table of words."""
    kept = sys.modules.setdefault("veil_worker_tables", types.ModuleType("veil_worker_tables")).__dict__
    key = f"{path}:{width}"
    if key not in kept:
        kept[key] = WordEncoder(path, width)
    return kept[key]


def _width(path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def write(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` as record files under ``folder``; return the table of files ``(part, seq, file, records, ids)``.

    Null texts are empty and hold the end id alone; null ids come first; rows with one id are ordered by text.
    """
    width = max(_width(tokenizer), 2 if end_id < 1 << 16 else 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        encoder, end = _encoder(tokenizer, width), end_id.to_bytes(width, "little")
        part, seq, out, index = TaskContext.get().partitionId(), 0, None, []

        def close() -> pa.RecordBatch:
            out[1].close()
            rows = np.array(index, dtype=_INDEX)
            with store.open_output_stream(f"{base}/{out[0]}.idx") as to:
                to.write(rows.tobytes())
            row = {"part": [part], "seq": [seq], "file": [out[0]], "records": [len(rows)], "ids": [int(rows["n"].sum())]}
            index.clear()
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("ids", pa.int64())]))

        at = 0
        for batch in batches:
            for lo in range(0, len(batch), 256):
                piece = batch.slice(lo, 256)
                for doc, ids in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1).to_pylist()), strict=True):
                    if out is None:
                        name = f"part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}"
                        out = (name, store.open_output_stream(f"{base}/{name}.rec"))
                        at = out[1].write(MAGIC + bytes([width]))
                    payload = ids + end
                    index.append((doc is None, doc or 0, at, len(payload) // width))
                    at += out[1].write(frame(payload))
                    if at >= FILE_BYTES:
                        yield close()
                        out, seq = None, seq + 1
        if out is not None:
            yield close()

    fs_, base_ = fs.FileSystem.from_uri(folder)
    fs_.create_dir(base_, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    dealt = rows.repartitionByRange("id", F.substring("text", 1, 32)).sortWithinPartitions("id", "text")  # an id's rows may be many
    return materialize(dealt.mapInArrow(run, "part int, seq int, file string, records long, ids long"), "files")


def read_record(folder: str, file: str, nth: int) -> np.ndarray:
    """The ids of one record, found by the index alone."""
    store, base = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{base}/{file}.idx") as index:
        index.seek(nth * _INDEX.itemsize)
        entry = np.frombuffer(index.read(_INDEX.itemsize), _INDEX)[0]
    with store.open_input_file(f"{base}/{file}.rec") as data:
        head = data.read(len(MAGIC) + 1)
        data.seek(int(entry["at"]))
        return np.frombuffer(unframe(data.read), f"<u{head[-1]}").astype(np.uint32)


def read(files: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every record of ``files``, read back and verified."""
    order = Window.orderBy("part", "seq")  # a row for each file
    tasks = min(max(1, files.count()), READ_TASKS)
    bases = files.withColumn("base", F.sum("ids").over(order) - F.col("ids")).select("file", "records", "base")
    columns = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}

    def records(file: str, count: int, base: int) -> Iterator[tuple[Any, ...]]:
        store, root = fs.FileSystem.from_uri(folder)
        with store.open_input_stream(f"{root}/{file}.idx") as from_index:
            index = np.frombuffer(from_index.read(), _INDEX)
        if len(index) != count:
            raise ValueError(f"{file}: {len(index)} records in the index, {count} in the table")
        with store.open_input_stream(f"{root}/{file}.rec", buffer_size=1 << 20) as data:
            head = data.read(len(MAGIC) + 1)
            if head[:-1] != MAGIC:
                raise ValueError(f"{file}: not a record file")
            for entry in index:
                ids = np.frombuffer(unframe(data.read), f"<u{head[-1]}").astype("<u4")
                if len(ids) != entry["n"]:
                    raise ValueError(f"{file}: a record is not as long as its index says")
                yield None if entry["null"] else int(entry["id"]), base, len(ids), zlib.crc32(ids.tobytes())
                base += len(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held: list[tuple] = []
                for got in records(row["file"], row["records"], row["base"]):
                    held.append(got)
                    if len(held) == 10_000:
                        yield _batch(held, columns)
                        held = []
                if held:
                    yield _batch(held, columns)

    return bases.repartition(tasks).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple], columns: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), columns.values(), strict=True)], list(columns))


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` into a fresh shared folder and report every record read back.

    One row per input row. Null texts are empty; null ids come first, rows of one id by text; repeated rows are records each;
    a very long text is one record, encoded whole; columns of other names are left behind; an empty table writes no file
    and gives an empty table.
    """
    folder = fresh_path(docs.sparkSession, "records")
    return read(write(docs, folder, tokenizer, id_col, text, end_id), folder).withColumnRenamed("doc_id", id_col)
