"""Repeated passages, found by level-wise doubling.

Windows repeated at one length alone are extended to twice that length: a window of 2L words can't repeat unless both its
halves do, so each level asks only about pairs of what the level below left over, until none is left. The first level's
windows are a quarter of ``window`` words long; at ``window`` words it is also settled which occurrence is the first, and
every word that a later one covers goes. The levels after that tell how long a document's repeated passages are.

Texts are dealt into blocks of about a million words. At each level a block names its distinct windows once, by hashes, to
hash-partitioned buckets of all windows, however common one is, and a bucket answers each with two bits: whether another
block has it, and whether one has it earlier. Documents are numbered by id for that. What a block knows of a level (places
and hashes of the windows that may still repeat) is a row of a table bucketed by block, so neither is shuffled.

A window's hash is of 64 bits and made of its halves' hashes; at ``window`` words it has 32 more. Below ``window`` words only
so many bits are sent that a window shares them with another in 2^8 cases at most, which costs a question more; above, in
2^28 cases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, ship
from .ngram_lm import _mixed, _pack, _unpack

ship(__name__)

WINDOW = 20
_BLOCK_WORDS, _BLOCK_DOCS, _BUCKET_KEYS, _PIECE = 1_000_000, 50_000, 1_000_000, 1 << 20
_ROW = "block long, level long, kind string, bucket long, n long, a binary, b binary, c binary, d binary"
_NAMES = [f.split()[0] for f in _ROW.split(", ")]
_KINDS = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]] for f in _ROW.split(", ")]
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def _sorted(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of keys of ``width`` bits, and which of them, in that order, differ from the one before."""
    bits = len(keys).bit_length()
    if width + bits <= 64:  # with their places they are sorted in one array
        both = keys << np.uint64(bits) | np.arange(len(keys), dtype="<u8")
        both.sort()
        order, keys = (both & np.uint64((1 << bits) - 1)).astype("i8"), both >> np.uint64(bits)
    else:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    return order, new


def _rows(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_NAMES)
    return pa.table([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """A text's words, at most a megabyte's at a time (a longer word is one)."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + _PIECE)
        while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
            end += 1
        yield raw[at:end].split()
        at = end


def blocks(docs: DataFrame) -> DataFrame:
    """``docs(id, text)`` as rows of kind ``text``: a block's ids and hashes of whole texts, its texts' numbers of words, words
    as places in a list, and that list."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from array import array

        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        block = TaskContext.get().partitionId() << 32
        ids, prints, lengths, held, seen = [], array("q"), array("q"), array("I"), {}

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            nonlocal block, seen
            listed = b" ".join(seen)
            blobs = [_pack(np.array(lengths, "<i8")), _pack(np.array(held, "<u4")), len(listed).to_bytes(8, "little") + pa.compress(listed, "zstd", asbytes=True), None]
            values = [block, None, "text", None, len(held), *blobs, ids, list(prints)]
            out = pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, [*_KINDS, pa.list_(kind), pa.list_(pa.int64())], strict=True)], [*_NAMES, "ids", "prints"])
            ids.clear()
            for x in (prints, lengths, held):
                del x[:]
            seen, block = {}, block + 1
            return out

        kind = pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                text, before = raw.as_py() or b"", len(held)
                for words in _pieces(text):
                    held.extend([seen.setdefault(w, len(seen)) for w in words])
                ids.append(key)
                prints.append(xxh64_intdigest(text) - (1 << 63))
                lengths.append(len(held) - before)
                if len(held) >= _BLOCK_WORDS or len(ids) >= _BLOCK_DOCS:
                    yield flush(kind)
        if ids:
            yield flush(kind)

    return docs.mapInArrow(run, f"{_ROW}, ids array<{id_type}>, prints array<long>")


def _numbered(held: DataFrame) -> DataFrame:
    """``(block, ranks)``: each document's place among all by id (nulls first; repeats of an id by their text's hash)."""
    each = held.where("kind = 'text'").select("block", F.posexplode(F.arrays_zip("ids", "prints")).alias("at", "d")).select("block", "at", F.col("d.ids").alias("id"), F.col("d.prints").alias("print"))
    ranges = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = each.repartitionByRange(ranges, "id", "print", "block", "at").sortWithinPartitions("id", "print", "block", "at")
    # a row's number: its range's in the upper bits, its place there in the lower ones
    dealt = dealt.select("block", "at", F.monotonically_increasing_id().alias("rank"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "rank")))
    return dealt.groupBy("block").agg(F.transform(ordered, lambda x: x["rank"]).alias("ranks"))


def _grams(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows of ``width`` words that begin at each place (the last ones are of fewer)."""
    out = words.copy()
    for k in range(1, width):
        out[: len(words) - k] = _mixed(out[: len(words) - k], words[k:])
    return out


class Windows:
    """A block's windows of one length that may repeat: where they begin, by hash, in documents that end at ``ends``; at the
    length that is settled exactly, by a second hash too."""

    def __init__(self, length: int, at: np.ndarray, one: np.ndarray, two: np.ndarray | None, ends: np.ndarray, ranks: np.ndarray):
        self.length, self.at, self.one, self.two, self.ends, self.ranks = length, at, one, two, ends, ranks

    @classmethod
    def first(cls, length: int, words: np.ndarray, lengths: np.ndarray, ranks: np.ndarray) -> Windows:
        ends = np.cumsum(lengths)
        at = np.flatnonzero(np.repeat(ends, lengths) - np.arange(len(words)) >= length)
        return cls(length, at, _grams(words, length)[at], None, ends, ranks)

    @classmethod
    def read(cls, row: dict) -> Windows:
        hashes = _unpack(row["b"], "<u4")
        n = row["n"]
        one = hashes[: 2 * n].view("<u8")
        return cls(row["level"], np.cumsum(_unpack(row["a"], "<i8")), one, hashes[2 * n :] if len(hashes) > 2 * n else None, _unpack(row["c"], "<i8"), _unpack(row["d"], "<i8"))

    def row(self, block: int) -> tuple:
        hashes = self.one.view("<u4")
        hashes = hashes if self.two is None else np.concatenate([hashes, self.two])
        return block, self.length, "windows", None, len(self.at), _pack(np.diff(self.at, prepend=0)), _pack(hashes), _pack(self.ends), _pack(self.ranks)

    def docs(self) -> np.ndarray:
        return np.searchsorted(self.ends, self.at, "right")

    def distinct(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys' first places (earliest document, then earliest start), each window's key, and the keys in order:
        by both hashes if there are two, else by the first ``width`` bits."""
        if self.two is None:
            keys = self.one >> np.uint64(64 - width)
            order, new = _sorted(keys, width)
        else:
            keys = self.one
            order = np.lexsort((self.at, self.ranks[self.docs()], self.two, keys))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (np.diff(keys[order]) != 0) | (np.diff(self.two[order]) != 0)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.cumsum(new) - 1
        return order[new], place, keys[order[new]]

    def asks(self, block: int, width: int, bits: int) -> list[tuple]:
        first, _, keys = self.distinct(width)
        cuts = np.searchsorted(keys >> np.uint64((width if self.two is None else 64) - bits), np.arange(2**bits + 1, dtype=np.uint64)).tolist()
        ranks, out = self.ranks[self.docs()[first]], []
        for bucket, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if i < j:
                more = (None, None) if self.two is None else (_pack(self.two[first[i:j]]), _pack(ranks[i:j]))
                out.append((block, self.length, "asks", bucket, j - i, _pack(np.diff(keys[i:j], prepend=np.uint64(0))), *more, None))
        return out

    def told(self, answers: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each window whether it repeats, and whether it also begins earlier."""
        first, place, _ = self.distinct(width)
        bits = np.concatenate([_unpack(x, "u1") for x in answers] or [np.zeros(0, "u1")])
        repeats = (bits[place] & 1).astype(bool) | (np.bincount(place, minlength=len(first)) > 1)[place]
        later = (bits[place] & 2).astype(bool)
        later |= np.arange(len(place)) != first[place]
        return repeats, later

    def doubled(self, repeats: np.ndarray, exact: bool) -> Windows:
        """Windows of twice the length, both halves of which repeat; with a second hash if they are the exact ones."""
        at, docs, one = self.at[repeats], self.docs()[repeats], self.one[repeats]
        half = np.searchsorted(at, at + self.length)
        ok = half < len(at)
        ok[ok] = (at[half[ok]] == at[ok] + self.length) & (docs[half[ok]] == docs[ok])
        left, right = one[ok], one[half[ok]]
        two = (_mixed(left * _SECOND, right) >> np.uint64(32)).astype("<u4") if exact else None
        return Windows(2 * self.length, at[ok], _mixed(left, right), two, self.ends, self.ranks)


def _words(row: dict) -> list[bytes]:
    raw = row["c"]
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True).split(b" ") if row["n"] else []


def _start(rows: dict[str, list[dict]], length: int) -> Windows:
    """A block's windows of the first length, from its text and its documents' numbers."""
    from xxhash import xxh64_intdigest

    (text,), (numbered,) = rows["text"], rows["ranks"]
    words = _words(text)
    hashes = np.fromiter(map(xxh64_intdigest, words), "<u8", len(words))[_unpack(text["b"], "<u4")] if words else np.zeros(0, "<u8")
    return Windows.first(length, hashes, _unpack(text["a"], "<i8"), np.array(numbered["ranks"], "<i8"))


def _by_kind(rows: pa.Table) -> dict[str, list[dict]]:
    """A block's rows, answers in the order of their buckets."""
    out: dict[str, list[dict]] = {}
    for x in sorted(rows.to_pylist(), key=lambda x: x["bucket"] or 0):
        out.setdefault(x["kind"], []).append(x)
    return out


def _answers(key: tuple, asks: pa.Table) -> pa.Table:
    """For each block's keys of a bucket, in their order: one if another block has the key, plus two if one has it in an
    earlier document."""
    rows = asks.to_pylist()
    parts = [np.cumsum(_unpack(x["a"], "<u8"), dtype="<u8") for x in rows]  # sorted, so sent as steps
    keys, sizes = np.concatenate(parts), [len(p) for p in parts]
    if rows[0]["b"] is None:
        keys -= keys.min()
        order, new = _sorted(keys, int(keys.max()).bit_length())
        ranks = np.zeros(len(keys), "<i8")
    else:
        two, ranks = (np.concatenate([_unpack(x[c], kind) for x in rows]) for c, kind in (("b", "<u4"), ("c", "<i8")))
        order = np.lexsort((ranks, two, keys))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(keys[order]) != 0) | (np.diff(two[order]) != 0)
    group = np.cumsum(new) - 1
    least, many = ranks[order][new], np.bincount(group) > 1
    bits = np.empty(len(order), "u1")
    bits[order] = many[group] | (ranks[order] > least[group]).astype("u1") << 1
    level, out = rows[0]["level"], np.split(bits, np.cumsum(sizes)[:-1])
    return _rows([(x["block"], level, "told", key[0].as_py(), None, _pack(told), None, None, None) for x, told in zip(rows, out, strict=True)])


class _Shelf:
    """Tables bucketed by block, one for each level, in the shared folder; their names go when the work is done."""

    def __init__(self, spark, buckets: int):  # noqa: ANN001
        self.spark, self.buckets, self.paths = spark, buckets, {}

    def keep(self, level: int, rows: DataFrame) -> None:
        path = self.paths.setdefault(level, fresh_path(self.spark, "repeats"))
        rows.write.bucketBy(self.buckets, "block").option("path", path).option("compression", "none").mode("append").saveAsTable(self._name(path))

    def empty(self, level: int) -> None:
        """Give back the room of a level that nothing reads any more."""
        self.spark.range(0).write.mode("overwrite").parquet(self.paths[level])

    def table(self, level: int) -> DataFrame:
        return self.spark.table(self._name(self.paths[level]))

    @staticmethod
    def _name(path: str) -> str:
        return path.rsplit("/", 1)[-1].replace("-", "_")

    def forget(self) -> None:
        for path in self.paths.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(path)}")


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(id, n_words, n_removed, kept, longest)`` for each row: words are removed that a window of ``window`` words covers
    whose words also begin earlier, in a document of smaller id or earlier in the same; ``kept`` has the others, joined by
    a space; ``longest`` is the longest of ``window``, twice ``window``, ... words of the document that occur twice.

    Windows are judged on the input, not on what is left. A null text has no words; a null id is before all others; rows
    of one id are documents in the order of a hash of their texts (equal ones in either order); texts of fewer words than
    a window keep all; a very long text is one block, in memory once as numbers; other columns are left behind; an empty
    table gives an empty table.
    """
    if window % 4:
        raise ValueError("a window is four times as long as the first level's")
    spark = docs.sparkSession
    buckets, start = int(spark.conf.get("spark.sql.shuffle.partitions")), window // 4
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    shelf, arrays = _Shelf(spark, buckets), {"ids": f"array<{id_type}>", "prints": "array<long>", "ranks": "array<long>"}

    def keep_beside_texts(rows: DataFrame) -> None:
        more = [F.lit(None).cast(kind).alias(c) for c, kind in arrays.items() if c not in rows.columns]
        shelf.keep(0, rows.select("*", *more).select(*_NAMES, *arrays))

    keep_beside_texts(blocks(rows))
    total = shelf.table(0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits, size = max(4, (total // _BUCKET_KEYS).bit_length()), total.bit_length()

    def width(length: int) -> int:
        return min(64, max(32, size + (8 if length < window else 28)))

    blank = [F.lit(None).cast(kind).alias(c) for c, kind in (f.split() for f in _ROW.split(", ")) if c not in ("block", "kind")]
    keep_beside_texts(_numbered(shelf.table(0)).select("block", F.lit("ranks").alias("kind"), "ranks", *blank))

    def asks(length: int):  # noqa: ANN202
        def run(rows: pa.Table) -> pa.Table:
            found = _by_kind(rows)
            own = Windows.read(found["windows"][0]) if "windows" in found else _start(found, start)
            return _rows(own.asks(rows["block"][0].as_py(), width(length), bits))

        return run

    def extended(length: int):  # noqa: ANN202
        """The windows of twice ``length`` that are left, and what a block has found at ``length``."""

        def run(rows: pa.Table) -> pa.Table:
            found = _by_kind(rows)
            block = rows["block"][0].as_py()
            own = Windows.read(found["windows"][0]) if "windows" in found else _start(found, start)
            repeats, later = own.told([x["a"] for x in found.get("told", [])], width(length))
            now, out = own.doubled(repeats, 2 * length == window), []
            if length == window and later.any():
                out.append((block, window, "removed", None, None, _pack(np.diff(own.at[later], prepend=0)), None, None, None))
            if length >= window and repeats.any():
                out.append((block, length, "longest", None, None, _pack(np.unique(own.docs()[repeats])), None, None, None))
            return _rows([*out, now.row(block)] if len(now.at) else out)

        return run

    length = start
    while True:
        at = 0 if length == start else length
        own = shelf.table(at).where(F.col("kind").isin("text", "ranks", "windows"))
        asked = own.groupBy("block").applyInArrow(asks(length), _ROW).select("block", "level", "bucket", "a", "b", "c")
        told = asked.groupBy("bucket").applyInArrow(_answers, _ROW).repartition(buckets, "block")
        shelf.keep(at, told) if at else keep_beside_texts(told)
        own = shelf.table(at).where(F.col("kind").isin("text", "ranks", "windows", "told"))
        shelf.keep(2 * length, own.groupBy("block").applyInArrow(extended(length), _ROW))
        if at:
            shelf.empty(at)
        length *= 2
        keep_beside_texts(shelf.table(length).where(F.col("kind").isin("removed", "longest")))
        if shelf.table(length).where("kind = 'windows'").isEmpty():
            break

    def kept(rows: pa.Table) -> pa.Table:
        found = _by_kind(rows)
        text = found["text"][0]
        lengths, places, words = _unpack(text["a"], "<i8"), _unpack(text["b"], "<u4"), _words(text)
        gone, longest = np.zeros(len(places) + 1, "i4"), np.zeros(len(lengths), "i8")
        for x in found.get("removed", []):
            at = np.cumsum(_unpack(x["a"], "<i8"))
            gone[at] += 1
            gone[at + window] -= 1
        for x in found.get("longest", []):
            at = _unpack(x["a"], "<i8")
            longest[at] = np.maximum(longest[at], x["level"])
        stay = np.cumsum(gone[:-1]) == 0
        ends = np.cumsum(lengths)
        left = np.diff(np.concatenate([[0], np.cumsum(stay)])[np.concatenate([[0], ends])])
        texts, at = [], 0
        chosen = places[stay].tolist()
        for n in left.tolist():
            texts.append(b" ".join([words[i] for i in chosen[at : at + n]]))
            at += n
        ids = pa.array(text["ids"], rows.schema.field("ids").type.value_type)
        return pa.table([ids, pa.array(lengths), pa.array(lengths - left), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(longest)], ["id", "n_words", "n_removed", "kept", "longest"])

    done = shelf.table(0).where(F.col("kind").isin("text", "removed", "longest")).groupBy("block")
    out = done.applyInArrow(kept, f"id {id_type}, n_words long, n_removed long, kept string, longest long")
    shelf.forget()
    return out.withColumnRenamed("id", id_col)


def sql(window: int = WINDOW) -> str:
    """The digest of :func:`find` in DuckDB, for ids that differ."""
    return rf"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(w[i + 1 : i + {window}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - {window - 1})) AS i FROM d WHERE len(w) >= {window})),
f AS (SELECT g, min((doc_id, i)) AS first FROM p GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS k FROM p JOIN f USING (g) WHERE (doc_id, i) > first),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS k FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS t FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
