"""SimHash near-duplicates, found by anchor-point covering.

A fingerprint's two halves of 32 bits can't both differ by two bits or more when the whole differs by three at most,
so one half differs by one bit at most. In each half, 31 bits are covered by the Hamming code of length 31, whose
2^26 words are the anchors: its covering radius is one, so every half has exactly one anchor within one bit (its
home), and every half within one bit of that one has the same anchor within two bits (covering radius plus
threshold). Each fingerprint is therefore replicated to its 1 or 16 anchors within two bits, met there by the
fingerprints whose home it is, and compared in full. No pair within the threshold is missed.

Fingerprints are deduplicated before they are replicated, so a group of exact copies, however large, is one row.

Three bits of three-word shingles are a strict rule. To drop near-duplicates, :func:`drop_near_duplicates` also looks for
texts whose sets of words have fingerprints (``WIDE`` of them, each by hashes of its own) that three bits at most part:
an exchanged word moves one member of that set, but three shingles or five. Such candidates are links only if their sets
of five-word shingles have a similarity of ``SIMILAR`` or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, materialize, ship
from .components import components

ship(__name__)

SHINGLE = 3
THRESHOLD = 3
SEED = 42
WIDE = 6
SIMILAR, SIMILAR_WORDS = 0.8, 5
_BLOCK = 1 << 16  # shingles hashed at a time, which bounds memory for very long texts


def simhash(raw: bytes | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit fingerprint of UTF-8 text; zero for no words. ``bytes.lower`` and ``bytes.split`` are ASCII only."""
    from xxhash import xxh64_intdigest

    words = (raw or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros((8, 256), dtype=np.int64)
    lanes = np.arange(8, dtype=np.int64) * 256
    for at in range(0, n, _BLOCK):
        part = words[at : at + _BLOCK + width - 1]
        grams = zip(*(part[i:] for i in range(width)), strict=False) if len(words) >= width else [words]
        hashes = np.fromiter((xxh64_intdigest(b" ".join(g), seed) for g in grams), dtype="<u8")
        octets = hashes.view(np.uint8).reshape(-1, 8)
        ones += np.bincount((octets + lanes).ravel(), minlength=2048).reshape(8, 256)
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    majority = ((ones @ bits).ravel() * 2 > n).astype(np.uint8)
    return int(np.packbits(majority, bitorder="little").view("<i8")[0])


def word_prints(raw: bytes | None) -> list[int]:
    """``WIDE`` signed fingerprints of the set of words in a text, each with hashes of its own."""
    from xxhash import xxh64_intdigest

    words = set((raw or b"").lower().split())
    if not words:
        return [0] * WIDE
    hashes = np.fromiter(map(xxh64_intdigest, words), dtype="<u8", count=len(words))
    out = []
    for k in range(WIDE):
        x = hashes * np.uint64(0x9E3779B97F4A7C15 + 2 * k) + np.uint64(k)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        ones = np.unpackbits((x ^ (x >> np.uint64(31))).view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(ones * 2 > len(words), bitorder="little").view("<i8")[0]))
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", wide: str | None = None) -> DataFrame:
    """``docs`` plus a long column ``out``, and if named an array of :func:`word_prints`; a null text counts as empty."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(at).cast(pa.binary())
            more = {out: pa.array((simhash(x.as_py()) for x in raw), type=pa.int64(), size=len(raw))}
            if wide:
                more[wide] = pa.array([word_prints(x.as_py()) for x in raw], type=pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more.values()], names=[*batch.schema.names, *more])

    fields = [*docs.schema.fields, T.StructField(out, T.LongType()), *([T.StructField(wide, T.ArrayType(T.LongType()))] if wide else [])]
    return docs.mapInArrow(run, T.StructType(fields))


def _parity(x: Column, mask: int) -> Column:
    return F.bit_count(x.bitwiseAND(F.lit(mask).cast("long"))).bitwiseAND(F.lit(1))


def _syndrome(x: Column) -> Column:
    """XOR of the positions 1..31 of the set bits: zero for a code word, else the position to flip for the nearest one."""
    masks = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]
    out = F.lit(0)
    for k, mask in enumerate(masks):
        out = out + F.shiftleft(_parity(x, mask).cast("int"), k)
    return out


def _flip(p: str) -> str:
    """SQL: the bit at position ``p`` of 1..31, or no bit for position 0."""
    return f"(CASE WHEN {p} = 0 THEN 0L ELSE shiftleft(1L, cast({p} - 1 AS int)) END)"


def _halves(fps: DataFrame, by: tuple[str, ...]) -> DataFrame:
    low = F.lit(0x7FFFFFFF).cast("long")
    half = F.array(F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", 32).bitwiseAND(low))
    return fps.select("fp", *by, F.posexplode(half).alias("half", "x")).withColumn("s", _syndrome(F.col("x")))


def homes(fps: DataFrame, *by: str) -> DataFrame:
    """``(fp, by, half, anchor)``: the one anchor within a bit of each half."""
    return _halves(fps, by).selectExpr("fp", *by, "half", f"x ^ {_flip('s')} AS anchor")


def probes(fps: DataFrame, *by: str) -> DataFrame:
    """``(fp, by, half, anchor)``: every anchor within two bits of each half."""
    flips = f"transform(filter(sequence(0, 31), i -> i < (i ^ s)), i -> x ^ {_flip('i')} ^ {_flip('(i ^ s)')})"
    return _halves(fps, by).selectExpr("fp", *by, "half", f"explode(CASE WHEN s = 0 THEN array(x) ELSE {flips} END) AS anchor")


def links(fps: DataFrame, threshold: int = THRESHOLD, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs ``(by, a, b)`` of distinct fingerprints, equal in ``by``, that differ by ``threshold`` (3 at most) bits or fewer."""
    if threshold > THRESHOLD:
        raise ValueError("the anchors cover three differing bits at most")
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")  # a row becomes 34
    left = homes(fps, *by).withColumnRenamed("fp", "a")
    right = probes(fps, *by).withColumnRenamed("fp", "b")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    # a pair within a bit in a half meets there both ways, so one way is enough, as is the first half if both are close
    once = (F.col("a") < F.col("b")) & ((F.col("half") == 0) | (F.bit_count(apart.bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))) >= 2))
    met = left.join(right, [*by, "half", "anchor"]).where(once & (F.bit_count(apart) <= threshold))
    return met.select(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _grouped(prints: DataFrame) -> DataFrame:
    """``(fp, component)`` for every distinct fingerprint that has links."""
    return components(links(prints.select("fp").distinct()))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, 16 hex digits of the fingerprint, smallest id of the group.

    Null and empty texts have fingerprint zero and link like any other; repeated rows are kept and share a group;
    a null id is never a group's smallest id unless the group has no other; a very long text is hashed piece by piece; columns
    of other names are left behind. An empty table gives an empty table.
    """
    prints = with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text", "fp")
    prints = materialize(prints.select("id", "fp"), "prints")
    firsts = prints.groupBy("fp").agg(F.min("id").alias("first"))
    group = _grouped(firsts).select(F.col("node").alias("fp"), "component")
    named = firsts.join(group, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = materialize(named, "named")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    per_fp = named.join(least, "component").select("fp", "component_id")
    return prints.join(per_fp, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _shingles(text: Column, size: int) -> Column:
    """Distinct hashes of a text's shingles of ``size`` words; the whole of a shorter one; none of an empty one."""
    words = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def grams(h: Column) -> Column:
        n = F.greatest(F.size(h) - size + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(size))))

    return F.array_distinct(F.flatten(F.transform(F.array(hashed), lambda h: F.when(F.size(h) > 0, grams(h)).otherwise(F.array().cast("array<bigint>")))))


def similar_links(reps: DataFrame, texts: DataFrame, least: float = SIMILAR, size: int = SIMILAR_WORDS) -> DataFrame:
    """Pairs ``(a, b)`` of ``reps(fp, row, wide)`` whose word fingerprints meet and whose texts are ``least`` similar.

    Of representatives with one word fingerprint the least is compared with the others, and stands for them outside.
    ``texts(row, text)`` has their texts.
    """
    own = materialize(reps.select("fp", F.posexplode("wide").alias("k", "w")), "wide")
    least_of = own.groupBy("k", "w").agg(F.min("fp").alias("first"))
    stars = own.join(least_of, ["k", "w"]).where("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    met = links(least_of.select("k", F.col("w").alias("fp")), by=("k",)).toDF("k", "wa", "wb")
    ends = [least_of.select("k", F.col("w").alias(f"w{x}"), F.col("first").alias(x)) for x in "ab"]
    met = met.join(ends[0], ["k", "wa"]).join(ends[1], ["k", "wb"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialize(stars.union(met).distinct(), "pairs")
    named = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(reps.select("fp", "row"), "fp")
    sets = materialize(named.join(texts, "row").select("fp", _shingles(F.col("text"), size).alias("s")), "shingles")
    sides = [sets.select(F.col("fp").alias(x), F.col("s").alias(f"s{x}")) for x in "ab"]
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(sides[0], "a").join(sides[1], "b").where(both >= least * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id (of repeats of that id, one row).

    Linked are rows whose fingerprints differ by three bits at most, and those that :func:`similar_links` finds. Null
    and empty texts are one group; a null id stays only where a group has no other; columns may have any names but the
    operator's own; an empty table gives an empty table; a very long text is hashed piece by piece.
    """
    row, fp, wide = "__veil_row", "__veil_fp", "__veil_wide"
    held = materialize(with_fingerprint(docs, text, fp, wide).withColumn(row, F.monotonically_increasing_id()), "texts")
    best = F.min(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col(row).alias("r"), F.col(wide).alias("w")))
    firsts = materialize(held.groupBy(F.col(fp).alias("fp")).agg(best.alias("best")), "prints")
    reps = firsts.select("fp", F.col("best.r").alias("row"), F.col("best.w").alias("wide"))
    near = similar_links(reps, held.select(F.col(row).alias("row"), F.col(text).alias("text")))
    group = components(links(firsts.select("fp")).union(near)).select(F.col("node").alias("fp"), "component")
    named = firsts.join(group, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    stay = named.groupBy("component").agg(F.min("best").alias("best")).select(F.col("best.r").alias(row))
    return held.join(stay, row, "left_semi").select(*docs.columns)
