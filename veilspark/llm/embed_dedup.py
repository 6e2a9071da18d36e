"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, then the vectors themselves.

Vectors are centred, projected on their principal axes and rotated so that their signs lose least (the rotation is
fitted on ``SAMPLE`` vectors, the first by a digest of their parts; vectors of another length than most of those take
random axes); the signs are codes of 64 bits. Codes are cut into tables whose keys have as many bits as it takes to
number the vectors of the largest label, 16 at least, so that a key's vectors stay few at any size; keys of more than
16 bits are cut from two codes by two rotations, for as many tables. Two codes that differ by fewer than twice as many
bits as there are tables have a table in which they differ by one bit at most, so every vector is put in each table
under its own key and looked up under that key and those one bit away. Pairs met are compared by cosine in double
precision, but for those whose codes differ by more bits than one linked pair in a million would (:func:`radius`).

Equal vectors of one label are one row with a count all the way, so a group of copies costs no pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, ship, uniform
from .components import components

ship(__name__)

COSINE = 0.98
BITS = 64
LEAST_KEY, MOST_KEY = 16, 32
SAMPLE = 10_000
ROUNDS = 40


def radius(least: float, bits: int, norm: float = 1.0) -> int:
    """The fewest differing bits, of ``bits`` signs, that a pair of cosine ``least`` exceeds once in a million; ``norm`` is
    what centring leaves of a unit vector's length."""
    p = 2 * math.asin(min(1.0, math.sqrt(max(0.0, 2 - 2 * least)) / 2 / max(norm, 1e-9))) / math.pi
    tail, r = 1.0, -1
    while tail > 1e-6 and r < bits:
        r += 1
        tail -= math.comb(bits, r) * p**r * (1 - p) ** (bits - r)
    return r


def key_bits(largest: int) -> int:
    return min(MOST_KEY, max(LEAST_KEY, max(1, largest).bit_length()))


def learn(vectors: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Centre and projection (dimensions x bits): principal axes turned to the rotation with least quantisation loss."""
    centre = vectors.mean(axis=0)
    x = vectors - centre
    axes = np.linalg.svd(x.T @ x)[0][:, : min(bits, x.shape[1])]
    v = x @ axes
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(v.shape[1], v.shape[1])))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = (left @ right).T
    return centre, axes @ turn


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def _usable(v: Column) -> Column:
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & sound & F.exists(v, lambda x: x != 0)


def _learned(reps: DataFrame, words: int) -> tuple[int, list[tuple[np.ndarray, np.ndarray]], float]:
    """The sample's commonest length, its centres and projections, and the length that all but a few vectors keep when
    they are centred."""
    picked = reps.orderBy(uniform(F.col("same"), "itq:"), "same").limit(SAMPLE).select("v").collect()  # a bounded sample
    if not picked:
        return 0, [], 1.0
    lengths = [len(r.v) for r in picked]
    size = max(set(lengths), key=lambda n: (lengths.count(n), n))
    sample = _unit(np.array([r.v for r in picked if len(r.v) == size], dtype=np.float64))
    return size, [learn(sample, seed=i) for i in range(words)], float(np.quantile(np.linalg.norm(sample - sample.mean(axis=0), axis=1), 0.05))


def _coded(reps: DataFrame, words: int, size: int, learned: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``reps(.., v)`` plus ``codes``, ``words`` of them."""
    sent = reps.sparkSession.sparkContext.broadcast((size, learned))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def codes(vectors: pd.Series) -> pd.Series:
        size, learned = sent.value
        out = np.zeros((len(vectors), words), dtype=np.int64)
        lengths = vectors.map(len).to_numpy()
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            x = _unit(np.stack(vectors.iloc[at]).astype(np.float64))
            for i in range(words):
                centre, axes = learned[i] if n == size else (np.zeros(n), np.random.default_rng([int(n), i]).normal(size=(int(n), BITS)))
                padded = np.zeros((len(at), 64), dtype=np.uint8)
                padded[:, : axes.shape[1]] = (x - centre) @ axes >= 0
                out[at, i] = np.packbits(padded, axis=1, bitorder="little").view("<i8")[:, 0]
        return pd.Series(list(out))

    return reps.withColumn("codes", codes("v"))


def _candidates(coded: DataFrame, bits: int, most: int) -> DataFrame:
    """``(a, b)`` with a < b: vectors of one label that meet in a table and whose codes differ by ``most`` bits at most."""
    words = len(_words(bits))
    mask = F.lit((1 << bits) - 1).cast("long")
    tables = F.array(*(F.shiftrightunsigned(F.get("codes", F.lit(i)), j * bits).bitwiseAND(mask) for i in range(words) for j in range(BITS // bits)))
    home = coded.select("rep", "label", "size", "codes", F.posexplode(tables).alias("table", "key"))
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i).cast("long") for i in range(bits)))
    ask = home.select(F.col("rep").alias("rep2"), "label", "size", F.col("codes").alias("codes2"), "table", F.explode(F.transform(flips, lambda f: F.col("key").bitwiseXOR(f))).alias("key"))
    apart = sum((F.bit_count(F.get("codes", F.lit(i)).bitwiseXOR(F.get("codes2", F.lit(i)))) for i in range(1, words)), F.bit_count(F.get("codes", F.lit(0)).bitwiseXOR(F.get("codes2", F.lit(0)))))
    met = home.join(ask, ["label", "size", "table", "key"]).where((F.col("rep") < F.col("rep2")) & (apart <= most))
    return met.select(F.col("rep").alias("a"), F.col("rep2").alias("b")).distinct()


def _words(bits: int) -> range:
    """The codes that keys of so many bits are cut from: four tables at least."""
    return range(1 if BITS // bits >= 4 else 2)


@F.pandas_udf(T.DoubleType())
def _cosine(left: pd.Series, right: pd.Series) -> pd.Series:
    if not len(left):
        return pd.Series([], dtype="float64")
    sizes = left.map(len).to_numpy()
    out = np.zeros(len(left))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        x, y = (np.stack(s.iloc[at]).astype(np.float64) for s in (left, right))
        x, y = x / np.abs(x).max(axis=1)[:, None], y / np.abs(y).max(axis=1)[:, None]
        out[at] = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    return pd.Series(out)


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = COSINE
) -> DataFrame:
    """One row per input row: id, number of other rows linked, smallest id reachable, whether the row is that one.

    Rows link if their labels are equal and not null and their cosine is ``least`` or more. Vectors that are null,
    zero, or hold null or non-finite parts link with nothing, as do vectors of unlike lengths. Rows with a null id
    are counted as links but never as a component's smallest id; repeats of an id are rows of their own that share
    its component, all of them kept if it is the smallest. An empty table gives an empty table.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(F.col("label").isNotNull() & _usable(F.col("v")), F.col("v")))
    rows = rows.withColumn("same", F.when(F.col("v").isNotNull(), F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.array_join(F.col("v").cast("array<string>"), ",")), 256)))
    rows = materialize(rows, "vectors")
    groups = rows.where(F.col("same").isNotNull()).groupBy("same").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.first("label").alias("label"), F.first("v").alias("v"))
    groups = materialize(groups.withColumn("rep", F.monotonically_increasing_id()).withColumn("size", F.size("v")), "groups")
    bits = key_bits(groups.groupBy("label").count().agg(F.max("count")).first()[0] or 0)
    words = len(_words(bits))
    size, learned, norm = _learned(groups, words)
    coded = materialize(_coded(groups.select("rep", "label", "size", "v"), words, size, learned).drop("v"), "codes")
    pairs = _candidates(coded, bits, radius(least, BITS * words, norm))
    left, right = (groups.select(F.col("rep").alias(x), F.col("v").alias(f"v{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    close = pairs.join(left, "a").join(right, "b").withColumn("cosine", _cosine("va", "vb")).where(F.col("cosine") >= least)
    close = materialize(close.select("a", "b", "na", "nb"), "close")
    others = close.select(F.col("a").alias("rep"), F.col("nb").alias("m")).union(close.select("b", "na")).groupBy("rep").agg(F.sum("m").alias("m"))
    group = components(close.select("a", "b")).withColumnRenamed("node", "rep")
    named = groups.select("same", "rep", "n", "first").join(group, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = materialize(named.join(others, "rep", "left").withColumn("links", F.col("n") - 1 + F.coalesce("m", F.lit(0))), "named")
    least_id = named.groupBy("component").agg(F.min("first").alias("component_id"))
    per = named.join(least_id, "component").select("same", "links", "component_id")
    out = rows.select("id", "same").join(per, "same", "left")
    component = F.when(F.col("same").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
