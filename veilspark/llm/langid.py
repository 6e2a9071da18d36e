"""Language identification by string kernels.

A text's features are the character n-grams of length one to three that it holds (a blended spectrum, presence only),
hashed to ``BUCKETS``. The kernel of two texts is the number of features they share over the root of the product of
their numbers of features. A few landmark texts of each language span the Nystroem approximation of that kernel's
space; one-versus-rest ridge regression there learns the languages. Scoring is one matrix product for each batch of
texts: their presence rows by the landmarks' rows, folded with the regression's weights.

The classifier is fitted on a bounded sample: of every language the first texts by a digest of their ids, as many of each
as ``SAMPLE`` has room for, ``PER_LANG`` at most and one at least. The first of each, ``LANDMARKS`` at most and as many as
``ALL_LANDMARKS`` has room for, again one at least, are landmarks. So no language is lost, however rare, and where there
are more languages than room, the bounds are their number. Every text is scored whole. A text for which no language's value is above zero is claimed by none (of two languages one
always claims, for their values mirror each other).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, uniform

ship(__name__)

BUCKETS = 1 << 18
PER_LANG = 200
SAMPLE = 8_000
LANDMARKS = 16
ALL_LANDMARKS = 256
RIDGE = 1e-3
SHARPNESS = 4.0
UNKNOWN = "und"
_SPREAD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_PIECE = 1 << 20  # characters hashed at a time, which bounds memory for very long texts


def has_letter(text: str | None) -> bool:
    return bool(text) and (text.isalpha() or any(c.isalpha() for c in text))


def mark(text: str, table: np.ndarray) -> None:
    """Set the buckets of the n-grams in ``text``; characters other than letters count as one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    points[(points < 97) | ((points > 122) & (points < 128))] = 32
    mix = [np.uint64(x) for x in _SPREAD]
    down = np.uint64(46)
    for at in range(0, len(points), _PIECE):
        p = points[at : at + _PIECE + 2]
        table[(p * mix[0]) >> down] = True
        if len(p) > 1:
            pair = p[:-1] * mix[1] + p[1:] * mix[0]
            table[(pair ^ (pair >> np.uint64(29))) * mix[2] >> down] = True
        if len(p) > 2:
            three = p[:-2] * mix[2] + p[1:-1] * mix[1] + p[2:] * mix[0]
            table[(three ^ (three >> np.uint64(31))) * mix[1] >> down] = True


@dataclass
class Model:
    """``vocabulary``: the landmarks' buckets; ``weights``: from presence in them, over a text's norm, to languages."""

    langs: list[str]
    vocabulary: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def values(self, presence: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The one-versus-rest values, a row for each text, to five places, so that equal texts' values are equal."""
        return np.round(presence @ self.weights / np.sqrt(np.maximum(sizes, 1))[:, None] + self.bias, 5)

    @staticmethod
    def shares(value: np.ndarray) -> np.ndarray:
        """Their softmax."""
        value = np.exp(SHARPNESS * (value - value.max(axis=1, keepdims=True)))
        return value / value.sum(axis=1, keepdims=True)


def packed(table: np.ndarray) -> bytes:
    """A text's buckets, as a list if it is short and else as a bitmap: 32 KiB at most."""
    at = np.flatnonzero(table).astype("<i4")
    return b"l" + at.tobytes() if len(at) < BUCKETS // 32 else b"b" + np.packbits(table).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i4", offset=1) if raw[:1] == b"l" else np.flatnonzero(np.unpackbits(np.frombuffer(raw, "u1", offset=1)))


def fit(langs: list[str], features: list[bytes], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """From each text's language and packed buckets. The first texts of each language are the landmarks."""
    names = sorted(set(langs))
    each = max(1, min(landmarks, ALL_LANDMARKS // len(names)))
    where = {n: i for i, n in enumerate(names)}
    of: list[list[int]] = [[] for _ in names]
    for i, n in enumerate(langs):
        of[where[n]].append(i)
    place = [i for own in of for i in own[:each]]
    vocabulary = np.unique(np.concatenate([unpacked(features[i]) for i in place]))
    sizes = np.array([max(1, len(unpacked(f))) for f in features])

    def rows(which: list[int]) -> np.ndarray:
        out = np.zeros((len(which), len(vocabulary)), dtype=np.float32)
        for r, i in enumerate(which):
            out[r] = np.isin(vocabulary, unpacked(features[i]), assume_unique=True)
        return out

    basis = rows(place) / np.sqrt(sizes[place])[:, None].astype(np.float32)
    value, vector = np.linalg.eigh((basis @ basis.T).astype(np.float64))
    keep = value > 1e-6 * value.max()
    fold = vector[:, keep] / np.sqrt(value[keep])
    kernel = np.concatenate([rows(list(range(i, min(i + 100, len(langs))))) @ basis.T for i in range(0, len(langs), 100)])
    x = np.column_stack([kernel / np.sqrt(sizes)[:, None] @ fold, np.ones(len(langs))])
    mine = np.array([where[n] for n in langs])
    y = np.where(mine[:, None] == np.arange(len(names))[None, :], 1.0, -1.0)
    balance = 1 / np.array([len(own) for own in of])[mine]
    w = np.linalg.solve((x * balance[:, None]).T @ x + ridge * np.eye(x.shape[1]), (x * balance[:, None]).T @ y)
    return Model(names, vocabulary, (basis.T @ (fold @ w[:-1])).astype(np.float32), w[-1])


def sample(docs: DataFrame, train: Column, id_col: str, text: str, lang: str) -> tuple[list[str], list[bytes]]:
    """Languages and buckets of the texts to learn from."""
    rows = docs.where(train & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), uniform(F.col(id_col), "lang:").alias("u"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    langs = rows.select("lang").distinct().count()
    each = max(1, min(PER_LANG, SAMPLE // max(1, langs)))
    # the first keys of each language, without texts: every task puts out ``each`` of one language at most
    first = F.row_number().over(Window.partitionBy("lang").orderBy("u", "tie"))
    keys = rows.select("lang", "u", "tie").distinct().withColumn("n", first).where(F.col("n") <= each)
    found = rows.join(F.broadcast(keys) if langs <= SAMPLE else keys, ["lang", "u", "tie"])  # ``SAMPLE`` keys at most are sent
    picked = found.groupBy("lang", "n").agg(F.min("text").alias("text"))  # repeats are one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BUCKETS, dtype=bool)
        for batch in batches:
            got = []
            for raw in batch.column(2):
                table[:] = False
                mark(raw.as_py(), table)
                got.append(packed(table))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.binary())], ["lang", "n", "buckets"])

    found = picked.mapInArrow(run, "lang string, n int, buckets binary").collect()  # ``each`` of each language
    found.sort(key=lambda r: (r.n, r.lang))
    return [r.lang for r in found], [bytes(r.buckets) for r in found]


def predict(docs: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` plus ``lang_pred``, ``score`` and ``claim``: the language learned that fits best, its share of the softmax,
    and its one-versus-rest value.

    Texts that are null or hold no letter are ``und`` with score 0 and no claim, as is every text if no row can be
    learned from. Of equal values the first name wins. Rows are judged each by its text alone: repeats alike, and a
    very long text is marked piece by piece. Columns of those three names are replaced; an empty table gives one.
    """
    langs, features = sample(docs, train, id_col, text, lang)
    kept = docs.drop("lang_pred", "score", "claim")
    at = kept.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(fit(langs, features) if langs else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = sent.value, np.zeros(BUCKETS, dtype=bool)
        for batch in batches:
            names, scores, claims = [UNKNOWN] * len(batch), np.zeros(len(batch)), np.full(len(batch), np.nan)
            for lo in range(0, len(batch) if model else 0, 512):
                which, presence, sizes = [], [], []
                for i, raw in enumerate(batch.column(at).slice(lo, 512), lo):
                    value = raw.as_py()
                    if has_letter(value):
                        table[:] = False
                        mark(value, table)
                        which.append(i)
                        presence.append(table[model.vocabulary])
                        sizes.append(np.count_nonzero(table))
                if which:
                    got = model.values(np.array(presence, dtype=np.float32), np.array(sizes))
                    best = got.argmax(axis=1)
                    claims[which], scores[which] = got.max(axis=1), model.shares(got).max(axis=1)
                    for i, b in zip(which, best, strict=True):
                        names[i] = model.langs[b]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores), pa.array(claims, from_pandas=True)], [*batch.schema.names, "lang_pred", "score", "claim"])

    fields = [*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("claim", T.DoubleType())]
    return kept.mapInArrow(run, T.StructType(fields))


def keep_known(docs: DataFrame, train: Column, least: float = 0.0, langs: Sequence[str] | None = None, **columns: str) -> DataFrame:
    """``docs`` without those that are rejected: texts that no language claims with a value of ``least`` or more, and, if
    ``langs`` are given, those of another language.

    Null texts and texts without a letter go; repeated rows are judged alike and all stay or all go; columns may have
    any names. If no row can be learned from, nothing is claimed and nothing stays; an empty table gives an empty table.
    """
    names = docs.columns
    safe = [f"__veil_{i}" for i in range(len(names))]
    given = {v: safe[names.index(v)] for v in (columns.get("id_col", "doc_id"), columns.get("text", "text"), columns.get("lang", "lang"))}
    out = predict(docs.toDF(*safe), train, **dict(zip(("id_col", "text", "lang"), given.values(), strict=True)))
    wanted = F.lit(True) if langs is None else F.col("lang_pred").isin(*langs)
    return out.where((F.col("claim") >= least) & wanted).select(*safe).toDF(*names)
