"""Centroid clustering (Lloyd's rounds in exact integers) behind n-simplex bounds.

A few vectors are pivots: the corners of a simplex that is written down from their distances alone. The distances of any
other point to the corners put it at one apex above that simplex, and the apexes of two points bound their distance: it
is at least the apexes' Euclidean distance, and at most that with one apex mirrored below the base. Every vector's apex is
computed once and kept with it; in each round only the centroids get new ones. A centroid whose lower bound is above the
least upper bound isn't compared; where one is left, nothing is; else the rest are compared in integers. Bounds are
widened by what rounding can do to them, so the result is that of a plain comparison with all centroids.

What goes through the driver is the model: ``k`` centroids, the pivots, and sums of clusters that tasks add up first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship

ship(__name__)

K, ROUNDS, DIMENSIONS, SCALE = 8, 10, 64, 1024
PIVOTS, SAMPLE = 6, 256
_SMALL = 1 << 27  # whole parts below it have squared distances, in 64 dimensions, within 64 bits
_LIMB = 48
_EPS = 1e-14


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)`` exactly: as 64-bit integers where distances fit, else as Python's."""
    with np.errstate(over="ignore"):
        floored = np.floor(x * scale)
    if (np.abs(floored) < _SMALL).all():
        return floored.astype("i8")
    from fractions import Fraction

    return np.array([[int(Fraction(v) * scale // 1) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


class Simplex:
    """The base: pivots in the order in which each rises highest above those before it."""

    def __init__(self, points: np.ndarray, most: int = PIVOTS):
        far = self._squares(points, points[0])
        rows, left, picked = np.zeros((len(points), 0)), far.copy(), [0]
        while len(picked) < most and left.max() > 1e-4 * far.max():
            p = int(left.argmax())
            inner = (far + far[p] - self._squares(points, points[p])) / 2
            column = (inner - rows @ rows[p]) / np.sqrt(left[p])
            rows = np.column_stack([rows, column])
            left = np.maximum(left - column * column, 0)
            picked.append(p)
        self.pivots, self.corners = points[picked], rows[picked[1:]]
        self.back = np.linalg.inv(self.corners) if len(self.corners) else np.zeros((0, 0))
        self.size = float(np.sqrt(far[picked].max()))

    @staticmethod
    def _squares(points: np.ndarray, p: np.ndarray) -> np.ndarray:
        apart = points - p
        return (apart * apart).sum(axis=1).astype("f8")

    def apexes(self, points: np.ndarray) -> np.ndarray:
        """A row for each point: coordinates over the base, height above it, and how much rounding may have moved it."""
        squares = np.column_stack([self._squares(points, p) for p in self.pivots])
        inner = (squares[:, :1] + (self.corners * self.corners).sum(axis=1) - squares[:, 1:]) / 2
        over = inner @ self.back.T
        height = np.sqrt(np.maximum(squares[:, 0] - (over * over).sum(axis=1), 0))
        reach = np.sqrt(squares.max(axis=1)) + self.size
        moved = _EPS * reach * reach * np.abs(self.back).sum()
        return np.column_stack([over, height, moved + np.sqrt(_EPS * reach * reach + 2 * reach * moved)])


def possible(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For apexes ``x`` and ``c``: which of ``c`` may be nearest to each of ``x``."""
    flat = ((x[:, None, :-2] - c[None, :, :-2]) ** 2).sum(axis=2)
    slack = x[:, None, -1] + c[None, :, -1]
    lower = np.sqrt(flat + (x[:, None, -2] - c[None, :, -2]) ** 2) - slack
    upper = np.sqrt(flat + (x[:, None, -2] + c[None, :, -2]) ** 2) + slack
    return lower <= upper.min(axis=1)[:, None]


def nearest(points: np.ndarray, apexes: np.ndarray, centroids: list[list[int]], tops: np.ndarray | None, always: bool = False) -> tuple[np.ndarray, list[int]]:
    """Each point's nearest centroid, the smaller number of equally near ones, and the squared distance: always, or
    only where two or more centroids had to be compared. Without ``tops`` all are compared."""
    ok = np.ones((len(points), len(centroids)), dtype=bool) if tops is None or points.dtype == object else possible(apexes, tops)
    best, least = ok.argmax(axis=1), np.full(len(points), -1, dtype=points.dtype)
    asked = np.ones(len(points), dtype=bool) if always else ok.sum(axis=1) > 1
    kind = points.dtype if tops is not None else object
    for j, c in enumerate(centroids):
        at = np.flatnonzero(ok[:, j] & asked)
        apart = points[at].astype(kind) - np.array(c, dtype=kind)
        square = (apart * apart).sum(axis=1)
        closer = (least[at] < 0) | (square < least[at])
        if square.dtype == object:
            least = least.astype(object)
        best[at[closer]], least[at[closer]] = j, square[closer]
    return best, least.tolist()


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """``value`` as parts of 48 bits, the highest of which has the sign: sums of parts fit in Spark's numbers."""
    i, half = 0, 1 << (_LIMB - 1)
    while not -half <= value < half:
        yield i, value & ((1 << _LIMB) - 1)
        value, i = value >> _LIMB, i + 1
    yield i, value


def _usable(v: Column, size: int) -> Column:
    return (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


class _Model:
    """What tasks need: the base, the centroids and, where their distances fit in 64 bits, the centroids' apexes."""

    def __init__(self, base: Simplex | None, centroids: list[list[int]]):
        self.base, self.centroids = base, centroids
        fits = base is not None and all(abs(v) < _SMALL for c in centroids for v in c)
        self.tops = base.apexes(np.array(centroids, dtype="i8")) if fits else None

    def assign(self, batch: pa.RecordBatch, size: int, scale: int, always: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]]:
        """``(rows, points, cluster, distance)`` of a batch with columns of vectors and apexes."""
        x = np.frombuffer(b"".join(batch.column("v").to_pylist()), "f8").reshape(-1, size)
        apexes = np.frombuffer(b"".join(batch.column("apex").to_pylist()), "f8").reshape(len(x), -1)
        with np.errstate(over="ignore"):
            small = (np.abs(x * scale) < _SMALL).all(axis=1)
        for at in (np.flatnonzero(small), np.flatnonzero(~small)):
            if len(at):
                points = whole(x[at], scale)
                yield at, points, *nearest(points, apexes[at], self.centroids, self.tops, always)


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, size: int = DIMENSIONS,
    scale: int = SCALE, seed: str = "3:", pivots: int = PIVOTS,
) -> DataFrame:
    """``(id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` for every vector of ``size`` finite parts.

    Vectors become integers, ``floor(scale * x)``; centroids start as the ``k`` vectors whose ids have the least digests
    (after ``seed``; equal ids by their parts; fewer vectors make fewer centroids). Vectors that are null, of another
    length, or hold null or non-finite parts are left out; a null id counts as an empty one; repeated rows are vectors
    each; ties go to the smaller number; distances and sums beyond 64 bits are null; other columns are left behind; an
    empty table gives an empty table.
    """
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("x")).where(_usable(F.col("x"), size))
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(digest, "x").limit(max(k, SAMPLE)).collect()  # a bounded sample
    points = [whole(np.array([r.x]), scale)[0].tolist() for r in first]
    centroids, within = points[:k], [p for p in points if all(abs(v) < _SMALL for v in p)]
    base = Simplex(np.array(within, dtype="i8"), pivots) if within else None
    id_type = rows.schema["id"].dataType.simpleString()

    def raised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            apexes = np.full((len(x), 1 if base is None else len(base.pivots) + 1), np.inf)
            with np.errstate(over="ignore"):
                small = (np.abs(x * scale) < _SMALL).all(axis=1)
            if base is not None and small.any():
                apexes[small] = base.apexes(whole(x[small], scale))
            columns = [pa.array([r.tobytes() for r in part], pa.binary()) for part in (x, apexes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "v", "apex"])

    held = materialize(rows.mapInArrow(raised, f"id {id_type}, v binary, apex binary"), "apexes")

    def sums(model: _Model):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list] = {}
            for batch in batches:
                for _, points, best, _ in model.assign(batch, size, scale):
                    for j in np.unique(best).tolist():
                        own = points[best == j]
                        n, so_far = total.get(j, (0, 0))
                        total[j] = [n + len(own), so_far + own.sum(axis=0).astype(object)]
            parts = [(j, -1, 0, n) for j, (n, _) in total.items()]
            parts += [(j, place, limb, part) for j, (_, s) in total.items() for place, value in enumerate(s) for limb, part in _limbs(int(value))]
            columns = [*zip(*parts, strict=True)] or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["j", "place", "limb", "part"])

        return run

    for _ in range(rounds if centroids else 0):
        model = _Model(base, centroids)
        added = held.select("v", "apex").mapInArrow(sums(model), "j long, place long, limb long, part long")
        added = added.groupBy("j", "place", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect()  # k * size rows
        got: dict[tuple[int, int], int] = {}
        for r in added:
            got[r.j, r.place] = got.get((r.j, r.place), 0) + (int(r.part) << (_LIMB * r.limb))
        centroids = [[got[j, i] // got[j, -1] for i in range(size)] if (j, -1) in got else c for j, c in enumerate(centroids)]

    model = _Model(base, centroids)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, far = np.zeros(len(batch), "i4"), np.zeros(len(batch), object)
            for at, _, j, squares in model.assign(batch, size, scale, always=True):
                best[at], far[at] = j, squares
            far = pa.array([x if x < 1 << 63 else None for x in far.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(best), far], ["id", "cluster", "distance"])

    out = materialize(held.mapInArrow(placed, f"id {id_type}, cluster int, distance long"), "clusters")
    known = {r.cluster: (r.s if r.full else None) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), (F.count("distance") == F.count("*")).alias("full")).collect()}
    fit = lambda x: int(x) if x is not None and x < 1 << 63 else None
    every = sum(known.values()) if None not in known.values() else None
    per = [(j, fit(known.get(j)), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    model_rows = held.sparkSession.createDataFrame(per, "cluster int, cluster_inertia long, centroid_sha256 string")
    total = F.lit(fit(every)).cast("long").alias("inertia")
    return out.join(F.broadcast(model_rows), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", total, "centroid_sha256")  # k rows


def sql(k: int = K, rounds: int = ROUNDS, size: int = DIMENSIONS, scale: int = SCALE, seed: str = "3:") -> str:
    """The same in DuckDB, for ids that differ and parts whose sums fit in 64 bits: each round unrolled."""
    square = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings "
        f"WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY s) - 1 AS INTEGER) AS j, q FROM (SELECT sha256('{seed}' || CAST(vec_id AS VARCHAR)) AS s, q FROM v ORDER BY s LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        steps.append(f"d{i} AS MATERIALIZED (SELECT vec_id, any_value(v.q) AS q, min(CAST({square} AS BIGINT)) AS distance, arg_min(j, (CAST({square} AS BIGINT), j)) AS j FROM v, c{i} c GROUP BY vec_id)")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT j, p, sum(x) AS s, count(*) AS n FROM (SELECT j, unnest(q) AS x, unnest(range(1, {size + 1})) AS p FROM d{i}) GROUP BY j, p)")
            steps.append(f"m{i} AS (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS q FROM s{i} GROUP BY j)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m USING (j))")
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT vec_id, d.j AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY d.j) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM d{rounds} d JOIN c{rounds} c USING (j)"
    )
