import hashlib
import math
import random

import numpy as np

from veilspark.llm import centroids


def plain(rows, k=8, rounds=10, size=64):
    kept = [(i, [math.floor(1024 * float(x)) if abs(x) < 1e300 else int(x) * 1024 for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    at = [q for _, q in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    far = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c, strict=True))
    near = lambda q: min((far(q, c), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = {}
        for _, q in kept:
            own.setdefault(near(q)[1], []).append(q)
        at = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if j in own else c for j, c in enumerate(at)]
    got = [(i, *near(q)) for i, q in kept]
    per = {}
    for _, d, j in got:
        per[j] = per.get(j, 0) + d
    fit = lambda x: x if x < 1 << 63 else None
    whole = lambda j: fit(per[j]) if all(fit(d) is not None for _, d, c in got if c == j) else None
    every = fit(sum(per.values())) if all(fit(d) is not None for _, d, _ in got) else None
    return sorted(((i, j, fit(d), whole(j), every, hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for i, d, j in got), key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, v int")
    return sorted((tuple(r) for r in centroids.cluster(df, **more).collect()), key=str)


def test_like_a_plain_comparison_with_odd_rows_ties_and_repeats(spark):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.05 + i % 5 * 0.2) for x in centres[i % 6]]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(40)] + [rows[7], rows[7]] + [(7, rows[8][1])]
    rows += [(None, rows[1][1]), (300, None), (301, []), (302, [0.5] * 63), (303, [None, *[0.5] * 63]), (304, [float("nan"), *[0.5] * 63]), (305, [float("inf")] * 64), (306, [0.0] * 64)]
    assert run(spark, rows) == plain(rows)


def test_very_large_parts_and_few_or_no_vectors(spark):
    few = [(1, [1e5 * i for i in range(64)]), (2, [-3.25] * 64), (3, [1e17] * 64)]
    assert run(spark, few, rounds=3) == plain(few, rounds=3)
    large = [(i, [1e306 * (i + 1)] * 64) for i in range(9)] + [(20 + i, [0.25 * i] * 64) for i in range(9)]
    assert run(spark, large, rounds=3) == plain(large, rounds=3)
    assert run(spark, [(1, None)]) == [] and run(spark, []) == []


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(1)
    for spread in (1, 1000, 1 << 20):
        points = (rng.normal(size=(400, 64)) * rng.choice([1, 5, 20], size=(400, 1)) * spread).astype("i8")
        points[50:60] = points[40] + rng.integers(0, 2, size=(10, 64))
        base = centroids.Simplex(points[:100], 6)
        a, c = base.apexes(points), points[rng.permutation(400)[:20]]
        ok = centroids.possible(a, base.apexes(c))
        far = ((points[:, None].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
        best = far.min(axis=1)[:, None] == far
        assert (ok | ~best).all()
    hubs = rng.normal(size=(5, 64)) * 500
    points = (hubs[np.arange(400) % 5] + rng.normal(size=(400, 64)) * 20).astype("i8")
    base = centroids.Simplex(points[:100], 6)
    assert centroids.possible(base.apexes(points), base.apexes(points[:5])).mean() < 0.25
    same = centroids.Simplex(np.array([[3, 4]] * 5), 6)
    assert len(same.pivots) == 1 and centroids.possible(same.apexes(np.array([[3, 4]])), same.apexes(np.array([[3, 4], [30, 4]]))).tolist() == [[True, False]]


def test_floor_is_exact():
    x = np.array([[0.1, -0.1, 1 / 1024, -1e-300, 5e-324]])
    assert centroids.whole(x).tolist() == [[102, -103, 1, -1, 0]]
    assert centroids.whole(np.array([[1e300, -0.0001]])).tolist() == [[int(1e300) * 1024, -1]]
