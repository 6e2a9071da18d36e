"""Vector groups against all pairs."""

import numpy as np
import pytest

from veilspark.llm import embed_dedup as E


def plain(rows):
    """id -> (links, component) by all pairs."""
    ids = [r[0] for r in rows]
    ok = [v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for o, (_, v, _) in zip(ok, rows, strict=True)]
    links = {i: set() for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out[ids[i]] = (len(links[i]), min(ids[j] for j in seen))
    return out


@pytest.mark.parametrize("bits", [16, 20, 24])
def test_recall_on_the_table(spark, sf, monkeypatch, bits):
    monkeypatch.setattr(E, "key_bits", lambda largest: bits)  # as for tables of a million vectors and more
    rng = np.random.default_rng(3)
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    for i, (_, v, label) in enumerate(rows[:200]):
        noise = rng.normal(size=(3, len(v)))
        for j, n in enumerate(noise):  # cosine to the first is 0.98 to 0.995
            rows.append((10_000 + 10 * i + j, list(map(float, v + n / np.linalg.norm(n) * np.linalg.norm(v) * rng.uniform(0.1, 0.2))), label))
    want = plain(rows)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(table).collect()}
    assert set(got) == set(want)
    assert all(got[i][0] <= want[i][0] for i in want)  # no link below the threshold
    total = sum(n for n, _ in want.values())
    assert total and sum(n for n, _, _ in got.values()) >= 0.9 * total
    assert all(kept == (i == c) for i, (_, c, kept) in got.items())


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, [2.0, 4.0, 6.0], 0), (3, v, 1), (4, v, None), (5, None, 0), (6, [0.0, 0.0, 0.0], 0), (7, [nan, 1.0, 1.0], 0), (8, [inf, 1.0, 1.0], 0), (9, [None, 1.0, 1.0], 0), (10, v, 0), (11, [], 0), (12, [1.0, 2.0], 0)]
    schema = "vec_id long, embedding array<float>, label int"
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[10] == (2, 1, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 11, 12))
    assert E.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    twice = E.near_duplicates(spark.createDataFrame([(1, v, 0), (1, v, 0), (None, v, 0)], schema)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in twice) == [(0, 2, 1), (1, 2, 1), (1, 2, 1)]


def test_rotation_is_orthogonal():
    x = np.random.default_rng(1).normal(size=(300, 12))
    _, axes = E.learn(x, bits=12)
    assert np.allclose(axes.T @ axes, np.eye(12), atol=1e-8)


def test_keys_grow_with_the_largest_label():
    assert [E.key_bits(n) for n in (0, 1000, 60_000, 1 << 20, 1 << 40)] == [16, 16, 16, 21, 32]
    assert [len(E._words(b)) * (E.BITS // b) for b in (16, 17, 21, 32)] == [4, 6, 6, 4]
    assert 12 <= E.radius(0.98, 64) <= 18 < E.radius(0.98, 128) < E.radius(0.98, 128, 0.5)


def test_vectors_of_many_lengths(spark):
    rng = np.random.default_rng(9)
    rows = []
    for n in (5, 6, 7, 8, 30):
        for i in range(40):
            v = rng.normal(size=n)
            rows += [(len(rows), v.tolist(), i % 2), (len(rows) + 1, (v + rng.normal(size=n) * 0.01).tolist(), i % 2)]
    want = plain(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values())
