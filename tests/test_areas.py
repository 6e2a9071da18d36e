"""Areas of boxes: those measured together in tasks against a raster, and against those of a table of slabs."""

import random

import numpy as np
import pyarrow as pa

from veilspark.operators import geometry as E


def made(n, seed, size=40):
    r = random.Random(seed)
    return [dict(zip("xywh", (float(r.randint(0, size)), float(r.randint(0, size)), float(r.randint(1, 12)), float(r.randint(1, 12))), strict=True)) for _ in range(n)]


def raster(boxes):
    grid = np.zeros((64, 64), bool)
    for b in boxes:
        grid[int(b["x"]) : int(b["x"] + b["w"]), int(b["y"]) : int(b["y"] + b["h"])] = True
    return float(grid.sum())


def test_areas_of_lists_are_those_of_a_raster():
    same = [{"x": 1.0, "y": 2.0, "w": 3.0, "h": 4.0}] * 3
    lists = [[], same, *(made(i % 40, i) for i in range(300)), *(made(256, 1000 + i) for i in range(70)), []]
    kind = pa.list_(pa.struct([(c, pa.float64()) for c in "xywh"]))
    assert E._areas(pa.array(lists, kind)).to_pylist() == [raster(b) for b in lists]
    assert E._areas(pa.array([[], *lists, same], kind)[1:-1]).to_pylist() == [raster(b) for b in lists]
    assert E._areas(pa.array([], kind)).to_pylist() == [] and E._areas(pa.array([[], []], kind)).to_pylist() == [0.0, 0.0]


def test_crowded_cells_are_measured_as_tables(spark, monkeypatch):
    rows = [(i, *b.values()) for i, n in enumerate((1, 30, 300)) for b in made(n, i)]
    boxes = spark.createDataFrame(rows, "image int, x double, y double, w double, h double")
    want = {i: raster(made(n, i)) for i, n in enumerate((1, 30, 300))}
    for most in (0, 20, 256):
        monkeypatch.setattr(E, "CELL_BOXES", most)
        assert {r.image: r.area for r in E.union_area(boxes, "image").collect()} == want
