"""Boxes: clipping, overlap, areas without double counting, greedy choices in a stated order."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import spread

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BOX = ("x", "y", "w", "h")
MERGE_LIMIT = 2000
CELL_BOXES = 256


def clip_rect(width: Column, height: Column, pad: float = 0.0, whole: bool = True) -> Column:
    """``(x, y, w, h)`` of the columns x, y, w, h inside an image, grown outward to whole pixels; null if nothing is left."""
    low, high = (F.floor, F.ceil) if whole else (lambda v: v, lambda v: v)
    x, y = (F.greatest(F.lit(0.0), low(F.col(a) - pad).cast("double")) for a in "xy")
    right, bottom = (F.least(m.cast("double"), high(F.col(a) + F.col(s) + pad).cast("double")) for a, s, m in (("x", "w", width), ("y", "h", height)))
    box = F.struct(x.alias("x"), y.alias("y"), (right - x).alias("w"), (bottom - y).alias("h"))
    return F.when((right > x) & (bottom > y), box)


def intersection(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Area that two boxes share; a box is a function from x, y, w, h to columns."""
    w = F.least(a("x") + a("w"), b("x") + b("w")) - F.greatest(a("x"), b("x"))
    h = F.least(a("y") + a("h"), b("y") + b("h")) - F.greatest(a("y"), b("y"))
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def iou(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    shared = intersection(a, b)
    union = a("w") * a("h") + b("w") * b("h") - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def interval_iou(a: Column, b: Column) -> Column:
    shared = F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))
    union = a["end"] - a["start"] + b["end"] - b["start"] - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def cell_size(*boxes: DataFrame) -> float:
    """The side of a grid's cells: a power of two, so that cutting boxes at it is exact, no smaller than four times
    what boxes are on the average nor than a 64th of the largest, which is therefore in 65 x 65 cells at most."""
    sides = reduce(DataFrame.unionByName, (b.where("w > 0 AND h > 0").select(F.greatest("w", "h").cast("double").alias("s")) for b in boxes))
    mean, most = sides.agg(F.avg("s"), F.max("s")).first()
    return 2.0 ** math.ceil(math.log2(max(4 * mean, most / 64))) if mean and most < float("inf") else 1.0


def in_cells(boxes: DataFrame, cell: float) -> DataFrame:
    """A row for each cell that a box touches, with the cell's place ``cx, cy``."""
    span = lambda a, s: F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(a) + F.col(s)) / cell))
    return boxes.withColumn("cx", F.explode(span("x", "w"))).withColumn("cy", F.explode(span("y", "h")))


def near_pairs(a: DataFrame, b: DataFrame, *keys: str, cell: float | None = None) -> DataFrame:
    """Pairs of boxes, one of each side and of equal keys, that share an area: all columns of ``a`` and those of ``b`` that
    aren't keys, of which the box's end in 2. Boxes meet in the cells of a grid, a pair only in the cell where what
    they share begins."""
    cell = cell or cell_size(a, b)
    names = {c: f"{c}2" if c in BOX else c for c in b.columns if c not in keys}
    here = in_cells(a.where("w > 0 AND h > 0"), cell)
    there = in_cells(b.where("w > 0 AND h > 0"), cell).select(*keys, "cx", "cy", *(F.col(c).alias(n) for c, n in names.items()))
    met = here.join(there, [*keys, "cx", "cy"])
    left, top = F.greatest("x", "x2"), F.greatest("y", "y2")
    shares = (F.least(F.col("x") + F.col("w"), F.col("x2") + F.col("w2")) > left) & (F.least(F.col("y") + F.col("h"), F.col("y2") + F.col("h2")) > top)
    first = (F.col("cx") == F.floor(left / cell)) & (F.col("cy") == F.floor(top / cell))
    return met.where(shares & first).select(*a.columns, *names.values())


def union_area(boxes: DataFrame, *keys: str, cell: float | None = None) -> DataFrame:
    """``(keys, area)``: boxes are cut at the cells of a grid, and each cell's are measured by themselves: those of many
    cells together in tasks, those of a cell with more than ``CELL_BOXES`` as a table of their own."""
    sound = boxes.where("w > 0 AND h > 0").select(*keys, *BOX)
    cell = cell or cell_size(sound)
    cut = in_cells(sound, cell)
    for a, s, c in (("x", "w", "cx"), ("y", "h", "cy")):
        low = F.greatest(F.col(a), F.col(c) * cell)
        cut = cut.withColumns({a: low, s: F.least(F.col(a) + F.col(s), (F.col(c) + 1) * cell) - low})
    packed = cut.groupBy(*keys, "cx", "cy").agg(F.collect_list(F.struct(*(F.col(c).cast("double").alias(c) for c in BOX))).alias("_boxes"))
    few = packed.where(F.size("_boxes") <= CELL_BOXES).select(*keys, F.arrow_udf(_areas, "double")(F.col("_boxes")).alias("area"))
    many = _slabs(packed.where(F.size("_boxes") > CELL_BOXES).select(*keys, "cx", "cy", F.inline("_boxes")), *keys, "cx", "cy").select(*keys, "area")
    return few.unionByName(many).groupBy(*keys).agg(F.sum("area").alias("area"))


def _areas(lists: pa.Array) -> pa.Array:
    """The area under each list's boxes; as many lists at a time as have few edges in all."""
    n = np.asarray(pc.list_value_length(lists))
    ends, flat = np.cumsum(n), lists.flatten()
    x, y, w, h = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
    parts = np.cumsum(2 * n.astype(np.int64) ** 2) // (1 << 22)
    limits = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(n)]
    out = []
    for a, b in zip(limits, limits[1:], strict=False):
        at = slice(ends[a] - n[a] if a < b else 0, ends[b - 1] if a < b else 0)
        out.append(_swept(np.repeat(np.arange(b - a), n[a:b]), x[at], y[at], (x + w)[at], (y + h)[at], b - a))
    return pa.array(np.concatenate(out))


def _swept(group: np.ndarray, left: np.ndarray, top: np.ndarray, right: np.ndarray, bottom: np.ndarray, groups: int) -> np.ndarray:
    """As :func:`_slabs`, for groups of boxes side by side: slabs lie between a group's sorted edges."""
    if not len(group):
        return np.zeros(groups)
    edges = np.concatenate([left, right])
    order = np.lexsort((edges, np.concatenate([group, group])))
    edges, place = edges[order], np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    first, spans = place[: len(group)], place[len(group) :] - place[: len(group)]
    box = np.repeat(np.arange(len(group)), spans)
    slab = first[box] + np.arange(len(box)) - np.repeat(np.cumsum(spans) - spans, spans)
    order = np.lexsort((top[box], slab))
    box, slab = box[order], slab[order]
    ends, rank = np.unique(bottom, return_inverse=True)
    lowest = np.maximum.accumulate(slab * len(ends) + rank[box])  # by rank, so that it starts anew in each slab
    start, again = top[box], slab[1:] == slab[:-1]
    start[1:][again] = np.maximum(start[1:], ends[(lowest[:-1] - slab[:-1] * len(ends))])[again]
    part = (edges[slab + 1] - edges[slab]) * np.maximum(0.0, bottom[box] - start)
    return np.bincount(group[box], weights=part, minlength=groups)


def _slabs(boxes: DataFrame, *keys: str) -> DataFrame:
    """``(keys, area)``: vertical slabs between edges, each with the length of its boxes' merged intervals."""
    sound = boxes.where("w > 0 AND h > 0").select(*keys, *BOX)
    edges = sound.select(*keys, F.explode(F.array(F.col("x"), F.col("x") + F.col("w"))).alias("left")).distinct()
    slabs = edges.withColumn("right", F.lead("left").over(Window.partitionBy(*keys).orderBy("left"))).where("right IS NOT NULL")
    inside = slabs.join(sound, list(keys)).where("x < right AND x + w > left")
    order = Window.partitionBy(*keys, "left").orderBy("y", "h")
    before = F.max(F.col("y") + F.col("h")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    length = F.greatest(F.lit(0.0), F.col("y") + F.col("h") - F.greatest(F.col("y"), F.coalesce(before, F.col("y"))))
    return inside.withColumn("part", (F.col("right") - F.col("left")) * length).groupBy(*keys).agg(F.sum("part").alias("area"))


def shared_boxes(a: DataFrame, b: DataFrame, *keys: str, cell: float | None = None) -> DataFrame:
    """Every pair's intersection as a box: what two sets of boxes cover together, by :func:`union_area`."""
    return _shared(near_pairs(a.select(*keys, *BOX), b.select(*keys, *BOX), *keys, cell=cell), *keys)


def _shared(pairs: DataFrame, *keys: str) -> DataFrame:
    x, y = F.greatest("x", "x2"), F.greatest("y", "y2")
    w, h = F.least(F.col("x") + F.col("w"), F.col("x2") + F.col("w2")) - x, F.least(F.col("y") + F.col("h"), F.col("y2") + F.col("h2")) - y
    return pairs.select(*keys, x.alias("x_"), y.alias("y_"), w.alias("w_"), h.alias("h_")).toDF(*keys, *BOX)


def coverage(truth: DataFrame, masks: DataFrame, images: DataFrame, key: str = "image") -> DataFrame:
    """Share of the truth's area under masks, and of the rest of the image that is left open. Null without such area.

    ``images(key, width, height)`` has a row for each image, with or without boxes.
    """
    cell = cell_size(truth, masks)  # what boxes share is no larger than they are
    sides = ((truth, "truth_area"), (masks, "mask_area"), (shared_boxes(truth, masks, key, cell=cell), "shared_area"))
    t, m, both = (union_area(d, key, cell=cell).withColumnRenamed("area", n) for d, n in sides)
    out = images.join(t, key, "left").join(m, key, "left").join(both, key, "left").na.fill(0.0, ["truth_area", "mask_area", "shared_area"])
    outside = F.col("width") * F.col("height") - F.col("truth_area")
    return out.withColumn("covered", F.when(F.col("truth_area") > 0, F.col("shared_area") / F.col("truth_area"))).withColumn("preserved", F.when(outside > 0, (outside - F.col("mask_area") + F.col("shared_area")) / outside))


def _at(s: Column) -> Callable[[str], Column]:
    return lambda k: s[k]


def nms(boxes: DataFrame, key: str = "image", least: float = 0.7, overlap: float = 0.3, most: int = 100) -> DataFrame:
    """Greedy by confidence (ties: smaller id): a box stays if it overlaps no kept one by ``overlap`` or more."""
    item = F.struct((-F.col("confidence")).alias("o"), "box_id", *BOX)
    packed = boxes.where(F.col("confidence") >= least).groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("b"))
    kept = F.aggregate("b", F.slice("b", 1, 0), lambda acc, s: F.when((F.size(acc) >= most) | F.exists(acc, lambda k: iou(_at(s), _at(k)) >= overlap), acc).otherwise(F.concat(acc, F.array(s))))
    return spread(packed, key, items=kept, test="x").select(key, "box_id", (-F.col("o")).alias("confidence"), *BOX)


def greedy_match(pred: DataFrame, truth: DataFrame, key: str = "image", least: float = 0.5, by: str = "confidence") -> DataFrame:
    """``(key, tp, fp, fn)``: one-to-one by greedy choice among overlapping pairs.

    ``by`` confidence: surest prediction first, of equal overlaps the truth with the greatest id; ``by`` input: in
    the order of ids, of equal overlaps the truth with the smallest.
    """
    sure = by == "confidence"
    other = truth.select(key, F.col("box_id").alias("truth_id"), *BOX)
    score = iou(F.col, lambda k: F.col(f"{k}2"))
    place = (-F.col("confidence") if sure else F.lit(0.0)).alias("o")
    pairs = near_pairs(pred.select(key, "box_id", "confidence", *BOX), other, key).withColumn("iou", score).where(F.col("iou") > 0)
    item = F.struct(place, F.col("box_id").alias("p"), (-F.col("iou")).alias("i"), (-F.col("truth_id") if sure else F.col("truth_id")).alias("t"))
    packed = pairs.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("pairs"))
    zero = F.struct(F.lit(None).cast("long").alias("p"), F.array().cast("array<bigint>").alias("used"), F.lit(0).alias("tp"))

    def step(acc: Column, x: Column) -> Column:
        free = ~acc["p"].eqNullSafe(x["p"]) & ~F.array_contains(acc["used"], x["t"])
        take = free & (-x["i"] >= least)
        return F.struct(F.when(free, x["p"]).otherwise(acc["p"]).alias("p"), F.when(take, F.concat(acc["used"], F.array(x["t"]))).otherwise(acc["used"]).alias("used"), (acc["tp"] + F.when(take, 1).otherwise(0)).alias("tp"))

    tp = packed.select(key, F.aggregate("pairs", zero, step, lambda a: a["tp"]).alias("tp"))
    n = pred.select(key, F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(truth.select(key, F.lit(0).alias("p"), F.lit(1).alias("t"))).groupBy(key).agg(F.sum("p").alias("np"), F.sum("t").alias("nt"))
    out = n.join(tp, key, "left").na.fill(0, ["tp"])
    return out.select(key, F.col("tp").cast("long").alias("tp"), (F.col("np") - F.col("tp")).alias("fp"), (F.col("nt") - F.col("tp")).alias("fn"))


def _merged(group: list[tuple[float, float, float, float]]) -> list[tuple[float, float, float, float]]:
    """Corners of a group's boxes, merged until none touch. A box that grew is held against all kept ones again."""
    kept: list[tuple[float, float, float, float]] = []
    for box in group:
        again = True
        while again:
            apart = [o for o in kept if not (box[0] <= o[2] and o[0] <= box[2] and box[1] <= o[3] and o[1] <= box[3])]
            again = len(apart) < len(kept)
            if again:
                met = [o for o in kept if box[0] <= o[2] and o[0] <= box[2] and box[1] <= o[3] and o[1] <= box[3]]
                box = (min(box[0], *(o[0] for o in met)), min(box[1], *(o[1] for o in met)), max(box[2], *(o[2] for o in met)), max(box[3], *(o[3] for o in met)))
                kept = apart
        kept.append(box)
    return sorted(kept)


def merge_overlapping(boxes: DataFrame, key: str = "image", kind: str = "kind") -> DataFrame:
    """Boxes of one kind on one image that touch become the box around them, until none touch.

    A group has a contract of ``MERGE_LIMIT`` boxes; a larger one is an error, not a cut. Groups are rows of a batch, for
    a frame of its own would cost each more than its merging.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(2)
            flat = held.flatten()
            x, y, w, h = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            corners = list(zip(x.tolist(), y.tolist(), (x + w).tolist(), (y + h).tolist(), strict=True))
            place, out, at = [], [], 0
            for i, n in enumerate(pc.list_value_length(held).to_pylist()):
                if n > MERGE_LIMIT:
                    raise ValueError(f"{n} boxes of one kind on an image")
                found = _merged(corners[at : at + n])
                place += [i] * len(found)
                out += found
                at += n
            a, rows = np.array(out).reshape(-1, 4), pa.array(place, pa.int64())
            columns = (a[:, 0], a[:, 1], a[:, 2] - a[:, 0], a[:, 3] - a[:, 1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *map(pa.array, columns)], [key, kind, *BOX])

    schema = f"{key} {boxes.schema[key].dataType.simpleString()}, {kind} string, x double, y double, w double, h double"
    packed = boxes.groupBy(key, kind).agg(F.collect_list(F.struct(*(F.col(c).cast("double").alias(c) for c in BOX))).alias("b"))
    return packed.mapInArrow(merge, schema)


def merge_gap(boxes: DataFrame, key: str = "image", kind: str = "kind", gap: float = 4.0, most: int = 200) -> DataFrame:
    """``(key, kind, x, y, w, h)``: one pass over the boxes of a kind on an image in the order of (y, x), ties by id: a box
    joins the first kept one within ``gap``, else it is kept.

    An image's contract is its first ``most`` merged boxes, kinds in the order of their first ``box_id``. Boxes without
    a kind or with a place or size that isn't finite are left out.
    """
    sound = F.col(kind).isNotNull()
    for c in BOX:
        sound = sound & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    packed = boxes.where(sound).groupBy(key, kind).agg(F.min("box_id").alias("first"), F.array_sort(F.collect_list(F.struct("y", "x", "box_id", "w", "h"))).alias("b"))
    packed = packed.withColumn("b", F.transform("b", lambda s: F.struct(s["y"].alias("y"), s["x"].alias("x"), s["w"].alias("w"), s["h"].alias("h"))))
    near = lambda s, k: (s["x"] <= k["x"] + k["w"] + gap) & (k["x"] <= s["x"] + s["w"] + gap) & (s["y"] <= k["y"] + k["h"] + gap) & (k["y"] <= s["y"] + s["h"] + gap)

    def around(s: Column, k: Column) -> Column:
        x, y = F.least(s["x"], k["x"]), F.least(s["y"], k["y"])
        return F.struct(y.alias("y"), x.alias("x"), (F.greatest(s["x"] + s["w"], k["x"] + k["w"]) - x).alias("w"), (F.greatest(s["y"] + s["h"], k["y"] + k["h"]) - y).alias("h"))

    def step(acc: Column, s: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda k: near(s, k)), F.lit(True))
        joined = F.transform(acc, lambda k, i: F.when(i + 1 == at, around(s, k)).otherwise(k))
        return F.when(at > 0, joined).otherwise(F.concat(acc, F.array(s)))

    merged = packed.withColumn("m", F.aggregate("b", F.slice("b", 1, 0), step))
    before = F.sum(F.size("m")).over(Window.partitionBy(key).orderBy("first")) - F.size("m")
    kept = merged.withColumn("m", F.slice("m", 1, F.greatest(F.lit(0), F.least(F.size("m"), most - before)).cast("int")))
    return spread(kept, key, kind, items="m", test="x").select(key, kind, *BOX)


def word_in_boxes(words: DataFrame, boxes: DataFrame, key: str = "image", word: str = "word_id", least: float = 0.5) -> DataFrame:
    """``words`` plus ``inside``: whether boxes together cover at least ``least`` of the word's own area."""
    parts = _shared(near_pairs(words.select(key, word, *BOX), boxes.select(key, *BOX), key), key, word)
    area = union_area(parts, key, word)
    out = words.join(area, [key, word], "left")
    return out.withColumn("inside", F.coalesce(F.col("area") / (F.col("w") * F.col("h")) >= least, F.lit(False))).drop("area")


def ratio_to_px(x1: Column, y1: Column, x2: Column, y2: Column, width: float, height: float) -> Column:
    """Corner ratios as a pixel box, null if they aren't finite or stand the wrong way round."""
    sound = [v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) for v in (x1, y1, x2, y2)]
    fine = sound[0] & sound[1] & sound[2] & sound[3] & (x2 > x1) & (y2 > y1)
    px = lambda v, size: F.floor(v * size + 0.5)
    return F.when(fine, F.struct(px(x1, width).alias("x"), px(y1, height).alias("y"), px(x2 - x1, width).alias("w"), px(y2 - y1, height).alias("h")))


def scale_mask(sx: Column, sy: Column) -> Column:
    """The box of x, y, w, h in another scale, grown outward to whole pixels."""
    x, y = F.floor(F.col("x") * sx), F.floor(F.col("y") * sy)
    return F.struct(x.alias("x"), y.alias("y"), (F.ceil((F.col("x") + F.col("w")) * sx) - x).alias("w"), (F.ceil((F.col("y") + F.col("h")) * sy) - y).alias("h"))
