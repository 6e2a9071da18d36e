"""Merging boxes of many small groups costs little more than of few larger ones."""

import time

from pyspark.sql import functions as F

from veilspark.operators import geometry as E


def test_groups_cost_no_frame_each(spark):
    boxes = spark.range(0, 60_000, 1, 8).select("id", F.lit("face").alias("kind"), (F.col("id") % 30 * 40.0).alias("x"), (F.col("id") % 7 * 50.0).alias("y"), F.lit(9.0).alias("w"), F.lit(8.0).alias("h"))

    def seconds(images):
        start = time.time()
        n = E.merge_overlapping(boxes.withColumn("image", F.col("id") % images)).count()
        return time.time() - start, n

    seconds(1_000)
    (few, _), (many, n) = seconds(1_000), seconds(30_000)
    assert n >= 30_000 and many < 4 * few + 2


def test_boxes_that_meet_by_growing(spark):
    rows = [(1, "a", 0.0, 0.0, 2.0, 2.0), (1, "a", 4.0, 4.0, 2.0, 2.0), (1, "a", 2.0, 0.0, 2.0, 4.0), (1, "b", 1.0, 1.0, 1.0, 1.0), (2, None, 1.0, 1.0, 1.0, 1.0), (3, "a", None, 0.0, 1.0, 1.0)]
    got = E.merge_overlapping(spark.createDataFrame(rows, "image int, kind string, x double, y double, w double, h double")).collect()
    assert sorted(map(str, (tuple(r) for r in got if r.image != 3))) == ["(1, 'a', 0.0, 0.0, 6.0, 6.0)", "(1, 'b', 1.0, 1.0, 1.0, 1.0)", "(2, None, 1.0, 1.0, 1.0, 1.0)"]
    assert len([r for r in got if r.image == 3]) == 1
