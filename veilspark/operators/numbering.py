"""Places within groups, without a task that sees a whole group in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def dealt(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` plus ``_at``, which grows in the order of all of ``order``.

    Rows are dealt out by ranges whose limits Spark takes from a sample of whole rows of ``order``: many rows of one group,
    or with the same first key, are as many ranges as they need.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())


def numbered(df: DataFrame, by: Sequence[str], first: str, then: Sequence[str]) -> DataFrame:
    """``df`` plus ``_place`` (from zero) and ``_size`` of its group, in the order of ``first`` and ``then``.

    A row's place is that in its range, and what a group has in the ranges before, of which there are few. ``by`` must not
    be null.
    """
    held = written(dealt(df, [*by, first, *then]), "numbered").withColumn("_part", F.shiftright("_at", 33))
    runs = held.groupBy(*by, "_part").agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    group = Window.partitionBy(*by)  # one row for each range that a group is in
    runs = runs.select(*by, "_part", "_from", (F.sum("_n").over(group.orderBy("_part")) - F.col("_n")).alias("_begin"), F.sum("_n").over(group).alias("_size"))
    return held.join(runs, [*by, "_part"]).withColumn("_place", F.col("_begin") + F.col("_at") - F.col("_from")).drop("_part", "_at", "_from", "_begin")
