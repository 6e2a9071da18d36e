"""Rows in the order of time within groups, without a task that sees a whole group.

A table is dealt out by sampled ranges of (group, order), so a hot group is as many ranges as it needs. Windows then stay
within one range, and what a range must know of its neighbours is an *edge*: a few values of the one group that it has in
common with them. There is an edge for each range at most, so edges are broadcast, and are as many as the ranges, not the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .numbering import dealt


def ranged(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` plus ``_at``, its row's place in the order of ``by`` and ``order``, and ``_part``, its range."""
    return written(dealt(df, [*by, *order]), "ranged").withColumn("_part", F.shiftright("_at", 33))


def within(by: Sequence[str]) -> Window:
    """The rows of one group in one range, in order."""
    return Window.partitionBy("_part", *by).orderBy("_at")


def _same(left: DataFrame, right: DataFrame, names: Sequence[str], how: str) -> DataFrame:
    """An equi-join in which nulls are equal, with ``right`` (bounded by the number of ranges) broadcast."""
    for k in names:
        right = right.withColumnRenamed(k, f"_r_{k}")
    on = reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[f"_r_{k}"]) for k in names))
    return left.join(F.broadcast(right), on, how).drop(*(f"_r_{k}" for k in names))


def with_edges(held: DataFrame, by: Sequence[str], value: Column, n: int = 1, ahead: bool = False) -> DataFrame:
    """``held`` plus ``_edge``: the nearest ``n`` non-null values that the row's group has before the row's range, in order.

    With ``ahead``, after it, from the furthest to the nearest. Null where the group has none there.
    """
    step = -F.col("_at") if ahead else F.col("_at")
    edges = _last_values(held, by, step, value) if n == 1 else _last_rows(held, by, step, value, n)
    return _same(held, edges, [*by, "_part"], "left")


def _last_values(held: DataFrame, by: Sequence[str], step: Column, value: Column) -> DataFrame:
    runs = held.groupBy(*by, "_part").agg(F.min(step).alias("_step"), F.max_by(value, F.when(value.isNotNull(), step)).alias("_own"))
    before = Window.partitionBy(*by).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a group
    return runs.withColumn("_edge", F.last("_own", ignorenulls=True).over(before)).where("_edge IS NOT NULL").select(*by, "_part", F.array("_edge").alias("_edge"))


def _last_rows(held: DataFrame, by: Sequence[str], step: Column, value: Column, n: int) -> DataFrame:
    cut = held.groupBy(*by).agg(F.min("_part").alias("_a"), F.max("_part").alias("_b")).where("_a < _b").select(*by)
    rows = _same(held.select(*by, "_part", step.alias("_step"), value.alias("_value")), cut, by, "left_semi")
    # the last rows of each range, of which no more than n leave a task
    last = F.row_number().over(Window.partitionBy("_part", *by).orderBy(F.col("_step").desc()))
    near = rows.where("_value IS NOT NULL").withColumn("_r", last).where(F.col("_r") <= n).drop("_r")
    seen = F.collect_list("_value").over(Window.partitionBy(*by).orderBy("_step").rowsBetween(1 - n, 0))
    near = near.select(*by, "_part", "_step", seen.alias("_seen"), F.lit(False).alias("_first"))
    first = rows.groupBy(*by, "_part").agg(F.min("_step").alias("_step")).withColumn("_first", F.lit(True))
    before = Window.partitionBy(*by).orderBy("_step", F.col("_first").desc()).rowsBetween(Window.unboundedPreceding, -1)
    met = near.unionByName(first, allowMissingColumns=True).withColumn("_edge", F.last("_seen", ignorenulls=True).over(before))
    return met.where("_first AND _edge IS NOT NULL").select(*by, "_part", "_edge")


def carried(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """``df`` plus ``out``: the last non-null ``value`` of the row's group up to the row, which counts."""
    held = with_edges(ranged(df, by, order), by, F.col(value))
    own = F.last(value, ignorenulls=True).over(within(by).rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn(out, F.coalesce(own, F.get("_edge", F.lit(0)))).select(*df.columns, out)


def recent(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, n: int, out: str) -> DataFrame:
    """``df`` plus ``out``: the values of the group's last ``n`` rows up to the row, which counts, in order; nulls go."""
    held = with_edges(ranged(df, by, order), by, F.struct(F.col(value).alias("v")), max(n - 1, 1))
    own = F.collect_list(F.struct(F.col(value).alias("v"))).over(within(by).rowsBetween(1 - n, 0))
    got = F.concat(F.coalesce("_edge", F.slice(own, 1, 0)), own)
    got = F.slice(got, F.greatest(F.size(got) - n + 1, F.lit(1)), n)
    return held.withColumn(out, F.array_compact(F.transform(got, lambda x: x["v"]))).select(*df.columns, out)


def following(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], out: str) -> DataFrame:
    """``df`` plus ``out``: a struct of ``columns`` of the group's next row, null at its end."""
    row = F.struct(*columns)
    held = with_edges(ranged(df, by, order), by, row, ahead=True)
    return held.withColumn(out, F.coalesce(F.lead(row).over(within(by)), F.get("_edge", F.lit(0)))).select(*df.columns, out)


def as_of(asks: DataFrame, facts: DataFrame, by: Sequence[str], time: str, value: str, within_s: float | None = None) -> DataFrame:
    """``asks`` plus ``value``: that of the group's latest of ``facts`` ``(*by, time, value)`` at or before the ask's time.

    Of facts at one instant the greatest value counts. No pairs are made. An ask without a group or time, without an
    earlier fact, or with ``within_s`` without one so recent, gets null. Facts without a group, time or value don't count.
    """
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in (*by, time, value)))
    fact = F.struct(F.col(time).alias("t"), F.col(value).alias("v"))
    said = facts.where(known).select(*by, F.col(time).alias("_time"), fact.alias("_fact"))
    asked = asks.select(*by, F.col(time).alias("_time"), F.struct(*asks.columns).alias("_ask"))
    both = said.unionByName(asked, allowMissingColumns=True).withColumn("_asks", F.col("_ask").isNotNull()).withColumn("_tie", F.xxhash64("_ask"))
    got = carried(both, by, ["_time", "_asks", "_fact", "_tie"], "_fact", "_last").where("_asks")
    last = F.col("_last")
    if within_s is not None:
        last = F.when(F.unix_micros("_time") - F.unix_micros(last["t"]) <= within_s * 1e6, last)
    return got.select("_ask.*", last["v"].alias(value))
