"""Distinct counts and quantiles by sketches that merge: kept for small windows, and merged upwards without a row read again.

HyperLogLog sketches count with a relative standard error of about 1.04 / sqrt(2 ** ``LG_K``), 1.6 %; KLL sketches of size
``K`` give a value whose rank is off by less than ``RANK_ERROR``. A sketch's size doesn't grow with its rows but for KLL's
logarithm. KLL sketches draw at random, so that quantiles differ within their error from run to run. Nulls and NaN count in
``n`` only; a group without any value has a distinct count of zero and null quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K, K, RANK_ERROR = 12, 800, 0.005


def sketches(member: Column, value: Column) -> list[Column]:
    """Aggregates ``n``, ``members`` and ``amounts`` of a batch or a stream."""
    value = value.cast("double")
    some = F.when(~F.isnan(value), value)
    return [F.count("*").alias("n"), F.count(some).alias("n_values"), F.hll_sketch_agg(member, LG_K).alias("members"), F.kll_sketch_agg_double(some, K).alias("amounts")]


def merged(held: DataFrame, *by: Column | str) -> DataFrame:
    """Sketches of coarser groups out of those of finer ones."""
    full = F.when(F.col("n_values") > 0, F.col("amounts"))
    return held.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("n_values").alias("n_values"), F.hll_union_agg("members").alias("members"), F.kll_merge_agg_double(full, K).alias("amounts"))


def rollup(held: DataFrame, start: str, by: Sequence[str], levels: Sequence[str]) -> DataFrame:
    """``(level, start, *by, ..)``: ``held`` as level ``""`` and what it merges to in each of ``levels`` (``hour``, ``day``,
    ``month``, .., each made of whole ones before it) and in ``all``, whose ``start`` is null."""
    out, last = held.withColumn("level", F.lit("")), held
    for level in levels:
        last = merged(last, F.date_trunc(level, start).alias(start), *by)
        out = out.unionByName(last.withColumn("level", F.lit(level)))
    last = merged(last, *by).withColumn("level", F.lit("all")).withColumn(start, F.lit(None).cast("timestamp"))
    return out.unionByName(last)


def distinct_estimate(members: str = "members") -> Column:
    return F.coalesce(F.hll_sketch_estimate(members), F.lit(0).cast("long"))


def quantile(share: float, amounts: str = "amounts") -> Column:
    return F.when(F.col("n_values") > 0, F.kll_sketch_get_quantile_double(amounts, F.lit(share)))
