"""Queries of geometry, over line items as boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry as E
from .inputs import BOXES, boxes
from .registry import query


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = boxes(spark, sf_dir)
    return b.where("side = 'pred'"), b.where("side = 'truth'")


@query(f"""WITH {BOXES}, c AS (SELECT box_id, greatest(0.0, floor(x * 1.01 - 2)) AS x, greatest(0.0, floor(y - 2)) AS y, least(800.0, ceil(x * 1.01 + w + 2)) AS r, least(600.0, ceil(y + h + 2)) AS b FROM boxes)
SELECT box_id, CASE WHEN r > x AND b > y THEN x END AS x, CASE WHEN r > x AND b > y THEN r - x END AS w FROM c""")
def e1_clip_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).withColumn("x", F.col("x") * 1.01)
    return b.select("box_id", E.clip_rect(F.lit(800), F.lit(600), 2.0).alias("r")).select("box_id", "r.x", "r.w")


_PAIRS = "FROM boxes a JOIN boxes b ON a.image = b.image AND a.side = 'pred' AND b.side = 'truth'"
_INTER = "greatest(0.0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0.0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


@query(f"WITH {BOXES} SELECT image, count(*) AS pairs, round(sum(i / (a_ + b_ - i)), 6) AS total FROM (SELECT a.image, {_INTER} AS i, a.w * a.h AS a_, b.w * b.h AS b_ {_PAIRS}) GROUP BY image")
def e2_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred, truth = _sides(spark, sf_dir)
    other = truth.select("image", *(F.col(c).alias(f"{c}2") for c in E.BOX))
    score = E.iou(F.col, lambda k: F.col(f"{k}2"))
    return pred.join(other, "image").groupBy("image").agg(F.count("*").alias("pairs"), F.round(F.sum(score), 6).alias("total"))


_AREA = """e AS (SELECT DISTINCT image, unnest([x, x + w]) AS l FROM {0}), sl AS (SELECT image, l, lead(l) OVER (PARTITION BY image ORDER BY l) AS r FROM e),
i AS (SELECT s.image, l, r, y, h FROM sl s JOIN {0} b ON s.image = b.image AND r IS NOT NULL AND b.x < r AND b.x + b.w > l),
p AS (SELECT image, (r - l) * greatest(0.0, y + h - greatest(y, coalesce(max(y + h) OVER (PARTITION BY image, l ORDER BY y, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), y))) AS part FROM i)"""


@query(f"WITH {BOXES}, {_AREA.format('boxes')} SELECT image, round(sum(part), 4) AS area FROM p GROUP BY image")
def e3_union_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.union_area(boxes(spark, sf_dir), "image").withColumn("area", F.round("area", 4))


@query()
def e4_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.nms(boxes(spark, sf_dir), overlap=0.1)


@query()
def e5_greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.greedy_match(*_sides(spark, sf_dir), least=0.05)


@query()
def e6_greedy_match_input_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.greedy_match(*_sides(spark, sf_dir), least=0.05, by="input")


@query()
def e7_merge_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.merge_overlapping(boxes(spark, sf_dir))


@query()
def e8_merge_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.merge_gap(boxes(spark, sf_dir))


def _images(b: DataFrame) -> DataFrame:
    return b.select("image").distinct().withColumns({"width": F.lit(1200.0), "height": F.lit(1000.0)})


def _area_sql(name: str, rows: str) -> str:
    return _AREA.format(rows).replace("e AS (", f"e_{name} AS (", 1).replace("FROM e)", f"FROM e_{name})").replace("sl AS (", f"sl_{name} AS (", 1).replace("FROM sl s", f"FROM sl_{name} s").replace("\ni AS (", f"\ni_{name} AS (", 1).replace("\np AS (", f"\np_{name} AS (", 1).replace("FROM i)", f"FROM i_{name})")


_COVER = f"""{BOXES}, tr AS (SELECT * FROM boxes WHERE side = 'truth'), pr AS (SELECT * FROM boxes WHERE side = 'pred'),
sh AS (SELECT a.image, greatest(a.x, b.x) AS x, greatest(a.y, b.y) AS y, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS w, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS h FROM tr a JOIN pr b ON a.image = b.image
  WHERE least(a.x + a.w, b.x + b.w) > greatest(a.x, b.x) AND least(a.y + a.h, b.y + b.h) > greatest(a.y, b.y)),
{_area_sql('t', 'tr')}, {_area_sql('m', 'pr')}, {_area_sql('s', 'sh')},
cov AS (SELECT image, coalesce(t, 0) AS t, coalesce(m, 0) AS m, coalesce(s, 0) AS s FROM (SELECT DISTINCT image FROM boxes) LEFT JOIN (SELECT image, sum(part) AS t FROM p_t GROUP BY 1) USING (image)
 LEFT JOIN (SELECT image, sum(part) AS m FROM p_m GROUP BY 1) USING (image) LEFT JOIN (SELECT image, sum(part) AS s FROM p_s GROUP BY 1) USING (image))"""


@query(f"WITH {_COVER} SELECT image, round(CASE WHEN t > 0 THEN s / t END, 6) AS covered, round((1200000 - t - m + s) / (1200000 - t), 6) AS preserved FROM cov")
def e9_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred, truth = _sides(spark, sf_dir)
    out = E.coverage(truth, pred, _images(boxes(spark, sf_dir)))
    return out.select("image", F.round("covered", 6).alias("covered"), F.round("preserved", 6).alias("preserved"))


@query()
def e10_word_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred, truth = _sides(spark, sf_dir)
    return E.word_in_boxes(truth.withColumnRenamed("box_id", "word_id"), pred, least=0.2).select("image", "word_id", "inside")


@query(f"WITH {BOXES} SELECT box_id, CASE WHEN box_id % 10 <> 3 THEN CAST(floor(x / 1000 * 640 + 0.5) AS BIGINT) END AS x, CASE WHEN box_id % 10 <> 3 THEN CAST(floor(w / 1000 * 640 + 0.5) AS BIGINT) END AS w FROM boxes")
def e11_ratio_to_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners as shares of 1000; every tenth stands the wrong way round."""
    turned = F.col("box_id") % 10 == 3
    left, right = F.col("x") / 1000, F.col("x") / 1000 + F.col("w") / 1000
    px = E.ratio_to_px(F.when(turned, right).otherwise(left), F.col("y") / 1000, F.when(turned, left).otherwise(right), (F.col("y") + F.col("h")) / 1000, 640.0, 480.0)
    b = boxes(spark, sf_dir).select("box_id", px.alias("p"))
    return b.select("box_id", F.col("p.x").cast("long").alias("x"), F.col("p.w").cast("long").alias("w"))


@query(f"WITH {BOXES} SELECT box_id, CAST(floor(x * 1.5) AS BIGINT) AS x, CAST(ceil((x + w) * 1.5) - floor(x * 1.5) AS BIGINT) AS w, CAST(ceil((y + h) * 1.25) - floor(y * 1.25) AS BIGINT) AS h FROM boxes")
def e12_scale_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).select("box_id", E.scale_mask(F.lit(1.5), F.lit(1.25)).alias("m"))
    return b.select("box_id", *(F.col(f"m.{c}").cast("long").alias(c) for c in "xwh"))


@query(f"WITH {_COVER} SELECT round(sum(s) / sum(t), 6) AS covered, count(*) AS images FROM cov")
def f7_raster_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred, truth = _sides(spark, sf_dir)
    out = E.coverage(truth, pred, _images(boxes(spark, sf_dir)))
    return out.agg(F.round(F.sum("shared_area") / F.sum("truth_area"), 6).alias("covered"), F.count("*").alias("images"))


@query()
def f7_raster_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches and areas per image, and over all as a total with a null image."""
    pred, truth = _sides(spark, sf_dir)
    per = E.greedy_match(pred, truth, least=0.05).join(E.coverage(truth, pred, _images(boxes(spark, sf_dir))), "image")
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "truth_area", "mask_area", "shared_area")]
    return per.rollup("image").agg(*sums).withColumn("covered", F.when(F.col("truth_area") > 0, F.col("shared_area") / F.col("truth_area")))


