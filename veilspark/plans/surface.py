"""Queries through the SQL and table functions, and joins and sets by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import register as U
from ..functions import spans as S
from ..functions import text as X
from ..operators import detection as D
from ..operators import geometry as E
from ..operators import timeline as L
from .gates import RICH, SHOWN, WIRE, quoted, rich_controls
from .inputs import BOXES, boxes, probed, table
from .registry import query


@query("""SELECT event_id, CASE WHEN regexp_matches(props, '^[0-9]+$') THEN props ELSE repeat('*', least(length(props), 18)) END AS masked, (['reversible', 'navigational', 'state-changing', 'destructive'])[greatest(event_id % 4, 2) + 1] AS tier,
 (['unattended', 'unattended', 'confirm', 'ask'])[event_id % 4 + 1] AS gate FROM events""")
def u1_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    U.register_sql(spark)
    table(spark, sf_dir, "events").createOrReplaceTempView("veil_events")
    tier = "element_at(array('reversible', 'navigational', 'state-changing', 'destructive'), cast(event_id % 4 + 1 AS int))"
    return spark.sql(f"SELECT event_id, veil_mask(props) AS masked, veil_stricter_tier('state-changing', {tier}) AS tier, veil_gate(true, {tier}) AS gate FROM veil_events")


@query(f"""WITH {RICH} SELECT page_id, ord, {WIRE} AS tier, regexp_matches({SHOWN('label')}, {quoted(P.DESTRUCTIVE_INTENT)}) AS intent, type IN ('password', 'email', 'tel') OR regexp_matches(label, {quoted(P.PII_LABEL)}) OR regexp_matches(type, {quoted(P.PII_LABEL)}) AS pii,
 round(greatest(0, 50.0 - ord) / (50.0 + ord), 6) AS iou FROM rich WHERE label <> ''""")
def u1_sql_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and boxes as SQL functions, on controls."""
    U.register_sql(spark)
    rich_controls(spark, sf_dir).where("label <> ''").createOrReplaceTempView("veil_controls")
    return spark.sql("""SELECT page_id, ord, veil_click_tier_wire(label, type) AS tier, veil_destructive_intent(label) AS intent, veil_element_pii(type, label) AS pii,
        round(veil_iou(0.0D, 0.0D, 50.0D, 10.0D, cast(ord AS DOUBLE), 0.0D, 50.0D, 10.0D), 6) AS iou FROM veil_controls""")


@query(f"""WITH {BOXES}, c AS (SELECT box_id, x, y, w, h, greatest(0.0, floor(x * 1.01 - 2)) AS cx, least(800.0, ceil(x * 1.01 + w + 2)) AS r, greatest(0.0, floor(y - 2)) AS cy, least(600.0, ceil(y + h + 2)) AS b FROM boxes)
SELECT box_id, CASE WHEN r > cx AND b > cy THEN r - cx END AS clipped_w, CAST(ceil((x + w) * 1.5) - floor(x * 1.5) AS BIGINT) AS scaled_w, CASE WHEN w > 0 AND h > 0 THEN CAST(floor(x / 1000 * 640 + 0.5) AS BIGINT) END AS px_x FROM c""")
def u1_sql_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes clipped, scaled and put in pixels by SQL functions."""
    U.register_sql(spark)
    boxes(spark, sf_dir).createOrReplaceTempView("veil_boxes")
    return spark.sql("""SELECT box_id, veil_clip_rect(x * 1.01D, y, w, h, 800D, 600D, 2D).w AS clipped_w, veil_scale_mask(x, y, w, h, 1.5D, 1.25D).w AS scaled_w,
        veil_ratio_to_px(x / 1000, y / 1000, (x + w) / 1000, (y + h) / 1000, 640D, 480D).x AS px_x FROM veil_boxes""")


@query("""WITH e AS (SELECT event_id, (['accept', 'ask', 'reject', 'maybe'])[event_id % 4 + 1] AS verdict, (['destructive', 'navigational', 'odd'])[event_id % 3 + 1] AS remote, (['navigational', 'state-changing', 'destructive', 'none', 'reversible'])[event_id % 5 + 1] AS local FROM events),
f AS (SELECT *, CASE WHEN remote = 'odd' THEN local WHEN 'destructive' IN (remote, local) THEN 'destructive' WHEN local = 'state-changing' THEN local ELSE 'navigational' END AS final FROM e)
SELECT event_id, CASE WHEN local = 'none' OR verdict = 'reject' THEN 'reject' WHEN verdict = 'ask' THEN 'ask' WHEN verdict <> 'accept' OR remote = 'odd' OR remote <> local OR final NOT IN ('navigational', 'reversible') THEN 'confirm' ELSE 'unattended' END AS path,
 CASE WHEN local = 'none' THEN NULL WHEN verdict = 'reject' THEN local ELSE final END AS final_tier FROM f""")
def u1_sql_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided gates by a SQL function."""
    U.register_sql(spark)
    table(spark, sf_dir, "events").createOrReplaceTempView("veil_events")
    pick = lambda *names: f"element_at(array({', '.join(map(repr, names))}), cast(event_id % {len(names)} + 1 AS int))"
    gate = f"veil_gate_dual({pick('accept', 'ask', 'reject', 'maybe')}, {pick('destructive', 'navigational', 'odd')}, {pick('navigational', 'state-changing', 'destructive', 'none', 'reversible')})"
    return spark.sql(f"SELECT event_id, g.path, g.final_tier FROM (SELECT event_id, {gate} AS g FROM veil_events)")


@query("SELECT conv_id, turn, md5(nfc_normalize(text || chr(101) || chr(769))) AS digest FROM conversations")
def u2_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with a letter and a combining accent after them, composed."""
    text = X.composed(F.concat("text", F.lit("é")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text).alias("digest"))


@query()
def u2_nfkc_casefold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(X.nfkc_casefold(F.col("text"))).alias("digest"))


@query(f"""WITH RECURSIVE {BOXES}, m(step, image, kind, n, rects) AS (
 SELECT 0, image, kind, count(*), list({{'x': x, 'y': y, 'r': x + w, 'b': y + h}}) FROM boxes GROUP BY image, kind
 UNION ALL SELECT step + 1, image, kind, n, list_distinct(list_transform(rects, lambda a: {{'x': list_min(list_transform(list_filter(rects, lambda o: a.x <= o.r AND o.x <= a.r AND a.y <= o.b AND o.y <= a.b), lambda o: o.x)),
   'y': list_min(list_transform(list_filter(rects, lambda o: a.x <= o.r AND o.x <= a.r AND a.y <= o.b AND o.y <= a.b), lambda o: o.y)), 'r': list_max(list_transform(list_filter(rects, lambda o: a.x <= o.r AND o.x <= a.r AND a.y <= o.b AND o.y <= a.b), lambda o: o.r)),
   'b': list_max(list_transform(list_filter(rects, lambda o: a.x <= o.r AND o.x <= a.r AND a.y <= o.b AND o.y <= a.b), lambda o: o.b))}})) FROM m WHERE step < 40)
SELECT image, kind, CAST(len(rects) AS BIGINT) AS merged, round(list_sum(list_transform(rects, lambda a: (a.r - a.x) * (a.b - a.y))), 4) AS area FROM m WHERE step = 40""")
def u3_merge_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = E.merge_overlapping(boxes(spark, sf_dir))
    return merged.groupBy("image", "kind").agg(F.count("*").alias("merged"), F.round(F.sum(F.col("w") * F.col("h")), 4).alias("area"))


@query()
def u4_pii_spans_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    U.register_udtf(spark)
    probed(spark, sf_dir).createOrReplaceTempView("veil_probed")
    return spark.sql("SELECT kind, count(*) AS n FROM veil_probed, LATERAL veil_pii_spans(text) GROUP BY kind")


@query()
def u6_pattern_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passes, read back from a table of patterns, on whole documents."""
    passes = U.patterns_from(U.pattern_table(spark))
    spans = S.claimed(F.col("c"))
    docs = probed(spark, sf_dir).withColumn("c", S.candidates(F.col("text"), passes))
    return S.spread(docs.withColumn("spans", spans), "lang", items="spans").groupBy("lang", "kind").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS orders, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey")
def j1_group_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), last.alias("last_order"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j2_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("""WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), b AS (SELECT event_id AS seen, user_id, ts FROM events WHERE event_type = 'view')
SELECT a.event_id, arg_max(b.seen, (b.ts, b.seen)) AS seen FROM a LEFT JOIN b ON a.user_id = b.user_id AND b.ts <= a.ts GROUP BY a.event_id""")
def j3_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with its user's latest view."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("seen"))
    return L.as_of(e.where("event_type = 'click'"), views, ["user_id"], "ts", "seen").select("event_id", "seen")


@query("SELECT n_name, date_trunc('month', o_orderdate) AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def j4_star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return rows.groupBy("n_name", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
