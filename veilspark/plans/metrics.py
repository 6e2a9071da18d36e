"""Queries of evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import spans as S
from ..operators import detection as D
from ..operators import gates as G
from ..operators import metrics as M
from .inputs import ATTEMPTS, BOXES, PREDICTIONS, STAGES, attempts, boxes, predictions, probed, table
from .registry import query

CLASSES = ("navigational", "state-changing", "destructive")


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with claimed spans as truth and labelled ones as predictions."""
    docs = D.sensitive_spans(D.document_spans(probed(spark, sf_dir)).withColumnRenamed("spans", "truth"), out="pred")
    return docs.select("doc_id", "lang", F.length("text").alias("chars"), "truth", "pred")


@query()
def f1_char_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.char_coverage(_cases(spark, sf_dir), "chars")
    return out.select("doc_id", "pii_chars", "covered_chars", "kept_chars", F.round("coverage", 6).alias("coverage"), F.round("preservation", 6).alias("preservation"))


@query()
def f2_span_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.span_prf(_cases(spark, sf_dir)).select("doc_id", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query()
def f3_macro_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = M.char_coverage(M.span_prf(_cases(spark, sf_dir)), "chars")
    return M.macro_means(cases, ("coverage", "preservation", "precision", "recall"), F.size("truth") > 0)


ANNOTATED = f"{BOXES}, an AS (SELECT image, kind AS key, CASE WHEN box_id % 13 = 0 THEN '?!' ELSE 'Value ' || (box_id % 17) END AS value, x, y, CASE WHEN box_id % 11 = 0 THEN 0 ELSE w END AS w, h, box_id % 7 <> 0 AS visible FROM boxes)"


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("box_id")
    value = F.when(i % 13 == 0, "?!").otherwise(F.concat(F.lit("Value "), (i % 17).cast("string")))
    return boxes(spark, sf_dir).select(F.col("image").alias("sample"), F.col("kind").alias("key"), value.alias("value"), "x", "y", F.when(i % 11 == 0, 0.0).otherwise(F.col("w")).alias("w"), "h", (i % 7 != 0).alias("visible"))


@query(f"WITH {ANNOTATED} SELECT image AS sample, key, lower(value) AS norm, CAST(count(DISTINCT (x, y, w, h)) AS INTEGER) AS boxes FROM an WHERE visible AND value <> '?!' AND w > 0 GROUP BY ALL")
def f4_group_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.group_annotations(_annotated(spark, sf_dir))[0]


@query(f"WITH {ANNOTATED} SELECT CASE WHEN NOT visible THEN 'not-visible' WHEN value = '?!' THEN 'no-text' ELSE 'no-area' END AS reason, count(*) AS count FROM an WHERE NOT (visible AND value <> '?!' AND w > 0) GROUP BY reason")
def f4_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.group_annotations(_annotated(spark, sf_dir))[1]


_TOKENS = "unnest(list_filter(string_split(lower(text), ' '), lambda x: x <> ''))"


@query(f"""WITH e AS (SELECT item_id % 20 AS g, {_TOKENS} AS token FROM benchmark), a AS (SELECT doc_id % 20 AS g, {_TOKENS} AS token FROM documents),
ec AS (SELECT g, token, count(*) AS e FROM e GROUP BY ALL), ac AS (SELECT g, token, count(*) AS a FROM a GROUP BY ALL)
SELECT g, CAST(sum(e) AS BIGINT) AS expected, CAST(sum(least(e, coalesce(a, 0))) AS BIGINT) AS matched FROM ec LEFT JOIN ac USING (g, token) GROUP BY g""")
def f5_token_multiset_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words as expected, documents' words as found, in twenty groups."""
    words = lambda name, key: table(spark, sf_dir, name).select((F.col(key) % 20).alias("g"), F.explode(F.filter(F.split(F.lower("text"), " "), lambda x: x != "")).alias("token"))
    return M.token_multiset_match(words("benchmark", "item_id"), words("documents", "doc_id"), ["g"])


OBSERVED = "s AS (SELECT doc_id AS sample, n_chars AS expected FROM documents), o AS (SELECT doc_id AS sample, doc_id % 6 <> 0 AS ok, n_chars * quality // 2 AS recognized, n_chars * toxic // 3 AS marked FROM documents JOIN labels USING (doc_id))"


@query(f"""WITH {OBSERVED}, j AS (SELECT expected, coalesce(ok, false) AS ok, coalesce(recognized, 0) AS r, coalesce(marked, 0) AS m FROM s LEFT JOIN o USING (sample))
SELECT count(*) AS samples, count(*) FILTER (WHERE NOT ok) AS failed, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(CASE WHEN ok THEN r ELSE 0 END) AS BIGINT) AS recognized, CAST(sum(CASE WHEN ok THEN m ELSE 0 END) AS BIGINT) AS marked,
 round(sum(CASE WHEN ok THEN r ELSE 0 END) / sum(expected), 6) AS recovery, round(sum(CASE WHEN ok THEN m ELSE 0 END) / sum(expected), 6) AS protection FROM j""")
def f6_recovery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as samples, labelled ones as observed, some of them failed."""
    docs = table(spark, sf_dir, "documents")
    seen = docs.join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("sample"), (F.col("doc_id") % 6 != 0).alias("ok"), F.expr("n_chars * quality div 2").alias("recognized"), F.expr("n_chars * toxic div 3").alias("marked"))
    out = M.recovery_report(docs.select(F.col("doc_id").alias("sample"), F.col("n_chars").alias("expected")), seen)
    return out.withColumn("recovery", F.round("recovery", 6)).withColumn("protection", F.round("protection", 6))


@query("""WITH o AS (SELECT doc_id AS sample, n_chars + CASE WHEN doc_id % 8 = 1 THEN 1 ELSE 0 END AS size FROM documents UNION ALL SELECT doc_id + CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 100000000 END, n_chars FROM documents WHERE doc_id % 10 < 2),
n AS (SELECT *, count(*) OVER (PARTITION BY sample) AS n FROM o)
SELECT CASE WHEN n > 1 THEN 'duplicate' WHEN d.doc_id IS NULL THEN 'unknown' WHEN size <> d.n_chars THEN 'size-differs' END AS reason, count(*) AS count FROM n LEFT JOIN documents d ON d.doc_id = sample GROUP BY reason""")
def f8_validate_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    d = F.col("doc_id")
    first = docs.select(d.alias("sample"), (F.col("n_chars") + F.when(d % 8 == 1, 1).otherwise(0)).alias("size"))
    more = docs.where(d % 10 < 2).select((d + F.when(d % 2 == 0, 0).otherwise(100000000)).alias("sample"), F.col("n_chars").alias("size"))
    contract = docs.select(d.alias("sample"), F.col("n_chars").alias("size"))
    return M.validate_observations(first.unionByName(more), contract, check=["size"]).groupBy("reason").count()


def _classes_sql(by: str = "") -> str:
    parts = ["count(*) AS n", "round(count(*) FILTER (WHERE gold = said) / count(*), 4) AS accuracy"]
    for c in CLASSES:
        hit, name = f"count(*) FILTER (WHERE gold = '{c}' AND said = '{c}')", c.replace("-", "_")
        parts += [f"round({hit} / nullif(count(*) FILTER (WHERE said = '{c}'), 0), 4) AS {name}_precision", f"round({hit} / nullif(count(*) FILTER (WHERE gold = '{c}'), 0), 4) AS {name}_recall"]
    return by + ", ".join(parts)


@query(f"WITH {PREDICTIONS} SELECT {_classes_sql()} FROM predictions")
def f9_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    return p.agg(*M.class_metrics(p, CLASSES))


@query(f"WITH {PREDICTIONS} SELECT {_classes_sql('lang, unseen, ')} FROM predictions GROUP BY GROUPING SETS ((), (lang), (unseen))")
def f10_sliced_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    return p.groupingSets([[], [F.col("lang")], [F.col("unseen")]], "lang", "unseen").agg(*M.class_metrics(p, CLASSES))


@query(f"""WITH {PREDICTIONS}, b AS (SELECT CASE {' '.join(f'WHEN confidence <= {b / 10} THEN {b}' for b in range(1, 11))} END AS bin, count(*) AS n, sum(confidence) AS p, sum((gold = said)::INT) AS c FROM predictions GROUP BY bin)
SELECT round(sum(abs(p - c)) / sum(n), 4) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b""")
def f11_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ece(predictions(spark, sf_dir).withColumn("right", F.col("gold") == F.col("said")), "confidence", "right")


@query(f"""WITH {PREDICTIONS}, c AS (SELECT p_off AS s, count(*) FILTER (WHERE toxic = 1) AS pos, count(*) FILTER (WHERE toxic <> 1) AS neg FROM predictions GROUP BY s),
w AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2 AS below FROM c)
SELECT round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * below) / (sum(pos) * sum(neg)) END, 4) AS auroc, CAST(sum(pos) AS BIGINT) AS pos, CAST(sum(neg) AS BIGINT) AS neg FROM w""")
def f12_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.auroc(predictions(spark, sf_dir).withColumn("off", F.col("toxic") == 1), "p_off", "off")


THRESHOLDS = (0.5, 0.6, 0.7, 0.8, 0.9, 0.99)
_USED = "confidence >= threshold AND NOT free_p >= 0.5"


def _sweep_sql(by: str = "", ts: tuple = THRESHOLDS) -> str:
    return f"""WITH {PREDICTIONS}, t AS (SELECT *, gold = said AS correct, quality AS fallback, unnest({list(ts)}::DOUBLE[]) AS threshold FROM predictions)
SELECT {by} threshold, count(*) AS n, count(*) FILTER (WHERE {_USED}) AS acted, count(*) FILTER (WHERE {_USED} AND NOT correct) AS wrong, count(*) FILTER (WHERE {_USED} AND free_text) AS acted_on_free_text,
 round(count(*) FILTER (WHERE {_USED} AND correct) / nullif(count(*) FILTER (WHERE {_USED}), 0), 4) AS precision, round(count(*) FILTER (WHERE {_USED}) / count(*), 4) AS coverage,
 round(avg(CASE WHEN {_USED} THEN correct::INT ELSE fallback END), 3) AS hybrid_accuracy, round(avg(fallback), 3) AS fallback_accuracy FROM t GROUP BY {by} threshold"""


def _sweepable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).withColumns({"correct": F.col("gold") == F.col("said"), "fallback": F.col("quality").cast("double")})


@query(_sweep_sql())
def f13_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.threshold_sweep(_sweepable(spark, sf_dir), THRESHOLDS)


@query(_sweep_sql("source,", (0.9,)))
def f14_validation_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By family, at the gate's own threshold."""
    return M.threshold_sweep(_sweepable(spark, sf_dir), (0.9,), "source")


@query(f"""WITH {PREDICTIONS}, r AS (SELECT gold = 'destructive' AS bad, regex_tier = 'destructive' AS rule, regex_tier = 'destructive' OR p_destr >= 0.5 AS asks FROM predictions)
SELECT round(count(*) FILTER (WHERE rule AND bad) / nullif(count(*) FILTER (WHERE bad), 0), 4) AS rule_caught, round(count(*) FILTER (WHERE asks AND bad) / nullif(count(*) FILTER (WHERE bad), 0), 4) AS both_caught,
 round(count(*) FILTER (WHERE rule AND NOT bad) / nullif(count(*) FILTER (WHERE NOT bad), 0), 4) AS rule_extra, round(count(*) FILTER (WHERE asks AND NOT bad) / nullif(count(*) FILTER (WHERE NOT bad), 0), 4) AS both_extra,
 count(*) FILTER (WHERE bad) AS destructive, count(*) FILTER (WHERE NOT bad) AS other FROM r""")
def f15_escalation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.escalation_rates(predictions(spark, sf_dir))


_RELEASED = """count(*) FILTER (WHERE c) AS confirmations, count(*) FILTER (WHERE c AND gold = 'navigational') AS truly_navigational, count(*) FILTER (WHERE c AND r AND gold = 'navigational') AS released_navigational,
 count(*) FILTER (WHERE c AND r AND gold = 'state-changing') AS released_state_changing, count(*) FILTER (WHERE c AND r AND gold = 'destructive') AS released_destructive,
 coalesce(array_to_string(list_sort(list_distinct(list(lang) FILTER (WHERE c AND r AND gold = 'destructive'))), ','), '') AS wrong"""


@query(f"WITH {PREDICTIONS} SELECT {_RELEASED} FROM (SELECT *, said <> 'navigational' AS c, p_nav >= 0.7 AS r FROM predictions)")
def f16_release_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).agg(*M.release_counts(F.col("p_nav") >= 0.7, F.col("said") != "navigational"))


@query(f"WITH {PREDICTIONS} SELECT source, lang, {_RELEASED} FROM (SELECT *, said <> 'navigational' AS c, p_nav >= 0.9 AND p_destr < 0.5 AND p_off < 0.5 AS r FROM predictions) GROUP BY GROUPING SETS ((), (source), (lang))")
def f17_blind_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    released = (F.col("p_nav") >= R.MIN_NAVIGATIONAL) & (F.col("p_destr") < R.MAX_DESTRUCTIVE) & (F.col("p_off") < R.MAX_OFF_TASK)
    p = predictions(spark, sf_dir).withColumn("where", F.col("lang"))
    return p.groupingSets([[], [F.col("source")], [F.col("lang")]], "source", "lang").agg(*M.release_counts(released, F.col("said") != "navigational", key="where"))


@query("""SELECT event_type, quantile_disc(value, 0.95) AS nearest_rank, round(quantile_cont(value, 0.95), 6) AS linear, list_sort(list(value))[CAST(round_even(0.95 * (count(*) - 1), 0) AS INTEGER) + 1] AS rounded_index,
 list_sort(list(value))[least(count(*) - 1, CAST(floor(0.95 * count(*)) AS BIGINT)) + 1] AS floor_index FROM events GROUP BY event_type""")
def f18_latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", 0.95).withColumn("linear", F.round("linear", 6))


@query()
def f18_approx_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant for very large groups."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.percentile_approx("value", [0.5, 0.95], 10000).alias("p"))


@query(f"WITH {ATTEMPTS} SELECT lane, count(ms) AS n, min(ms) AS min_ms, max(ms) AS max_ms, round(quantile_cont(ms, 0.5), 6) AS p50_ms, round(quantile_cont(ms, 0.95), 6) AS p95_ms, round(avg(ms), 6) AS mean_ms FROM attempts GROUP BY lane")
def f19_latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.latency_summary(attempts(spark, sf_dir), "lane")
    return out.withColumns({c: F.round(c, 6) for c in ("p50_ms", "p95_ms", "mean_ms")})


@query(f"WITH {ATTEMPTS} SELECT lane, stage, CASE WHEN count(ms) = count(*) THEN round(quantile_cont(ms, 0.95), 6) END AS p95_ms, count(*) AS n FROM attempts GROUP BY lane, stage")
def f20_stage_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.stage_p95(attempts(spark, sf_dir), "lane", "stage").withColumn("p95_ms", F.round("p95_ms", 6))


SCORED = f"""{ATTEMPTS}, sc AS (SELECT attempt_id, min(lane) AS lane, count(DISTINCT CASE WHEN ms IS NOT NULL THEN stage END) AS have, max(ms) AS total, attempt_id % 12 = 0 AS warmup, attempt_id % 29 <> 0 AS gate_ok,
 CASE WHEN attempt_id % 31 = 0 THEN 'unknown' ELSE 'groq' END AS planner, CASE WHEN attempt_id % 23 = 0 THEN 'error' ELSE 'ok' END AS terminal FROM attempts GROUP BY attempt_id)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("attempt_id")
    packed = attempts(spark, sf_dir).groupBy("attempt_id").agg(F.min("lane").alias("lane"), F.map_from_entries(F.collect_list(F.struct("stage", "ms"))).alias("stages_ms"), F.max("ms").alias("total"))
    packed = packed.withColumns({"warmup": i % 12 == 0, "gate_ok": i % 29 != 0, "planner": F.when(i % 31 == 0, "unknown").otherwise("groq"), "terminal": F.when(i % 23 == 0, "error").otherwise("ok"), "clock_source": F.lit("extension")})
    return M.score_attempts(packed, STAGES)


@query(f"WITH {SCORED} SELECT attempt_id, CAST(7 - have AS INTEGER) AS missing, lane = 'L2_full_core' AND NOT warmup AND planner = 'groq' AND gate_ok AND have = 7 AND terminal = 'ok' AS include FROM sc")
def f21_score_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("attempt_id", F.size("missing").alias("missing"), "include")


_TIER4 = "(['reversible', 'navigational', 'state-changing', NULL])[event_id % 4 + 1]"


@query(f"""WITH s AS (SELECT user_id AS attempt_id, event_id AS step, {_TIER4} AS tier, event_type AS gate, event_id % 101 = 0 OR event_id % 103 = 0 AS bypass, event_id % 5 = 0 AS unattended FROM events)
SELECT attempt_id, arg_max(tier, step) AS local_tier, arg_max(gate, step) AS gate, bool_or(bypass) AS bypassed, bool_or(unattended AND NOT coalesce(tier IN ('reversible', 'navigational'), false)) AS silent, count(*) AS steps,
 NOT bool_or(bypass OR tier IS NULL OR (unattended AND NOT coalesce(tier IN ('reversible', 'navigational'), false))) AS ok FROM (SELECT * FROM s) GROUP BY attempt_id""".replace("arg_max(tier, step)", "arg_max_null(tier, step)"))
def f22_fold_gate_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    tier = F.when(i % 4 == 0, "reversible").when(i % 4 == 1, "navigational").when(i % 4 == 2, "state-changing")
    steps = table(spark, sf_dir, "events").select(F.col("user_id").alias("attempt_id"), i.alias("step"), tier.alias("local_tier"), F.col("event_type").alias("gate"), (i % 101 == 0).alias("bypassed"), (i % 103 != 0).alias("computed"), (i % 5 == 0).alias("unattended"))
    return M.fold_gate_steps(steps)


@query(f"""WITH {SCORED}, i AS (SELECT lane, total, 10 + (attempt_id % 3) AS warmups FROM sc WHERE NOT warmup), g AS (SELECT lane, max(warmups) AS warmups, count(total) AS n, round(quantile_cont(total, 0.95), 6) AS p95_ms FROM i GROUP BY lane)
SELECT *, warmups >= 10 AND n >= 100 AS eligible, CASE WHEN warmups >= 10 AND n >= 100 AND p95_ms < 200 THEN 'pass' ELSE 'fail' END AS status FROM g""")
def f23_latency_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).where(~F.col("warmup")).withColumn("warmups", 10 + F.col("attempt_id") % 3)
    return M.latency_gate(rows, "lane", "warmups", ms="total").withColumn("p95_ms", F.round("p95_ms", 6))


@query(f"""WITH {ATTEMPTS}, b AS (SELECT attempt_id, sum(ms) FILTER (WHERE stage <> 'plan') AS local_ms, sum(ms) FILTER (WHERE stage = 'plan') AS planner_ms FROM attempts GROUP BY attempt_id)
SELECT attempt_id, round(local_ms, 4) AS local_ms, round(planner_ms, 4) AS planner_ms, round(local_ms + planner_ms, 4) AS flow_ms, coalesce(local_ms + planner_ms < 200, false) AS within FROM b""")
def f24_latency_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.latency_breakdown(attempts(spark, sf_dir), "attempt_id", ("plan",))
    return out.withColumns({c: F.round(c, 4) for c in ("local_ms", "planner_ms", "flow_ms")})


@query(f"""WITH e AS (SELECT DISTINCT item_id % 20 AS g, {_TOKENS} AS token FROM benchmark), o AS (SELECT DISTINCT doc_id % 20 AS g, {_TOKENS} AS token FROM documents),
j AS (SELECT coalesce(e.g, o.g) AS g, e.token AS et, o.token AS ot FROM e FULL JOIN o ON e.g = o.g AND e.token = o.token)
SELECT g, count(*) FILTER (WHERE et IS NOT NULL AND ot IS NOT NULL) AS tp, count(*) FILTER (WHERE et IS NULL) AS fp, count(*) FILTER (WHERE ot IS NULL) AS fn FROM j GROUP BY g""")
def f25_set_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda name, key: table(spark, sf_dir, name).select((F.col(key) % 20).alias("g"), F.col(key).alias("k"), F.explode(F.filter(F.split(F.lower("text"), " "), lambda x: x != "")).alias("token"))
    return M.set_prf(words("benchmark", "item_id"), words("documents", "doc_id"), "token", "g").select("g", "tp", "fp", "fn")


def _risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.sensitive_spans(D.document_spans(probed(spark, sf_dir)).withColumnRenamed("spans", "truth"), out="pred")
    regions = S.spread(docs, "doc_id", items="pred").select("doc_id", "kind")
    truth = docs.select("doc_id", F.size(S.kinds_of(F.col("truth"))).alias("kinds"), (F.col("doc_id") % 3).alias("n_controls"))
    return G.risk_score(regions, truth.select("doc_id", "n_controls")).join(truth.select("doc_id", F.col("kinds").alias("gt_kinds")), "doc_id")


@query()
def f26_points_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.points_by_count(_risk(spark, sf_dir), "gt_kinds")


@query()
def f26_monotonic_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.monotonic_share(M.points_by_count(_risk(spark, sf_dir), "gt_kinds"), "gt_kinds")


@query(f"""WITH {PREDICTIONS}, c AS (SELECT source, n_chars % 997 / 10.0 AS ms, CASE WHEN doc_id % 9 = 0 THEN 'timeout ' || (doc_id % 4) END AS error, doc_id % 9 <> 0 AND doc_id % 5 <> 0 AS valid, doc_id % 9 <> 0 AND doc_id % 2 = 0 AS correct FROM predictions)
SELECT source, count(*) AS calls, count(error) AS errors, count(*) FILTER (WHERE valid) AS valid, count(*) FILTER (WHERE correct) AS correct, round(list_sort(list(ms))[CAST(round_even(0.5 * (count(ms) - 1), 0) AS INTEGER) + 1], 1) AS p50_ms,
 round(list_sort(list(ms))[CAST(round_even(0.95 * (count(ms) - 1), 0) AS INTEGER) + 1], 1) AS p95_ms, coalesce(array_to_string(list_sort(list_distinct(list(error) FILTER (WHERE error IS NOT NULL)))[1:3], '|'), '') AS error_samples FROM c GROUP BY source""")
def f27_bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    key = F.when(d % 2 == 0, "type #name Anna").otherwise("click #x")
    right = M.accepted(key, F.array(F.lit("type #name * anna"), F.lit("click #y")))
    calls = predictions(spark, sf_dir).select("source", (F.col("n_chars") % 997 / 10.0).alias("ms"), F.when(d % 9 == 0, F.concat(F.lit("timeout "), (d % 4).cast("string"))).alias("error"), ((d % 9 != 0) & (d % 5 != 0)).alias("valid"), ((d % 9 != 0) & right).alias("correct"))
    return M.bench_summary(calls, "source")


@query(f"WITH {PREDICTIONS} SELECT source, count(*) AS expected, count(*) FILTER (WHERE quality = 1) AS recognized, count(*) FILTER (WHERE toxic = 1) AS marked FROM predictions GROUP BY ROLLUP (source)")
def f28_category_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).rollup("source").agg(F.count("*").alias("expected"), M.n_if(F.col("quality") == 1).alias("recognized"), M.n_if(F.col("toxic") == 1).alias("marked"))


RULES = """rules AS (SELECT l_orderkey AS id, CASE min(l_linenumber % 3) WHEN 0 THEN 'pass' ELSE 'fail' END AS status, list(DISTINCT l_partkey) AS required FROM lineitem GROUP BY 1),
ev AS (SELECT p_partkey AS path FROM part WHERE p_partkey % 10 > 0), need AS (SELECT id, status, unnest(required) AS path FROM rules),
led AS (SELECT id, any_value(status) AS s0, count(*) FILTER (WHERE ev.path IS NULL) AS missing FROM need LEFT JOIN ev USING (path) GROUP BY id), ledger AS (SELECT id, missing, CASE WHEN s0 = 'pass' AND missing > 0 THEN 'unknown' ELSE s0 END AS status FROM led)"""


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rules, their parts as the evidence they need."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.when(F.min(F.col("l_linenumber") % 3) == 0, "pass").otherwise("fail").alias("status"), F.collect_set("l_partkey").alias("required"))


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ledger_status(_rules(spark, sf_dir), table(spark, sf_dir, "part").where("p_partkey % 10 > 0").select(F.col("p_partkey").alias("path")))


@query(f"WITH {RULES} SELECT id, status, missing FROM ledger")
def f29_ledger_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir).select("id", "status", "missing")


@query(f"WITH {RULES} SELECT CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'unknown') THEN 'unknown' ELSE 'pass' END AS overall, count(*) FILTER (WHERE status = 'pass') AS pass, count(*) FILTER (WHERE status = 'fail') AS fail, count(*) FILTER (WHERE status = 'unknown') AS unknown FROM ledger")
def f29_overall_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.overall_status(_ledger(spark, sf_dir))


@query(f"""WITH {RULES}, co AS (SELECT event_id AS ord, 'c' || event_id AS commit, user_id AS path FROM events), la AS (SELECT path, max(ord) AS ord FROM co GROUP BY path), r AS (SELECT id, any_value(status) AS status, max(ord) AS ord FROM need LEFT JOIN la USING (path) GROUP BY id)
SELECT id, 'c' || ord AS commit, (SELECT max(ord) FROM co) - ord AS behind, CASE WHEN status = 'pass' AND coalesce((SELECT max(ord) FROM co) - ord > 20, true) THEN 'unknown' ELSE status END AS status FROM r""")
def f30_evidence_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a commit log that touches its users' numbers."""
    commits = table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.concat(F.lit("c"), "event_id").alias("commit"), F.col("user_id").alias("path"))
    return M.evidence_freshness(_rules(spark, sf_dir), commits, 20)


@query("""WITH m AS (SELECT event_type, avg(value) AS v FROM events GROUP BY event_type), o AS (SELECT CASE event_type WHEN 'view' THEN 25 WHEN 'click' THEN 20 WHEN 'error' THEN 20 WHEN 'signup' THEN 20 ELSE 15 END AS w, v FROM m)
SELECT count(v) AS observed, round(sum(v * w) / 100, 6) AS total FROM o""")
def f31_rubric_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"view": "visual-context", "click": "pii-detection", "error": "redaction", "signup": "task-latency", "purchase": "presentation"}
    metric = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in names.items()))
    seen = table(spark, sf_dir, "events").groupBy(metric.alias("metric")).agg(F.avg("value").alias("value"))
    return M.rubric_total(seen).withColumn("total", F.round("total", 6))


@query("SELECT user_id, count(v) AS n, min(v) AS least, max(v) AS most, round(avg(v), 6) AS mean FROM (SELECT user_id, CASE WHEN event_id % 10 > 0 THEN value END AS v FROM events) GROUP BY user_id")
def f32_resource_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 10 > 0, F.col("value")).otherwise(F.lit(float("nan"))))
    return M.finite_summary(rows, "v", "user_id").withColumn("mean", F.round("mean", 6))


_LOG = """p AS (SELECT conv_id, (CASE WHEN conv_id % 9 = 4 THEN 'Q' ELSE 'P' END) || conv_id AS id, conv_id % 7 <> 3 AS non_author, CASE WHEN conv_id % 11 <> 5 THEN '2025-01-02' END AS date_utc, count(*) AS n, sum(length(text)) AS chars FROM conversations GROUP BY conv_id),
t AS (SELECT p.*, task, CASE WHEN n <= 2 AND task = 2 THEN NULL ELSE (['unaided', 'with_help', 'fail'])[CAST((chars + task) % 3 + 1 AS BIGINT)] END AS result FROM p, (SELECT unnest(range(0, 3)) AS task)),
bad AS (SELECT conv_id, any_value(id) AS id, CASE WHEN NOT starts_with(any_value(id), 'P') THEN 'id,' ELSE '' END || CASE WHEN NOT any_value(non_author) THEN 'author,' ELSE '' END || CASE WHEN any_value(date_utc) IS NULL THEN 'date,' ELSE '' END || CASE WHEN count(*) > count(result) THEN 'task,' ELSE '' END AS reasons FROM t GROUP BY conv_id)"""


def _review_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as participants' sessions of three tasks, documents with labels as reviewers' ratings."""
    k = F.col("conv_id")
    p = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    result = lambda i: F.when(~((F.col("n") <= 2) & (i == 2)), F.element_at(F.array(*map(F.lit, M.OUTCOMES)), ((F.col("chars") + i) % 3 + 1).cast("int")))
    people = p.select(F.concat(F.when(k % 9 == 4, "Q").otherwise("P"), k).alias("id"), (k % 7 != 3).alias("non_author"), F.when(k % 11 != 5, "2025-01-02").alias("date_utc"), F.create_map(*(x for i in range(3) for x in (F.lit(f"t{i}"), result(F.lit(i))))).alias("tasks"))
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    reviewers = d.select(F.concat(F.when(F.col("toxic") == 1, "X").otherwise("R"), "doc_id").alias("id"), (F.col("n_chars") % 7).cast("int").alias("rubric_score"), F.when(F.col("quality") == 1, "2025-02-03").alias("date_utc"))
    return people, reviewers


@query(f"WITH {_LOG} SELECT id, reasons FROM bad UNION ALL SELECT CASE WHEN toxic = 1 THEN 'X' ELSE 'R' END || doc_id, CASE WHEN toxic = 1 THEN 'id,' ELSE '' END || CASE WHEN n_chars % 7 NOT BETWEEN 1 AND 5 THEN 'score,' ELSE '' END || CASE WHEN quality <> 1 THEN 'date,' ELSE '' END FROM documents JOIN labels USING (doc_id)")
def f33_review_log_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    people, reviewers = M.review_log_check(*_review_log(spark, sf_dir), tasks=("t0", "t1", "t2"))
    return people.select("id", "reasons").unionByName(reviewers.select("id", "reasons"))


@query(f"""WITH {_LOG} SELECT 't' || task AS task, count(*) FILTER (WHERE result = 'unaided') AS unaided, count(*) FILTER (WHERE result = 'with_help') AS with_help, count(*) FILTER (WHERE result = 'fail') AS fail,
 count(*) >= 5 AND (SELECT count(*) FROM documents JOIN labels USING (doc_id) WHERE toxic <> 1 AND quality = 1 AND n_chars % 7 BETWEEN 1 AND 5) >= 3 AS met FROM t JOIN bad USING (conv_id) WHERE reasons = '' GROUP BY task""")
def f33_review_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.review_outcomes(*M.review_log_check(*_review_log(spark, sf_dir), tasks=("t0", "t1", "t2")))


GRID = tuple(round(0.1 * i, 1) for i in range(1, 101, 3))


@query(f"""WITH l AS (SELECT vec_id, label % 4 AS bucket, embedding::DOUBLE[] AS x, CAST(vec_id % 8 AS INTEGER) AS gold FROM embeddings), t AS (SELECT *, unnest({list(GRID)}::DOUBLE[]) AS t FROM l), s AS (SELECT bucket, t, gold, list_transform(x, lambda v: v / t) AS z FROM t),
m AS (SELECT bucket, t, avg(ln(list_sum(list_transform(z, lambda v: exp(v - list_max(z))))) + list_max(z) - z[gold + 1]) AS nll, count(*) AS n FROM s GROUP BY bucket, t)
SELECT bucket, max(n) AS n, CASE WHEN max(n) < 10 THEN 1.0 ELSE arg_min(t, (round(nll, 12), t)) END AS temperature FROM m GROUP BY bucket""")
def f34_temperature_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select((F.col("label") % 4).alias("bucket"), F.transform("embedding", lambda v: v.cast("double")).alias("logits"), (F.col("vec_id") % 8).cast("int").alias("gold"))
    return M.temperature_fit(rows, GRID, "bucket")


@query("SELECT o_custkey, round(a * b * c, 6) AS impact FROM (SELECT o_custkey, avg(o_totalprice) / 1e6 AS a, CASE WHEN o_custkey % 7 > 0 THEN count(*) / 100.0 END AS b, 0.5 AS c FROM orders GROUP BY o_custkey)")
def f35_impact_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.avg("o_totalprice") / 1e6).alias("a"), F.when(F.col("o_custkey") % 7 > 0, F.count("*") / 100.0).alias("b"), F.lit(0.5).alias("c"))
    return M.impact(rates, "a", "b", "c").select("o_custkey", F.round("impact", 6).alias("impact"))


_WORDED = f"""{BOXES}, words AS (SELECT box_id, image, side, x, y, w, h, kind, confidence, (['Amber', 'basil ', 'Cedar-3', 'dune'])[CAST(box_id % 4 AS INTEGER) + 1] AS text FROM boxes),
j AS (SELECT t.box_id, any_value(t.image) AS image, any_value(t.kind) = 'email' AS pii, regexp_replace(lower(any_value(t.text)), '[^a-z0-9]', '', 'g') AS want, string_agg(regexp_replace(lower(p.text), '[^a-z0-9]', '', 'g'), '' ORDER BY p.box_id) AS got,
 coalesce(bool_or(p.kind = 'email'), false) AS any_sensitive, coalesce(bool_and(p.kind <> 'email' AND p.confidence >= 0.93), true) AS all_open FROM words t LEFT JOIN words p ON t.image = p.image AND p.side = 'pred' AND p.x + p.w / 2 BETWEEN t.x AND t.x + t.w AND p.y + p.h / 2 BETWEEN t.y AND t.y + t.h
 WHERE t.side = 'truth' GROUP BY t.box_id, t.image, t.kind, t.text, t.x, t.y, t.w, t.h, t.confidence)"""


@query(f"""WITH {_WORDED}, s AS (SELECT image, pii, coalesce(got, '') = want AS recognized, any_sensitive, all_open FROM j)
SELECT image, count(*) FILTER (WHERE pii) AS pii_tokens, count(*) FILTER (WHERE pii AND recognized AND any_sensitive) AS pii_detected, count(*) FILTER (WHERE pii AND recognized AND all_open) AS pii_retained, count(*) FILTER (WHERE NOT pii) AS useful_tokens, count(*) FILTER (WHERE NOT pii AND recognized AND all_open) AS useful_retained FROM s GROUP BY image""")
def f36_fixture_token_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as words: odd lines were expected, even ones were read, those of the kind email are sensitive."""
    word = F.element_at(F.array(*map(F.lit, ("Amber", "basil ", "Cedar-3", "dune"))), (F.col("box_id") % 4 + 1).cast("int"))
    b = boxes(spark, sf_dir).withColumns({"text": word, "sensitive": F.col("kind") == "email"})
    truth = b.where("side = 'truth'").withColumnRenamed("sensitive", "pii")
    return M.fixture_token_score(truth, b.where("side = 'pred'"), "image", least=0.93)


_MEDIAN = "round(median(value), 6)"


@query("""WITH g AS (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value < 100) AS done, sum(CASE WHEN event_id % 4 = 0 THEN 3 ELSE 1 END) AS weights, sum(CASE WHEN event_id % 4 = 0 THEN 3 ELSE 1 END) FILTER (WHERE value < 100) AS passed,
 count(*) FILTER (WHERE event_id % 3 = 0) AS faults, count(*) FILTER (WHERE event_id % 3 = 0 AND value < 100) AS recovered, avg(event_id % 5) AS rating, round(median(value), 6) AS runs, count(*) FILTER (WHERE event_id % 50 = 7) AS unexpected FROM events GROUP BY event_type)
SELECT event_type, round(100.0 * passed / weights, 4) AS functionality, CASE WHEN n >= 25 THEN round(100.0 * done / n, 4) END AS completion, CASE WHEN faults >= 20 THEN round(100.0 * recovered / faults, 4) END AS recovery, CASE WHEN n >= 18 THEN round(100 * rating / 4, 4) END AS narrative,
 CASE WHEN n >= 3 THEN runs END AS median_run, CASE WHEN n >= 1000 THEN round(100.0 * unexpected / n, 4) END AS unexpected_failure FROM g""")
def f37_benchmark_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, done = F.col("event_id"), F.col("value") < 100
    rows = table(spark, sf_dir, "events").select("event_type", F.when(i % 4 == 0, 3).otherwise(1).alias("weight"), done.alias("passed"), (i % 3 == 0).alias("fault"), (i % 5).alias("rating"), F.col("value").alias("run"), (i % 50 == 7).alias("unexpected"))
    return M.benchmark_formulas(rows, "event_type")
