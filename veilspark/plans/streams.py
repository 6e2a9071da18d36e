"""Queries of streams: each runs over the whole table as a stream and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import sketches as Q
from ..operators import tokens as K
from ..sources import tables as A
from ..streaming import streams as H
from .inputs import table
from .registry import query


#: Files of a table that one batch of a stream takes; answers don't depend on it.
FILES = 64
STEP = 3600.0


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return H.read_table(spark, f"{sf_dir}/{name}.parquet", table(spark, sf_dir, name).schema, files_per_batch=FILES)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time, a stream of them."""
    return _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _span(spark: SparkSession, sf_dir: str, ts: Column | None = None) -> str:
    """How late an event of a table may come whose files are in no order of time: as long as all its events take."""
    at = F.unix_micros(F.col("ts").cast("timestamp") if ts is None else ts)
    ends = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    return f"{((ends.b or 0) - (ends.a or 0)) // 1_000_000 + 1} seconds"


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def a5_write_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written once, and read back after a second write was refused."""
    path = f"{H.shared_folder(spark)}/evidence"
    events = table(spark, sf_dir, "events")
    A.write_once(events, path)
    try:
        A.write_once(events, path)
    except Exception:  # noqa: BLE001  the refusal is the point
        return spark.read.schema(events.schema).parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))
    raise RuntimeError("evidence was overwritten")


@query("SELECT event_id, event_type AS action FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def a6_audit_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of events, appended once per batch; the latest hundred of the latest thousand are served."""
    folder = H.shared_folder(spark)
    audit = _events(spark, sf_dir).select("event_id", "ts", F.col("event_type").alias("action"))
    H.audit_sink(audit, f"{folder}/audit", f"{folder}/checkpoint")
    kept = A.latest(spark.read.parquet(f"{folder}/audit"), "ts", "event_id", 1000)
    return A.latest(kept, "ts", "event_id", 100).select("event_id", "action")


@query("SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role")
def a7_outbound_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as bodies in a log of lines, read as a stream."""
    folder = H.shared_folder(spark)
    table(spark, sf_dir, "conversations").select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("value")).write.text(f"{folder}/log")
    got = H.run_available(H.outbound_log(spark, f"{folder}/log"))
    body = F.from_json("body", "role string, text string")
    return got.select(body.alias("b")).groupBy("b.role").agg(F.count("*").alias("n"), F.sum(F.length("b.text")).alias("chars"))


def _burst() -> Column:
    """Event time pressed together, so that limits bite: a second of it for each 20 minutes."""
    return F.timestamp_micros((F.unix_micros("ts") / 1200).cast("long"))


@query()
def h1_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _events(spark, sf_dir).select("user_id", "event_id", _burst().alias("ts"))
    return H.on_time(H.run_available(H.rate_limit(requests, most=3, late=_span(spark, sf_dir, _burst()), step_s=STEP)))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) // 1200 AS us FROM events), w AS (SELECT user_id, us // 10000000 * 10000000 - k * 10000000 AS start FROM e, (SELECT unnest(range(0, 6)) AS k)) SELECT user_id, start, count(*) AS n FROM w GROUP BY ALL""")
def h1_rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = H.rate_windows(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", _burst().alias("ts")))
    return out.select("user_id", F.unix_micros("window.start").alias("start"), "n")


@query()
def h2_replay_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nonces that come again and again."""
    requests = _events(spark, sf_dir).select(F.col("user_id").alias("scope"), "event_id", (F.col("event_id") % 25).cast("string").alias("nonce"), _burst().alias("ts"))
    return H.on_time(H.run_available(H.replay_guard(requests, window_s=120.0, most=12, late=_span(spark, sf_dir, _burst()), step_s=STEP)))


@query("SELECT user_id AS scope, event_id % 25 AS nonce FROM events GROUP BY ALL")
def h2_first_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _events(spark, sf_dir).select(F.col("user_id").alias("scope"), "event_id", (F.col("event_id") % 25).alias("nonce"), "ts")
    return H.run_available(H.first_uses(requests, "60 days")).select("scope", "nonce")


_STAGED = "s AS (SELECT user_id, event_type AS stage, CASE WHEN event_id % 3 = 0 THEN 'active' ELSE 'done' END AS status, ts, event_id FROM events)"


@query(f"""WITH {_STAGED}, n AS (SELECT *, lead(ts) OVER w AS nts, lead(status) OVER w AS ns FROM s WINDOW w AS (PARTITION BY user_id, stage ORDER BY ts, event_id)),
m AS (SELECT user_id, stage, CASE WHEN ns = 'done' THEN (epoch_us(nts) - epoch_us(ts)) / 1000.0 END AS ms FROM n WHERE status = 'active')
SELECT user_id, stage, round(sum(ms), 3) AS ms, CASE WHEN count(ms) = 0 THEN 'stage did not end' END AS reason FROM m GROUP BY user_id, stage""")
def h3_stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("stage"), F.when(F.col("event_id") % 3 == 0, "active").otherwise("done").alias("status"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return H.stage_durations(e, "user_id").select("user_id", "stage", F.round("ms", 3).alias("ms"), "reason")


@query(f"""WITH {_STAGED}, n AS (SELECT *, lead(ts) OVER w AS nts, lead(status) OVER w AS ns FROM s WINDOW w AS (PARTITION BY user_id, stage ORDER BY ts, event_id)),
m AS (SELECT event_id, CASE WHEN ns = 'done' AND nts <= ts + INTERVAL 2 DAY THEN (epoch_us(nts) - epoch_us(ts)) / 1000.0 END AS ms FROM n WHERE status = 'active')
SELECT event_id, ms, CASE WHEN ms IS NULL THEN 'stage did not end' END AS reason FROM m""")
def h3_stage_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each start of a stage as a stream, with a time limit of two days."""
    e = _events(spark, sf_dir).select(F.concat_ws(":", "user_id", "event_type").alias("stage"), "event_id", "ts", F.when(F.col("event_id") % 3 == 0, "active").otherwise("done").alias("status"))
    return H.on_time(H.run_available(H.stage_clock(e, "stage", 2 * 86_400.0, late=_span(spark, sf_dir), step_s=86_400.0))).select("event_id", "ms", "reason")


def _halved() -> Column:
    return F.timestamp_micros((F.unix_micros("ts") / 600).cast("long"))


def _runs(events: DataFrame) -> DataFrame:
    """Forty consecutive events are a run; purchases complete it, values' hundreds are its fingerprint."""
    return events.select((F.col("event_id") / 40).cast("long").alias("run_id"), "event_id", _halved().alias("ts"), ((F.col("event_type") == "purchase") & (F.col("event_id") % 5 == 0)).alias("complete"), (F.col("value") / 100).cast("long").cast("string").alias("fingerprint"))


_BUDGET = """WITH e AS (SELECT event_id // 40 AS run_id, event_id, epoch_us(ts) // 600 AS us, event_type = 'purchase' AND event_id % 5 = 0 AS complete, CAST(trunc(value / 100) AS BIGINT) AS f FROM events),
n AS (SELECT *, row_number() OVER w AS n, us - min(us) OVER (PARTITION BY run_id) AS since, row_number() OVER w - row_number() OVER (PARTITION BY run_id, f ORDER BY us, event_id) AS island FROM e WINDOW w AS (PARTITION BY run_id ORDER BY us, event_id)),
s AS (SELECT run_id, event_id, n, CASE WHEN since >= 90000000 THEN 'deadline' WHEN complete THEN 'completed' WHEN f IS NOT NULL AND row_number() OVER (PARTITION BY run_id, f, island ORDER BY n) > 2 THEN 'no_progress' WHEN n > 8 THEN 'step_limit' END AS status FROM n)
SELECT run_id, arg_min(event_id, n) AS event_id, arg_min(status, n) AS status, CAST(min(n) - 1 AS BIGINT) AS actions FROM s WHERE status IS NOT NULL GROUP BY run_id"""


@query(_BUDGET)
def h4_run_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.on_time(H.run_available(H.run_budget(_runs(_events(spark, sf_dir)), late=_span(spark, sf_dir, _halved()), step_s=STEP)))


@query(_BUDGET)
def h4_run_budget_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a table, by gaps and islands."""
    return H.run_budget_table(_runs(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))))


@query("""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1200 AS us FROM events)
SELECT c.event_id AS capture_id, a.event_id AS action_id, a.user_id FROM e c JOIN e a ON c.user_id = a.user_id AND c.event_type = 'view' AND a.event_type = 'click' AND a.us BETWEEN c.us AND c.us + 30000000""")
def h5_freshness_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", "user_id", "event_type", _burst().alias("ts"))
    view, click = (H.only(e, F.col("event_type") == kind) for kind in ("view", "click"))
    return H.run_available(H.freshness_join(view, click, "user_id", delay=_span(spark, sf_dir, _burst())))


@query("""WITH w AS (SELECT epoch_us(date_trunc('hour', ts)) AS start, event_type, value FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY start, event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY start, event_type) AS n FROM w)
SELECT start, event_type, count(*) AS n, max(value) AS max_ms, round(avg(value), 6) AS mean_ms, min(CASE WHEN r >= 0.95 * n THEN value END) AS p95_ms FROM r GROUP BY start, event_type""")
def h6_audit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = _events(spark, sf_dir).select("event_id", "ts", "event_type", F.col("value").alias("ms"))
    out = H.run_available(H.audit_windows(audit, "event_type", delay=_span(spark, sf_dir)))
    return out.select(F.unix_micros("start").alias("start"), "event_type", "n", "max_ms", F.round("mean_ms", 6).alias("mean_ms"), "p95_ms")


@query("SELECT count(*) AS n_input, count(*) AS n_accounted FROM events")
def h6_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a stream that waits ten minutes only: what they count and what is late make up all that came."""
    audit = _events(spark, sf_dir).select("event_id", "ts", "event_type", F.col("value").alias("ms"))
    split = H.split_late(audit, 3600.0, late="10 minutes")
    out, seen = H.run_counted(H.audit_windows(split.where("NOT late"), "event_type"))
    return out.agg((F.lit(seen.get("n", 0)).cast("long")).alias("n_input"), (F.coalesce(F.sum("n"), F.lit(0)) + F.lit(seen.get("n_late", 0))).cast("long").alias("n_accounted"))


@query()
def h6_sketch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and latencies of each kind of event, sketched by the hour in a stream and merged to days, months and all."""
    events = _events(spark, sf_dir).select("event_id", "ts", "event_type", "user_id", "value")
    hours = H.run_available(H.sketch_windows(events, "event_type", "user_id", "value", delay=_span(spark, sf_dir)))
    held = Q.rollup(hours, "start", ["event_type"], ["day", "month"]).where("level <> ''")
    return held.select("level", F.unix_micros("start").alias("start"), "event_type", "n", Q.distinct_estimate().alias("users"), *(Q.quantile(q / 100).alias(f"p{q}") for q in (50, 95, 99)))


@query("""SELECT event_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), ',') AS history FROM events WHERE event_type <> 'view'""")
def h7_action_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type <> 'view'").withColumn("action", F.col("event_type"))
    return H.action_history(e).select("event_id", "history")


@query("""WITH h AS (SELECT user_id, event_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), ',') AS history, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type <> 'view')
SELECT user_id, event_id, history FROM h WHERE r = 1""")
def h7_action_history_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after the last batch."""
    e = H.only(_events(spark, sf_dir), F.col("event_type") != "view").select("user_id", "event_id", "ts", F.col("event_type").alias("action"))
    out = H.on_time(H.run_available(H.action_history_stream(e, late=_span(spark, sf_dir), step_s=86_400.0)))
    return out.groupBy("user_id").agg(F.max(F.struct("at", "event_id", "history")).alias("h")).select("user_id", "h.event_id", "h.history")


@query("""WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, event_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, count(*) AS n, min(event_id) AS first, max(event_id) AS last, epoch_us(min(ts)) AS start FROM s GROUP BY user_id, k""")
def h8_run_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return H.run_sessions(e, "6 hours", "user_id").withColumn("start", F.unix_micros("start"))


@query("SELECT conv_id, turn, CAST(1 AS INTEGER) AS n_masked, md5(text || ' <mask-pii/>') AS digest FROM conversations")
def h9_stream_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, each with an address at its end."""
    turns = _stream(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.lit(" u"), "conv_id", F.lit("@example.test")).alias("text"))
    out = H.run_available(H.stream_redact(turns).drop("decisions"))
    return out.select("conv_id", "turn", "n_masked", F.md5("masked").alias("digest"))


_WORDS = "unnest(list_filter(string_split(text, ' '), lambda w: length(w) > 9))"


@query(f"""WITH v AS (SELECT DISTINCT conv_id, {_WORDS} AS value FROM conversations WHERE role = 'user'), h AS (SELECT c.conv_id, c.turn, value FROM conversations c JOIN v USING (conv_id) WHERE role = 'assistant' AND contains(lower(text), lower(value)))
SELECT conv_id, count(*) AS alerts FROM h GROUP BY conv_id""")
def h10_stream_leak_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long words of user turns as secrets, the assistant's turns as what goes out."""
    words = F.filter(F.split("text", " "), lambda w: F.length(w) > 9)
    said = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("scope"), F.col("turn").alias("source_ord"), F.posexplode(words).alias("start", "value"), F.lit("WORD").alias("type"))
    vault = K.mint_tokens(said).withColumnRenamed("scope", "conv_id")
    bodies = _stream(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")
    return H.stream_leak_alert(bodies, vault, "conv_id").groupBy("conv_id").agg(F.count("*").alias("alerts"))


@query()
def h11_value_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups issue a reference for their user, clicks and purchases apply it; at times the clock runs backwards."""
    e = H.only(_events(spark, sf_dir), F.col("event_type").isin("signup", "click", "purchase"))
    ops = e.select(
        F.col("user_id").alias("reference_id"), "event_id", F.col("event_id").alias("seq"), _burst().alias("ts"), F.when(F.col("event_id") % 23 == 0, _burst() - F.expr("INTERVAL 5 SECONDS")).otherwise(_burst()).alias("clock"), F.when(F.col("event_type") == "signup", "issue").otherwise("apply").alias("op"), F.when(F.col("event_id") % 7 == 0, "phone").otherwise("email").alias("kind"), F.lit("#to").alias("target"), F.lit("r1").alias("revision"), (F.col("event_id") % 5 != 0).alias("confirmed")
    )
    return H.on_time(H.run_available(H.value_references(ops, late=_span(spark, sf_dir, _burst()), step_s=STEP)))


@query("""SELECT epoch_us(date_trunc('day', ts)) AS start, (['unattended', 'confirm', 'ask', 'reject'])[event_id % 4 + 1] AS gate, count(*) AS n FROM events GROUP BY ALL""")
def h12_step_gate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    tier = F.when(k == 0, "reversible").when(k == 1, "state-changing").when(k == 2, "destructive").otherwise("odd")
    plans = _events(spark, sf_dir).select("event_id", "ts", R.gate_local(F.lit(True), tier).alias("gate"))
    return H.run_available(H.gate_windows(plans, delay=_span(spark, sf_dir))).withColumn("start", F.unix_micros("start"))
