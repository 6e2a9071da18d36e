"""Streams of events, bodies and captures: stateless jobs, windows, joins, and the stateful processors.

A row without an ``event_id`` is a tick: it tells the time and nothing else. A table that is read as a stream ends with one,
by which the watermark passes all that went before and every window, join and reorder buffer gives out what it holds.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import detection as D
from ..operators import matching as M
from ..operators import sketches as Q
from ..operators import timeline as L
from ..operators import tokens as K
from ..sources.shared import shared_folder
from .state import LastActions, LateRows, RateLimiter, Reordered, ReplayGuard, RunBudget, StageClock, ValueReferences

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATEST = "1 hour"  # how late an event may come
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PROGRESS = "spark.sql.streaming.numRecentProgressUpdates"  # of all batches, for what they observe
END = dt.datetime(2200, 1, 1)
NEVER = -(1 << 60)  # the time, in microseconds, of events that have none


def read_table(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A folder or a single file of Parquet as a stream; the stream reader takes a file only as a pattern.

    Where the schema has a time, the stream has a second, empty folder of ticks, which :func:`run_available` uses.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(f"{path[:-1]}[{path[-1]}]")
    if not any(isinstance(f.dataType, T.TimestampType | T.TimestampNTZType) for f in schema):
        return stream
    ticks = f"{shared_folder(spark)}-ticks"
    spark.createDataFrame([], schema).write.parquet(ticks)
    return stream.unionByName(spark.readStream.schema(schema).parquet(ticks))


def _tick(spark: SparkSession, folder: str) -> None:
    schema = spark.read.parquet(folder).schema
    last = [END if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType) else None for f in schema]
    spark.createDataFrame([tuple(last)], T.StructType([T.StructField(f.name, f.dataType) for f in schema])).write.mode("append").parquet(folder)


def outbound_log(spark: SparkSession, path: str) -> DataFrame:
    """An append-only log with a body on each line, as a stream of lines."""
    return spark.readStream.text(path).withColumnRenamed("value", "body")


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    wanted = {PROVIDER: ROCKSDB, PROGRESS: "1000000"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_available(stream: DataFrame, mode: str = "append", close: bool = True) -> DataFrame:
    """Run a stream over all that is there now, into the shared folder, and read the result as a table.

    With ``close`` its ticks then come, and it runs on from where it was, so that nothing is held back.
    """
    return run_counted(stream, mode, close)[0]


def run_counted(stream: DataFrame, mode: str = "append", close: bool = True) -> tuple[DataFrame, dict[str, int]]:
    """:func:`run_available`, and the sums of what the stream observes."""
    seen: dict[str, int] = {}
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)

    def run() -> list[str]:
        job = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{folder}/out")
        try:
            job.awaitTermination()
            for progress in job.recentProgress:
                for row in progress["observedMetrics"].values():
                    for name, n in row.asDict().items():
                        seen[name] = seen.get(name, 0) + (n or 0)
            return [m[1] for p in job.recentProgress[-1:] for x in p["sources"] if (m := re.search(r"\[(.*veil-stream-[0-9a-f]{32}-ticks)\]", x["description"]))]
        finally:
            job.stop()

    with _rocksdb(spark):
        ticks = dict.fromkeys(run())
        if close and ticks:
            for where in ticks:
                _tick(spark, where)
            run()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out"), seen


def audit_sink(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append each batch once: a batch that is run again replaces its own folder and no other."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def timed(events: DataFrame, late: str = LATEST) -> DataFrame:
    """With a watermark, unless the stream has its own, and then without ticks (which must have passed the watermark)."""
    marked = any("spark.watermarkDelayMs" in f.metadata for f in events.schema)
    events = events if marked else events.withWatermark("ts", late)
    told = F.when(F.col("ts").isNotNull(), F.col("event_id")).isNotNull()  # a condition on the time stays above the watermark
    return events.where(told | F.when(F.col("ts").isNull(), F.col("event_id")).isNotNull())


def only(events: DataFrame, condition: Column) -> DataFrame:
    """The events that fulfil a condition, and all ticks."""
    return events.where(condition | F.col("event_id").isNull())


def _in_order(events: DataFrame, key: str, rule: Reordered, out: str, late: str = LATEST) -> DataFrame:
    """``(key, .., late)``: what a rule decides of each key's events in the order of their time, whatever order they come in.

    Events later than ``late`` whose step is decided are not: they come out with ``late`` and nothing else but their id.
    Events without a time are late too.
    """
    # the watermark's own column stays behind, so that late rows reach the processor
    rows = timed(events, late).withColumn("at", F.coalesce(F.unix_micros("ts"), F.lit(NEVER)))
    kind = rows.schema[key].dataType.simpleString()
    made = rows.select(F.col(key).alias("key"), *rule.columns).groupBy("key").transformWithStateInPandas(rule, f"key {kind}, {out}, late boolean", "append", "EventTime")
    return made.withColumnRenamed("key", key)


def on_time(decided: DataFrame) -> DataFrame:
    return decided.where("NOT late").drop("late")


def late_counts(decided: DataFrame) -> DataFrame:
    """How many events came too late, and how many in time."""
    return decided.groupBy("late").agg(F.count("*").alias("n"))


def rate_limit(events: DataFrame, most: int = 20, window_s: float = 60.0, late: str = LATEST, step_s: float = 600.0) -> DataFrame:
    """``(user_id, event_id, accepted, late)`` for every request ``(user_id, event_id, ts)``."""
    return _in_order(events, "user_id", RateLimiter(most, window_s, step_s), "event_id long, accepted boolean", late)


def rate_windows(events: DataFrame, window: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """The built-in approximation: requests per user in sliding windows."""
    return events.groupBy(F.window("ts", window, slide), "user_id").agg(F.count("*").alias("n"))


def replay_guard(requests: DataFrame, window_s: float = 600.0, most: int = 10_000, late: str = LATEST, step_s: float = 600.0) -> DataFrame:
    """``(scope, event_id, first_use, late)`` for every request ``(scope, event_id, nonce, ts)``."""
    return _in_order(requests, "scope", ReplayGuard(window_s, most, step_s), "event_id long, first_use boolean", late)


def split_late(events: DataFrame, size_s: float, late: str = LATEST) -> DataFrame:
    """Events, each with whether it comes ``late``: after the watermark has passed the end of its window of ``size_s``.

    Late ones lose their time, so they are in no window. How many came and how many were late is observed as ``late``.
    """
    rows = timed(events, late).withColumn("at", F.coalesce(F.unix_micros("ts"), F.lit(NEVER)))
    kept = [f for f in events.schema if f.name != "ts"]
    out = ", ".join(["ts timestamp", *(f"{f.name} {f.dataType.simpleString()}" for f in kept), "late boolean"])
    rows = rows.select(F.pmod(F.xxhash64("event_id"), F.lit(256)).alias("part"), "at", *(f.name for f in kept))
    marked = rows.groupBy("part").transformWithStateInPandas(LateRows(size_s), out, "append", "EventTime", eventTimeColumnName="ts")
    return marked.observe("late", F.count("*").alias("n"), F.count_if("late").alias("n_late"))


def first_uses(requests: DataFrame, delay: str = "600 seconds") -> DataFrame:
    """The plain case without a cap: repeats within the watermark go."""
    return timed(requests, delay).dropDuplicatesWithinWatermark(["scope", "nonce"])


def stage_durations(events: DataFrame, *keys: str) -> DataFrame:
    """Time from ``active`` to the stage's next other status, per run, step and stage; repeats add up.

    A stage that never ends, or ends before it begins, is null with a reason.
    """
    rows = L.following(events, [*keys, "stage"], ["ts", "event_id"], ["ts", "status"], "_next").where("status = 'active'")
    done = F.col("_next.status").isNotNull() & (F.col("_next.status") != "active")
    ms = F.when(done, (F.unix_micros("_next.ts") - F.unix_micros("ts")) / 1000.0)
    out = rows.withColumn("ms", ms).groupBy(*keys, "stage").agg(F.sum("ms").alias("ms"), F.count("ms").alias("ended"))
    return out.withColumn("reason", F.when(F.col("ended") == 0, "stage did not end"))


def stage_clock(events: DataFrame, key: str, timeout_s: float = 3600.0, late: str = LATEST, step_s: float = 600.0) -> DataFrame:
    """``(key, event_id, at, ms, reason, late)`` for each start of a stage, from ``(key, event_id, ts, status)``.

    A start whose stage gets no other status in ``timeout_s`` comes out by a timer, with a reason and no time.
    """
    return _in_order(events, key, StageClock(timeout_s, step_s), "event_id long, at long, ms double, reason string", late)


def run_budget(events: DataFrame, most_steps: int = 8, deadline_s: float = 90.0, no_progress: int = 2, late: str = LATEST, step_s: float = 600.0) -> DataFrame:
    """``(run_id, event_id, status, actions, late)`` once per run, from ``(run_id, event_id, ts, complete, fingerprint)``."""
    return _in_order(events, "run_id", RunBudget(most_steps, deadline_s, no_progress, step_s=step_s), "event_id long, status string, actions long", late)


def run_budget_table(events: DataFrame, most_steps: int = 8, deadline_s: float = 90.0, no_progress: int = 2) -> DataFrame:
    """``(run_id, event_id, status, actions)`` of a whole table of runs, none of which pauses for a day.

    A run ends with its event number ``most_steps + 1`` at the latest, so only so many of each are kept, before any
    shuffle. Events with the same fingerprint one after another are an island: their numbers in the run and among the
    run's events of that fingerprint differ by the same.
    """
    run, same = Window.partitionBy("run_id").orderBy("ts", "event_id"), Window.partitionBy("run_id", "fingerprint").orderBy("ts", "event_id")
    first = events.withColumn("n", F.row_number().over(run)).where(F.col("n") <= most_steps + 1)
    first = first.withColumn("island", F.col("n") - F.row_number().over(same))
    along = Window.partitionBy("run_id", "fingerprint", "island").orderBy("n")
    still = F.col("fingerprint").isNotNull() & (F.row_number().over(along) > no_progress)
    since = F.unix_micros("ts") - F.unix_micros(F.min("ts").over(Window.partitionBy("run_id")))
    status = F.when(since >= deadline_s * 1e6, "deadline").when(F.col("complete"), "completed").when(still, "no_progress").when(F.col("n") > most_steps, "step_limit")
    ended = first.withColumn("status", status).where(F.col("status").isNotNull())
    least = ended.groupBy("run_id").agg(F.min(F.struct("n", "event_id", "status")).alias("e"))
    return least.select("run_id", "e.event_id", "e.status", (F.col("e.n") - 1).cast("long").alias("actions"))


def freshness_join(captures: DataFrame, actions: DataFrame, key: str, within: str = "30 seconds", delay: str = "1 minute") -> DataFrame:
    """Actions with the captures of their revision that are at most ``within`` old; both sides' state is bounded."""
    c = timed(captures, delay).select(F.col(key).alias("c_key"), F.col("ts").alias("captured"), F.col("event_id").alias("capture_id"))
    a = timed(actions, delay).select(F.col(key).alias("a_key"), F.col("ts").alias("acted"), F.col("event_id").alias("action_id"))
    return c.join(a, F.expr(f"c_key = a_key AND acted >= captured AND acted <= captured + INTERVAL {within}")).select("capture_id", "action_id", F.col("a_key").alias(key))


def audit_windows(audit: DataFrame, by: str, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts and latency per tumbling window; rows whose window has closed are beyond ``delay`` and left out (count
    them with :func:`split_late`). The 95th percentile is a sketch's, within a ten-thousandth of rank."""
    return timed(audit, delay).groupBy(F.window("ts", size), by).agg(F.count("*").alias("n"), F.max("ms").alias("max_ms"), F.avg("ms").alias("mean_ms"), F.percentile_approx("ms", 0.95).alias("p95_ms")).select(F.col("window.start").alias("start"), by, "n", "max_ms", "mean_ms", "p95_ms")


def sketch_windows(events: DataFrame, by: str, member: str, value: str, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Sketches per tumbling window, to be merged into longer ones (:mod:`..operators.sketches`)."""
    made = timed(events, delay).groupBy(F.window("ts", size), by).agg(*Q.sketches(F.col(member), F.col(value)))
    return made.select(F.col("window.start").alias("start"), by, "n", "n_values", "members", "amounts")


def action_history(events: DataFrame, n: int = 8) -> DataFrame:
    """Per event the user's last ``n`` actions, this one included (batch)."""
    return L.recent(events, ["user_id"], ["ts", "event_id"], "action", n, "history").withColumn("history", F.array_join("history", ","))


def action_history_stream(events: DataFrame, n: int = 8, late: str = LATEST, step_s: float = 600.0) -> DataFrame:
    """``(user_id, event_id, at, history, late)``: a user's last ``n`` actions after each step of time that has any."""
    return _in_order(events, "user_id", LastActions(n, step_s=step_s), "event_id long, at long, history string", late)


def run_sessions(events: DataFrame, gap: str, by: str) -> DataFrame:
    """Runs of a user without a pause of ``gap``."""
    return events.groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last")).select(by, "n", "first", "last", F.col("session_window.start").alias("start"))


def stream_redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The batch job's own columns on a stream."""
    return K.masked_text(D.document_spans(docs, text), text)


def leak_alerts(bodies: DataFrame, vault: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Bodies that hold a known value of their scope, in either case; the alert names the token only. Values are found as
    the leak check finds them."""
    known = vault.select(key, "token", F.lower("value").alias("_needle"))
    held = bodies.withColumn("_hay", F.lower(text)).drop(text)
    found = M.occurrences(held, known, key, "_hay", "_needle", keep=[c for c in bodies.columns if c not in (key, text)])
    return found.withColumnRenamed("value", "_needle").join(known, [key, "_needle"]).select(*(c for c in bodies.columns if c != text), "token")


def stream_leak_alert(bodies: DataFrame, vault: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Alerts of a stream of bodies, batch by batch; one that is run again replaces its own alerts and no other."""
    spark, folder = bodies.sparkSession, shared_folder(bodies.sparkSession)
    out = T.StructType([f for f in bodies.schema if f.name != text] + [T.StructField("token", T.StringType())])

    def put(batch: DataFrame, batch_id: int) -> None:
        leak_alerts(batch, vault, key, text).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    bodies.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    spark.createDataFrame([], out).write.mode("overwrite").parquet(f"{folder}/out/batch=-1")
    return spark.read.schema(out).parquet(f"{folder}/out")


def value_references(ops: DataFrame, ttl_s: float = 30.0, late: str = LATEST, step_s: float = 600.0) -> DataFrame:
    """``(reference_id, event_id, result, late)`` for every apply of ``(reference_id, event_id, seq, ts, op, kind, target,
    revision, confirmed)``.

    Operations are taken in the order of ``seq``, which runs with ``ts`` from step to step; what a client's own clock says
    is ``clock``, if there is one: it may run backwards.
    """
    clock = F.unix_micros("clock" if "clock" in ops.columns else "ts")
    return _in_order(ops.withColumn("clock", clock), "reference_id", ValueReferences(ttl_s, step_s), "event_id long, result string", late)


def gate_windows(plans: DataFrame, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    return timed(plans, delay).groupBy(F.window("ts", size), "gate").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "gate", "n")
