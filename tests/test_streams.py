"""Stateful streams against the same rules replayed over sorted rows, in one batch and in several."""

import time
from datetime import datetime, timedelta

import pytest

from veilspark.streaming import streams as H

T0 = datetime(2024, 1, 1)


def rows(n, step):
    return [(i % 3, i, T0 + timedelta(seconds=step * (i if i % 10 else i + 3))) for i in range(n)]


@pytest.fixture
def folder(spark, tmp_path):
    def put(data, schema, files):
        for k in range(files):
            spark.createDataFrame(data[k::files] if files == 1 else data[k * len(data) // files : (k + 1) * len(data) // files], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in.parquet")
        return f"file://{tmp_path}/in.parquet"

    return put


def test_rate_limit(spark, folder):
    data = rows(240, 1.0)
    path = folder(data, "user_id long, event_id long, ts timestamp", 1)
    stream = H.read_table(spark, path, spark.read.parquet(path).schema)
    got = {r.event_id: r.accepted for r in H.run_available(H.rate_limit(stream, most=5, window_s=30)).collect()}
    want, logs = {}, {}
    for user, event, ts in sorted(data, key=lambda r: (r[2], r[1])):
        log = [t for t in logs.get(user, []) if ts - t < timedelta(seconds=30)]
        want[event] = len(log) < 5
        logs[user] = log + [ts] if want[event] else log
    assert got == want and False in want.values()


def test_state_lives_between_batches(spark, folder):
    data = [(1, i, T0 + timedelta(seconds=i)) for i in range(30)]
    path = folder(data, "user_id long, event_id long, ts timestamp", 3)
    stream = H.read_table(spark, path, spark.read.parquet(path).schema, files_per_batch=1)
    got = sorted(r.event_id for r in H.run_available(H.rate_limit(stream, most=4, window_s=1000)).where("accepted").collect())
    assert got == [0, 1, 2, 3]


def test_replay_guard_refuses_when_full(spark, folder):
    data = [(1, i, f"n{i % 6}", T0 + timedelta(seconds=i)) for i in range(40)]
    path = folder(data, "scope long, event_id long, nonce string, ts timestamp", 1)
    stream = H.read_table(spark, path, spark.read.parquet(path).schema)
    got = {r.event_id: r.first_use for r in H.run_available(H.replay_guard(stream, window_s=15, most=4)).collect()}
    want, seen = {}, {}
    for _, event, nonce, ts in data:
        first = next(iter(seen.values()), None)
        if len(seen) >= 4 or (first is not None and first < ts - timedelta(seconds=15)):
            seen = {n: t for n, t in seen.items() if t >= ts - timedelta(seconds=15)}
        want[event] = len(seen) < 4 and nonce not in seen
        if want[event]:
            seen[nonce] = ts
    assert got == want


def test_run_budget(spark, folder):
    runs = {1: [("a", False)] * 4, 2: [(str(i), False) for i in range(12)], 3: [("a", False), ("b", True)], 4: [("a", False), ("b", False)]}
    data = [(r, 100 * r + i, T0 + timedelta(seconds=i * (60 if r == 4 else 1)), c, f) for r, steps in runs.items() for i, (f, c) in enumerate(steps)]
    data.append((4, 450, T0 + timedelta(seconds=200), False, "c"))
    path = folder(data, "run_id long, event_id long, ts timestamp, complete boolean, fingerprint string", 1)
    got = {r.run_id: (r.status, r.actions) for r in H.run_available(H.run_budget(H.read_table(spark, path, spark.read.parquet(path).schema))).collect()}
    assert got == {1: ("no_progress", 2), 2: ("step_limit", 8), 3: ("completed", 1), 4: ("deadline", 2)}


def test_references_are_used_once(spark, folder):
    op = lambda i, op, s, **k: (1, i, i, T0 + timedelta(seconds=s), op, k.get("kind", "email"), k.get("target", "#a"), "r", k.get("confirmed", True))
    data = [op(0, "issue", 0), op(1, "apply", 1, kind="phone"), op(2, "apply", 2), op(3, "apply", 3), op(4, "issue", 10), op(5, "apply", 11, confirmed=False), op(6, "apply", 50), op(7, "issue", 60), op(8, "apply", 58), op(9, "apply", 61)]
    path = folder(data, "reference_id long, event_id long, seq long, ts timestamp, op string, kind string, target string, revision string, confirmed boolean", 1)
    got = {r.event_id: r.result for r in H.run_available(H.value_references(H.read_table(spark, path, spark.read.parquet(path).schema))).collect()}
    assert got == {1: "denied", 2: "applied", 3: "denied", 5: "denied", 6: "denied", 8: "denied", 9: "denied"}


def test_stage_durations(spark):
    e = [(1, "s", "active", T0, 0), (1, "s", "done", T0 + timedelta(seconds=2), 1), (1, "s", "active", T0 + timedelta(seconds=5), 2), (1, "s", "error", T0 + timedelta(seconds=6), 3), (1, "t", "active", T0, 4)]
    got = {r.stage: (r.ms, r.reason) for r in H.stage_durations(spark.createDataFrame(e, "run long, stage string, status string, ts timestamp, event_id long"), "run").collect()}
    assert got == {"s": (3000.0, None), "t": (None, "stage did not end")}


def test_state_expires_with_event_time(spark, folder):
    """Keys that event time has left behind hold no state; a late use of an old nonce is a new one only then."""
    data = [(k, k, f"n{k}", T0 + timedelta(seconds=k)) for k in range(20)] + [(99, 100 + i, "x", T0 + timedelta(days=1 + i)) for i in range(3)]
    data.append((98, 200, "y", T0 + timedelta(days=5)))  # the time goes on, and this one waits for its own
    parts = [data[:20], data[20:21], data[21:22], data[22:23], data[23:]]
    path = None
    for part in parts:
        path = folder(part, "scope long, event_id long, nonce string, ts timestamp", 1)
    stream = H.read_table(spark, path, spark.read.parquet(path).schema, files_per_batch=1)
    out = H.replay_guard(stream, window_s=60.0)
    with H._rocksdb(spark):
        where = H.shared_folder(spark)
        job = out.writeStream.option("checkpointLocation", f"{where}/c").trigger(availableNow=True).format("parquet").start(f"{where}/out")
        job.awaitTermination()
        last = job.recentProgress[-1]["stateOperators"][0]
    assert spark.read.parquet(f"{where}/out").where("first_use").count() == 23
    assert last["numRowsTotal"] <= 6  # what one key waits with, and timers


def test_events_in_any_order_and_late_ones(spark, folder):
    """Ten-minute steps with an hour's patience: what comes in the wrong order is decided in the right one; what comes
    after its step was decided, or has no time, is told to be late."""
    at = lambda m: T0 + timedelta(minutes=m)
    batches = [[(1, 1, at(20)), (1, 2, at(5))], [(1, 3, at(0)), (1, 4, at(1000))], [(1, 5, at(3)), (2, 6, at(4)), (1, 7, None)], [(1, 8, at(990))]]
    path = None
    for rows in batches:
        path = folder(rows, "user_id long, event_id long, ts timestamp", 1)
        time.sleep(0.05)  # files are taken by their time
    stream = H.read_table(spark, path, spark.read.parquet(path).schema, files_per_batch=1)
    out = H.run_available(H.rate_limit(stream, most=2, window_s=3600))
    got = {r.event_id: (r.accepted, r.late) for r in out.collect()}
    assert got == {3: (True, False), 2: (True, False), 1: (False, False), 4: (True, False), 8: (True, False), 5: (None, True), 6: (None, True), 7: (None, True)}
    assert {r.late: r.n for r in H.late_counts(out).collect()} == {True: 3, False: 5}


def test_stage_clock_tells_of_stages_that_never_end(spark, folder):
    data = [("a", 1, T0, "active"), ("a", 2, T0 + timedelta(minutes=1), "done"), ("b", 3, T0, "active"), ("c", 4, T0, "active"), ("c", 5, T0 + timedelta(hours=3), "done"), ("d", 6, T0, "active"), ("d", 7, T0 + timedelta(minutes=2), "active"), ("d", 8, T0 + timedelta(minutes=3), "error"), ("e", 9, T0, "done")]
    path = folder(data, "stage string, event_id long, ts timestamp, status string", 1)
    got = {r.event_id: (r.ms, r.reason) for r in H.run_available(H.stage_clock(H.read_table(spark, path, spark.read.parquet(path).schema), "stage")).collect()}
    none = (None, "stage did not end")
    assert got == {1: (60_000.0, None), 3: none, 4: none, 6: none, 7: (60_000.0, None)}


def test_a_run_from_a_table(spark):
    runs = {1: ["a"] * 4, 2: [str(i) for i in range(12)], 3: ["a", "b", "b", "a"], 5: [None] * 9}
    data = [(r, 100 * r + i, T0 + timedelta(seconds=i), r == 3 and i == 3, f) for r, marks in runs.items() for i, f in enumerate(marks)]
    data += [(4, 400, T0, False, "a"), (4, 401, T0 + timedelta(seconds=95), True, "a"), (6, 600, T0, None, "a")]
    df = spark.createDataFrame(data, "run_id long, event_id long, ts timestamp, complete boolean, fingerprint string")
    got = {r.run_id: (r.event_id, r.status, r.actions) for r in H.run_budget_table(df).collect()}
    assert got == {1: (102, "no_progress", 2), 2: (208, "step_limit", 8), 3: (303, "completed", 3), 4: (401, "deadline", 1), 5: (508, "step_limit", 8)}


def test_windows_and_late_rows_make_up_the_input(spark, folder):
    at = lambda m: T0 + timedelta(minutes=m)
    path = None
    for rows in ([(1, at(5), "a", 1.0), (2, at(200), "a", 2.0)], [(3, at(10), "a", 3.0), (4, at(190), "b", 4.0)], [(5, at(201), "a", 5.0), (6, at(20), "b", 6.0)]):
        path = folder(rows, "event_id long, ts timestamp, kind string, ms double", 1)
        time.sleep(0.05)
    stream = H.split_late(H.read_table(spark, path, spark.read.parquet(path).schema, files_per_batch=1), 3600.0, late="10 minutes")
    out, seen = H.run_counted(H.audit_windows(stream.where("NOT late"), "kind"))
    assert sorted((r.kind, r.n, r.max_ms) for r in out.collect()) == [("a", 1, 1.0), ("a", 2, 5.0), ("b", 1, 4.0)] and seen == {"n": 6, "n_late": 2}
