"""Stateful processors: what must be decided event by event, per key, in the order of event time.

Events come in any order. :class:`Reordered` holds a key's events by steps of event time and decides a step when the
watermark has passed its end, all of its events in order; events of a step that is decided already come out as late.
Times are whole microseconds (``at``), so no processor depends on a session's time zone.
"""

from __future__ import annotations

import pickle
import sys
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SECOND = 1_000_000


#: How many rows of a key wait together; those of a key with more wait by steps.
TOGETHER = 10_000


class Kept:
    """A value, list or map of state that is read once and written once in a call, however often a rule asks it."""

    def __init__(self, state, kind: str):  # noqa: ANN001
        self.state, self.kind = state, kind
        self.known = self.changed = False

    def _read(self):  # noqa: ANN202
        if not self.known:
            there = self.state.exists()
            if self.kind == "map":
                self.was = {tuple(k): tuple(v) for k, v in self.state.iterator()} if there else {}
                self.now = dict(self.was)
            else:
                self.now = None if not there else [tuple(x) for x in self.state.get()] if self.kind == "list" else tuple(self.state.get())
            self.known = True
        return self.now

    def _write(self, value) -> None:  # noqa: ANN001
        self.now, self.known, self.changed = value, True, True

    def exists(self) -> bool:
        return bool(self._read()) if self.kind != "value" else self._read() is not None

    def get(self):  # noqa: ANN201
        return self._read()

    update = put = _write

    def containsKey(self, key: tuple) -> bool:  # noqa: N802
        return key in self._read()

    def updateValue(self, key: tuple, value: tuple) -> None:  # noqa: N802
        self._read()[key] = value
        self.changed = True

    def removeKey(self, key: tuple) -> None:  # noqa: N802
        del self._read()[key]
        self.changed = True

    def iterator(self) -> Iterator[tuple[tuple, tuple]]:
        return iter(list(self._read().items()))

    def clear(self) -> None:
        if self.kind == "map":
            self._read()
        self._write({} if self.kind == "map" else None)

    def flush(self) -> None:
        if self.changed:
            if not self.now:
                self.state.clear()
            elif self.kind == "map":
                for key in self.was.keys() - self.now.keys():
                    self.state.removeKey(key)
                for key, value in self.now.items():
                    if self.was.get(key) != value:
                        self.state.updateValue(key, value)
            else:
                (self.state.put if self.kind == "list" else self.state.update)(self.now)
        self.known = self.changed = False


class Reordered(StatefulProcessor):
    """A reorder buffer: rows that wait for the end of their step of event time, and a timer for a key's earliest step.

    ``columns`` are the input's, of which the first ``order`` are the order of decisions inside a step. A key's rows wait
    together while they are ``TOGETHER`` at most, else in a map of state by their step, so that no more than that, or a
    step's, are in memory. A timer decides all steps that the watermark has passed. What a key knows is forgotten by a
    timer too, a step after the time that a decision asked it to be kept until. State is asked once for each call, for
    every question is a message to another process.
    """

    columns: tuple[str, ...] = ("at", "event_id")
    order = 2
    out: tuple[str, ...] = ()

    def __init__(self, step_s: float):
        self.step = max(1, int(step_s * 1000))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.few = handle.getListState("few", "rows binary")
        self.many = handle.getMapState("many", "step long", "rows binary")
        self.due = Kept(handle.getValueState("due", "step long, n long, many boolean"), "value")
        self.until = Kept(handle.getValueState("until", "at long"), "value")
        self.kept: list[Kept] = [self.due, self.until]
        self.start(handle)

    def keep(self, state, kind: str) -> Kept:  # noqa: ANN001
        self.kept.append(Kept(state, kind))
        return self.kept[-1]

    def start(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def decide(self, key: tuple, rows: list[tuple]) -> tuple[list[tuple], int | None]:
        """What the rows of a step bring out (rows of ``out`` after the key), and until when the state is needed."""
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def expired(self, key: tuple) -> list[tuple]:
        """What comes out when memory is over: nothing, as a rule."""
        return []

    def close(self) -> None:
        pass

    def _frame(self, key: tuple, rows: list[tuple], late: bool) -> pd.DataFrame:
        columns = dict(zip(self.out, zip(*rows, strict=True), strict=True))
        made = {c: pd.array(v, "Int64") if c in ("event_id", "actions", "at") else list(v) for c, v in columns.items()}
        return pd.DataFrame({"key": [key[0]] * len(rows), **made, "late": late})

    def _flush(self) -> None:
        for state in self.kept:
            state.flush()

    def _by_step(self, rows: list[tuple]) -> dict[int, list[tuple]]:
        place, size, steps = self.columns.index("at"), self.step * 1000, {}
        for row in rows:
            steps.setdefault(row[place] // size, []).append(row)
        return steps

    def _together(self) -> list[tuple]:
        return [row for chunk in self.few.get() for row in pickle.loads(chunk[0])] if self.few.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed, size = timerValues.getCurrentWatermarkInMs(), self.step * 1000
        place, event = self.columns.index("at"), self.columns.index("event_id")
        for frame in rows:
            columns = ([None if v is None or v != v else v for v in frame[c].tolist()] for c in self.columns)
            told = list(zip(*columns, strict=True))
            fresh = [r for r in told if (r[place] // size + 1) * self.step > passed]
            if len(fresh) < len(told):
                blank = (None,) * (len(self.out) - 1)
                yield self._frame(key, [(r[event], *blank) for r in told if (r[place] // size + 1) * self.step <= passed], True)
            if fresh:
                self._wait(fresh)
                self._flush()

    def _wait(self, rows: list[tuple]) -> None:
        step, n, many = self.due.get() or (None, 0, False)
        first = min(r[self.columns.index("at")] for r in rows) // (self.step * 1000)
        n += len(rows)
        if not many and n <= TOGETHER:
            self.few.appendValue((pickle.dumps(rows),))
        else:
            if not many:
                rows = self._together() + rows
                self.few.clear()
            for at, own in self._by_step(rows).items():
                if many and self.many.containsKey((at,)):
                    own = pickle.loads(self.many.getValue((at,))[0]) + own
                self.many.updateValue((at,), (pickle.dumps(own),))
            many = True
        if step is None or first < step:
            self.handle.registerTimer((first + 1) * self.step)
            step = first
        self.due.update((step, n, many))

    def _passed(self, passed: int) -> Iterator[tuple[int, list[tuple]]]:
        """The steps that the watermark has passed, in order, with their rows, which wait no more."""
        step, n, many = self.due.get() or (None, 0, False)
        if step is None or (step + 1) * self.step > passed:
            return
        if many:
            held, rest = None, sorted(k[0] for k in self.many.keys())
        else:
            held = self._by_step(self._together())
            rest = sorted(held)
        while rest and (rest[0] + 1) * self.step <= passed:
            at = rest.pop(0)
            if held is None:
                rows = pickle.loads(self.many.getValue((at,))[0])
                self.many.removeKey((at,))
            else:
                rows = held.pop(at)
            n -= len(rows)
            yield at, rows
        if held is not None:
            self.few.clear()
            if held:
                self.few.appendValue((pickle.dumps([r for own in held.values() for r in own]),))
        if rest:
            self.handle.registerTimer((rest[0] + 1) * self.step)
            self.due.update((rest[0], n, many))
        else:
            self.due.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed, out = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()), []
        before = until = self.until.get()[0] if self.until.exists() else None
        for step, rows in self._passed(passed):
            if until is not None and until <= step * self.step + 1:  # where time has leapt, its timer is not yet due
                out += self.expired(key)
                self.forget()
                until = None
            rows.sort(key=lambda r: r[: self.order])
            found, last = self.decide(key, rows)
            out += found
            if last is not None:
                until = max(until or 0, (last // (self.step * 1000) + 1) * self.step + 1)
        if until is not None and until <= passed:
            out += self.expired(key)
            self.forget()
            until = None
        if until != before:
            if until is None:
                self.until.clear()
            else:
                self.until.update((until,))
                self.handle.registerTimer(until)
        self._flush()
        if out:
            yield self._frame(key, out, False)


class LateRows(StatefulProcessor):
    """Marks the rows whose window of event time has closed; they lose their time. It has no state."""

    def __init__(self, size_s: float):
        self.size = int(size_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            late = (frame["at"] // (self.size * 1000) + 1) * self.size <= passed
            ts = pd.to_datetime(frame["at"].where(~late), unit="us").astype("datetime64[ns]")
            rest = frame.drop(columns=["part", "at"])
            yield pd.concat([ts.rename("ts"), rest, late.rename("late")], axis=1)

    def close(self) -> None:
        pass


class RateLimiter(Reordered):
    """A sliding log: at most ``most`` accepted requests in ``window_s`` seconds; refused ones leave no mark."""

    out = ("event_id", "accepted")

    def __init__(self, most: int = 20, window_s: float = 60.0, step_s: float = 600.0):
        super().__init__(step_s)
        self.most, self.window = most, int(window_s * SECOND)

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.log = self.keep(handle.getListState("accepted", "at long"), "list")

    def forget(self) -> None:
        self.log.clear()

    def decide(self, key: tuple, rows: list[tuple]) -> tuple[list[tuple], int | None]:
        log, out = deque(x[0] for x in self.log.get()) if self.log.exists() else deque(), []
        for at, event in rows:
            while log and at - log[0] >= self.window:
                log.popleft()
            out.append((event, len(log) < self.most))
            if out[-1][1]:
                log.append(at)
        self.log.put([(at,) for at in log])
        return out, rows[-1][0] + self.window


class ReplayGuard(Reordered):
    """First use of a nonce within ``window_s`` wins; a full guard refuses rather than forgets.

    Nonces are a map of state, of which only a step's own are read and written; a count and the oldest moment tell when
    a sweep has anything to forget.
    """

    columns, out = ("at", "event_id", "nonce"), ("event_id", "first_use")

    def __init__(self, window_s: float = 600.0, most: int = 10_000, step_s: float = 600.0):
        super().__init__(step_s)
        self.window, self.most = int(window_s * SECOND), most

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.seen = self.keep(handle.getMapState("seen", "nonce string", "at long"), "map")
        self.held = self.keep(handle.getValueState("held", "n long, oldest long"), "value")

    def forget(self) -> None:
        self.seen.clear()
        self.held.clear()

    def swept(self, until: int) -> tuple[int, int | None]:
        """Drop what is older than ``until``; how many are left, and the oldest moment of them."""
        left = []
        for nonce, at in list(self.seen.iterator()):
            if at[0] < until:
                self.seen.removeKey(nonce)
            else:
                left.append(at[0])
        return len(left), min(left, default=None)

    def decide(self, key: tuple, rows: list[tuple]) -> tuple[list[tuple], int | None]:
        n, oldest = self.held.get() if self.held.exists() else (0, None)
        out = []
        for at, event, nonce in rows:
            until = at - self.window
            if oldest is not None and oldest < until:  # a guard whose oldest is within the window has nothing to forget
                n, oldest = self.swept(until)
            first = n < self.most and not self.seen.containsKey((nonce,))
            if first:
                self.seen.updateValue((nonce,), (at,))
                n, oldest = n + 1, at if oldest is None else oldest
            out.append((event, first))
        self.held.update((n, oldest))
        return out, rows[-1][0] + self.window


class RunBudget(Reordered):
    """A run's first terminal status: completed, no progress, too many steps, or past its deadline.

    A run is forgotten a day (``forget_s``) after its last event; one that comes back then is a new run.
    """

    columns, out = ("at", "event_id", "complete", "fingerprint"), ("event_id", "status", "actions")

    def __init__(self, most_steps: int = 8, deadline_s: float = 90.0, no_progress: int = 2, forget_s: float = 86_400.0, step_s: float = 600.0):
        super().__init__(step_s)
        self.most, self.deadline, self.still, self.after = most_steps, int(deadline_s * SECOND), no_progress, int(forget_s * SECOND)

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.run = self.keep(handle.getValueState("run", "started long, last long, actions long, unchanged long, print string, status string"), "value")

    def forget(self) -> None:
        self.run.clear()

    def decide(self, key: tuple, rows: list[tuple]) -> tuple[list[tuple], int | None]:
        fresh = (None, None, 0, 0, None, None)
        started, last, actions, unchanged, seen, status = self.run.get() if self.run.exists() else fresh
        out = []
        for at, event, complete, fingerprint in rows:
            if last is not None and at - last > self.after:
                started, last, actions, unchanged, seen, status = fresh
            started, last = at if started is None else started, at
            if status:
                continue
            if at - started >= self.deadline:
                status = "deadline"
            elif complete:
                status = "completed"
            else:
                if seen is not None:
                    unchanged = unchanged + 1 if fingerprint == seen else 0
                if unchanged >= self.still:
                    status = "no_progress"
                elif actions >= self.most:
                    status = "step_limit"
                else:
                    seen, actions = fingerprint, actions + 1
            if status:
                out.append((event, status, actions))
        self.run.update((started, last, actions, unchanged, seen, status))
        return out, last + self.after


class ValueReferences(Reordered):
    """References that allow one write: issued for a kind, a target and a revision, consumed before use, short-lived.

    A use before the reference was issued, by the ``clock`` of who uses it, or after its time, revokes it.
    """

    columns, order = ("seq", "event_id", "at", "clock", "op", "kind", "target", "revision", "confirmed"), 1
    out = ("event_id", "result")

    def __init__(self, ttl_s: float = 30.0, step_s: float = 600.0):
        super().__init__(step_s)
        self.ttl = int(ttl_s * SECOND)

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.held = self.keep(handle.getValueState("held", "issued long, kind string, target string, revision string"), "value")

    def forget(self) -> None:
        self.held.clear()

    def decide(self, key: tuple, rows: list[tuple]) -> tuple[list[tuple], int | None]:
        held, out = self.held.get() if self.held.exists() else None, []
        for _, event, _, clock, op, *asked, confirmed in rows:
            if op == "issue":
                held = (clock, *asked)
                continue
            if held is not None and not 0 <= clock - held[0] < self.ttl:
                held = None
            fits = held is not None and bool(confirmed) and tuple(held[1:]) == tuple(asked)
            if fits:
                held = None
            out.append((event, "applied" if fits else "denied"))
        if held is None:
            self.held.clear()
            return out, None
        self.held.update(tuple(held))
        return out, held[0] + self.ttl


class LastActions(Reordered):
    """The last ``n`` actions of a key, in order, after each step; forgotten ``forget_s`` after the last one."""

    columns, out = ("at", "event_id", "action"), ("event_id", "at", "history")

    def __init__(self, n: int = 8, forget_s: float = 365 * 86_400.0, step_s: float = 600.0):
        super().__init__(step_s)
        self.n, self.after = n, int(forget_s * SECOND)

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.last = self.keep(handle.getListState("last", "at long, action string"), "list")

    def forget(self) -> None:
        self.last.clear()

    def decide(self, key: tuple, rows: list[tuple]) -> tuple[list[tuple], int | None]:
        last = [tuple(x) for x in self.last.get()] if self.last.exists() else []
        last = [x for x in last if rows[0][0] - x[0] <= self.after]
        last = (last + [(at, action) for at, _, action in rows])[-self.n :]
        self.last.put(last)
        at, event, _ = rows[-1]
        return [(event, at, ",".join(a for _, a in last if a is not None))], at + self.after


class StageClock(Reordered):
    """Time from a stage's ``active`` to its next other status. A stage that has none ``timeout_s`` after its start comes
    out with a reason and without a time, by a timer, even if no event follows; what comes later ends nothing."""

    columns, out = ("at", "event_id", "status"), ("event_id", "at", "ms", "reason")

    def __init__(self, timeout_s: float = 3600.0, step_s: float = 600.0):
        super().__init__(step_s)
        self.timeout = int(timeout_s * SECOND)

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.active = self.keep(handle.getValueState("active", "event_id long, at long"), "value")

    def forget(self) -> None:
        self.active.clear()

    def _unended(self, active: tuple) -> tuple:
        return active[0], active[1], None, "stage did not end"

    def decide(self, key: tuple, rows: list[tuple]) -> tuple[list[tuple], int | None]:
        active, out = self.active.get() if self.active.exists() else None, []
        for at, event, status in rows:
            if active is not None:
                if status == "active" or at - active[1] > self.timeout:
                    out.append(self._unended(active))
                else:
                    out.append((active[0], active[1], (at - active[1]) / 1000.0, None))
            active = (event, at) if status == "active" else None
        if active is None:
            self.active.clear()
            return out, None
        self.active.update(active)
        return out, active[1] + self.timeout

    def expired(self, key: tuple) -> list[tuple]:
        return [self._unended(self.active.get())] if self.active.exists() else []
