"""How often the reorder buffer asks for state, which is a message each time; and its two ways of waiting."""

import pandas as pd
import pytest

from veilspark.streaming import state as T


class Store:
    """A value, list or map of state of one key, which counts what it is asked."""

    calls = 0

    def __init__(self):
        self.now = None

    def __getattribute__(self, name):
        if name != "now" and not name.startswith("_"):
            Store.calls += 1
        return object.__getattribute__(self, name)

    def exists(self):
        return bool(object.__getattribute__(self, "now"))

    def get(self):
        return self.now

    def update(self, value):
        self.now = value

    def clear(self):
        self.now = None

    put = update

    def appendValue(self, value):  # noqa: N802
        self.now = [*(self.now or []), value]

    def containsKey(self, key):  # noqa: N802
        return key in (self.now or {})

    def getValue(self, key):  # noqa: N802
        return self.now[key]

    def updateValue(self, key, value):  # noqa: N802
        self.now = {**(self.now or {}), key: value}

    def removeKey(self, key):  # noqa: N802
        self.now.pop(key)

    def keys(self):
        return iter(list(self.now or {}))

    def iterator(self):
        return iter(list((self.now or {}).items()))


class Handle:
    def __init__(self):
        self.timers = set()

    def getMapState(self, *_):  # noqa: N802
        return Store()

    getListState = getValueState = getMapState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)


class Now:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.at

    getExpiryTimeInMs = getCurrentWatermarkInMs  # noqa: N815


def replay(rule, rows, batches=3, leaps=(200_000, 10**9)):
    handle, out, Store.calls = Handle(), [], 0
    rule.init(handle)
    for k in range(batches):
        out += [r for f in rule.handleInputRows(("k",), iter([pd.DataFrame(rows[k::batches], columns=list(rule.columns))]), Now(0)) for r in f.itertuples(index=False)]
    for passed in leaps:
        while due := sorted(t for t in handle.timers if t <= passed):
            handle.timers.discard(due[0])

            class At(Now):
                pass

            out += [r for f in rule.handleExpiredTimer(("k",), Now(passed), At(due[0])) for r in f.itertuples(index=False)]
    return [tuple(r) for r in out]


ROWS = {
    T.LastActions: [(i * 1_700_000, i, "ab"[i % 2]) for i in range(300)],
    T.StageClock: [(i * 1_700_000, i, "active" if i % 3 == 0 else "done") for i in range(300)],
    T.RunBudget: [(i * 1_700_000, i, i == 200, "ab"[i % 2]) for i in range(300)],
    T.ReplayGuard: [(i * 1_700_000, i, f"n{i % 25}") for i in range(300)],
    T.RateLimiter: [(i * 1_700_000, i) for i in range(300)],
}


@pytest.mark.parametrize("kind", list(ROWS))
def test_steps_together_cost_few_messages(kind, monkeypatch):
    together = replay(kind(step_s=1.0), ROWS[kind])
    assert together and Store.calls < 200  # rows of 300 steps
    monkeypatch.setattr(T, "TOGETHER", 20)
    assert replay(kind(step_s=1.0), ROWS[kind]) == together
