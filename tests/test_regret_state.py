"""The step of the regret stream: one state a key and batch, whatever the rows of the batch."""

from __future__ import annotations

import numpy as np
import pandas as pd

from inkling.streaming import jobs


class Held:
    """What the step asks of a group's state, counted."""

    def __init__(self):
        self.value, self.now, self.hasTimedOut, self.updates, self.timeout = None, 0, False, 0, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def getCurrentWatermarkMs(self):
        return self.now

    def update(self, value):
        self.value, self.updates = value, self.updates + 1

    def remove(self):
        self.value = None

    def setTimeoutTimestamp(self, ms):
        assert ms > self.now
        self.timeout = ms


def test_a_batch_reads_and_writes_the_state_of_a_key_once():
    rng = np.random.default_rng(0)
    rows = pd.DataFrame({"label_ts": rng.integers(100, 2000, 5000).astype(float), "err": rng.random(5000), "known": True})
    rows.loc[3, "err"], rows.loc[4, "label_ts"] = None, None
    state, step, got = Held(), jobs._regret("key", 1.5, 10**9), {}
    for k, part in enumerate((rows[:3000], rows[3000:]), 1):
        for out in step((7,), iter([part[:10], part[10:]]), state):
            got |= {r.label_ts: (r.e, r.version) for r in out.itertuples()}
        assert state.updates == k
    want = rows.dropna().groupby("label_ts")["err"].agg(["sum", "size"])
    assert set(got) == set(want.index)
    assert all(abs(got[i][0] - min(1.5, r["sum"])) < 1e-9 and got[i][1] == r["size"] for i, r in want.iterrows())


def test_timeouts_tell_what_falls_due_and_forget_what_is_old():
    state, step = Held(), jobs._regret("key", 9.0, 1000)
    rows = pd.DataFrame({"label_ts": [5, 8], "err": [2.0, 3.0], "known": [True, False]})
    assert [tuple(r) for out in step((1,), iter([rows]), state) for r in out.to_numpy()] == [(1, 5, 2.0, 1)]
    assert state.timeout == 6000
    state.hasTimedOut, state.now = True, 6000
    assert list(step((1,), iter([]), state)) == [] and state.timeout == 8000
    state.now = 8000
    assert [tuple(r) for out in step((1,), iter([]), state) for r in out.to_numpy()] == [(1, 8, 3.0, 1)]
    state.now = 9000
    assert list(step((1,), iter([]), state)) == [] and not state.exists
