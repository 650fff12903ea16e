"""The state of the streaming ratings: few accesses, whatever the number of matches, and the same ratings as one fold."""

import random

import pandas as pd

from touchline.operators.ratings import LeagueFold
from touchline.streaming.ratings_stream import DAY_MS, DayByDay


class Held:
    """A value or map state, or the handle and the timers, which count accesses."""

    def __init__(self):
        self.values, self.value, self.uses, self.timers, self.states, self.mark = {}, None, 0, set(), [], 0

    def getMapState(self, name, *kinds):  # noqa: N802
        self.states.append(Held())
        return self.states[-1]

    getValueState = getMapState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.mark

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.mark

    def _used(self, found):
        self.uses += 1
        return found

    exists = lambda self: self._used(self.value is not None)
    get = lambda self: self._used(self.value)
    update = lambda self, value: self._used(setattr(self, "value", value))
    keys = lambda self: self._used(list(self.values))
    iterator = lambda self: iter(self._used(list(self.values.items())))
    getValue = lambda self, key: self._used(self.values[key])  # noqa: E731, N815
    updateValue = lambda self, key, value: self._used(self.values.update({key: value}))  # noqa: E731, N815
    removeKey = lambda self, key: self._used(self.values.pop(key))  # noqa: E731, N815


def test_state_is_used_by_day(monkeypatch):
    rng = random.Random(1)
    rows = [(d, True, 1000 * d + i, *rng.sample(range(9), 2), float(rng.randrange(5)), float(rng.randrange(5))) for d in range(30) for i in range(40)]
    frame = pd.DataFrame(rows, columns=["day", "counts", "match_id", "home_team", "away_team", "home_goals", "away_goals"])
    shuffled = frame.sample(frac=1, random_state=2)
    handle = Held()
    processor = DayByDay(50.0, 80.0)
    processor.init(handle)
    list(processor.handleInputRows(("x",), iter([shuffled[:700], shuffled[700:], shuffled[:50]]), handle))  # 50 come twice
    found, fired = [], 0
    for handle.mark in (10 * DAY_MS, 40 * DAY_MS):
        for at in sorted(t for t in handle.timers if t <= handle.mark):
            handle.timers.discard(at)
            fired += 1
            found += [r for out in processor.handleExpiredTimer(("x",), handle, handle) for r in out.itertuples(index=False)]
    fold = LeagueFold(50.0, 80.0)
    assert [tuple(r) for r in found] == [(i, "x", d, *fold.match(d, h, a, x, y), False) for d, _, i, h, a, x, y in sorted(rows)]
    assert fired == 2 and sum(s.uses for s in handle.states) < 200  # a match each before: 1,250 in, 1,200 out
    (late,) = [out for out in processor.handleInputRows(("x",), iter([shuffled[:5]]), handle)]
    assert late.is_late.all() and len(late) == 5
