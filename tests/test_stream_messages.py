import pandas as pd

from loomspan.streaming.sessions import Fold, Sessions

FOLD = Fold("start double, end double, text string", "start double, end double, n long", "start double, end double, n long", lambda r: (r[0], r[1], 1), lambda s, r: r[0] - s[1] < 1, lambda s, r: (s[0], r[1], s[2] + 1), lambda s: s[1] + 1, lambda s: s)


class State:
    def __init__(self, sent, kind):
        self.sent, self.kind, self.value = sent, kind, None

    def __getattr__(self, name):
        def call(*value):
            self.sent.append(f"{self.kind}.{name}")
            if name in ("put", "update"):
                self.value = value[0]
            if name == "clear":
                self.value = None
            return self.value is not None if name == "exists" else iter(self.value or []) if self.kind == "list" else self.value

        return call


class Handle:
    def __init__(self):
        self.sent, self.timers = [], set()

    def getListState(self, *_):
        return State(self.sent, "list")

    def getValueState(self, *_):
        return State(self.sent, "value")

    def listTimers(self):
        self.sent.append("listTimers")
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.sent.append("registerTimer")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.sent.append("deleteTimer")
        self.timers.discard(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_only_needed_messages_are_sent():
    handle, s = Handle(), Sessions("media", FOLD)
    s.init(handle)
    rows = lambda *r: iter([pd.DataFrame(list(r), columns=["start", "end", "text"])])
    assert list(s.handleInputRows(("k",), rows((5.0, 5.5, None), (6.0, 6.5, "x")), Clock(0))) == []
    assert handle.sent == ["list.exists", "value.exists", "list.put", "registerTimer"] and handle.timers == {5001}
    handle.sent.clear()
    assert list(s.handleInputRows(("k",), rows((9.0, 9.5, "y")), Clock(100))) == []
    assert handle.timers == {5001} and "listTimers" in handle.sent
    handle.timers.clear()
    handle.sent.clear()
    out = list(s.handleExpiredTimer(("k",), Clock(7000), None))
    assert out == [] and handle.timers == {7501} and "listTimers" not in handle.sent
    handle.timers.clear()
    out = [tuple(r) for part in s.handleExpiredTimer(("k",), Clock(20000), None) for r in part.itertuples(index=False)]
    assert out == [("k", 5.0, 6.5, 2), ("k", 9.0, 9.5, 1)] and not handle.timers
    handle.sent.clear()
    list(s.handleInputRows(("k",), rows((30.0, 31.0, "z")), Clock(20000)))
    assert handle.sent == ["list.exists", "value.exists", "list.put", "registerTimer"]
