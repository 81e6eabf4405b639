"""What the stateful steps hand to their list states: blocks instead of single rows."""

import random
from types import SimpleNamespace

import numpy as np
import pandas as pd

from wirelens.operators import flows as B
from wirelens.streaming import alerts as SA
from wirelens.streaming import flows as SF


class Store:
    """List and value states by name, and the timers of one key."""

    def __init__(self):
        self.lists, self.timers, self.held, self.calls = {}, set(), None, 0

    def getListState(self, name, kind):
        items = self.lists.setdefault(name, [])

        def append(rows):
            self.calls += 1
            items.extend(rows)

        def put(rows):
            self.calls += 1
            items[:] = rows

        return SimpleNamespace(exists=lambda: bool(items), get=lambda: iter(list(items)), appendList=append, put=put,
                               clear=items.clear)

    def getValueState(self, name, kind):
        return SimpleNamespace(exists=lambda: self.held is not None, get=lambda: self.held,
                               update=lambda row: setattr(self, "held", row))

    def listTimers(self):
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def clock(ms):
    return SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)


def test_alerts_enter_the_state_as_blocks():
    draw, store, step, gap = random.Random(4), Store(), SA.CoolingDown(9_000_000), 9_000_000
    step.init(store)
    rows = [(draw.randrange(200) * 500_000, draw.choice(["a", "b", "c", None]), f"row {i}") for i in range(3000)]
    frames = [pd.DataFrame(rows[i:i + 1000], columns=["at", "rank", "row"]).assign(key="k") for i in range(0, 3000, 1000)]
    assert list(step.handleInputRows(("k",), iter(frames), clock(0))) == []
    assert len(store.lists["pending"]) == store.calls == 3 and min(store.timers) == min(r[0] for r in rows) // 1000 + 1
    got = [row for ms in (30_000, 31_000, 60_000, 200_000)
           for frame in step.handleExpiredTimer(("k",), clock(ms), None) for row in frame.itertuples(index=False, name=None)]
    want, last = [], None
    for at in sorted({r[0] for r in rows}):
        if last is None or at - last >= gap:
            last = at
            # of one rank the row that came first stands
            want.append(("k", at, min((r for r in rows if r[0] == at), key=lambda r: (r[1] is None, r[1] or ""))[2]))
    assert got == want and len(want) > 5 and not store.lists["pending"]


def packets(n, seed):
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame({"src_ip": rng.choice(["10.0.0.1", "10.0.0.2", None], n), "dst_ip": "192.168.1.1",
                         "src_port": pd.Series(rng.integers(1, 9, n)).astype(object).where(rng.random(n) < 0.9, None),
                         "dst_port": 80, "protocol": rng.choice([6, 17], n), "at": rng.integers(0, 400, n) * 10_000,
                         "length": rng.integers(0, 1500, n), "forward": rng.random(n) < 0.5})
    return rows.assign(**{c: rng.integers(0, 2, n) for c in SF._FLAGS})


def by_key(frame, columns):
    cells = frame[[*B.FIVE_TUPLE, *columns]].itertuples(index=False)
    return sorted((tuple(None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in row) for row in cells), key=str)


def test_sessions_of_a_shard_are_those_of_its_five_tuples():
    gap, bucket, rows = 50_000, 1_000_000, packets(900, 7)
    first, second, stores = SF.PacketBuckets(gap, bucket), SF.OpenSessions(gap, bucket), {}
    emitted = []
    for number, part in rows.groupby(rows["at"] // bucket):
        store = stores[number] = Store()
        first.init(store)
        frames = [part.iloc[:100], part.iloc[100:]]
        assert list(first.handleInputRows((3, number), iter(frames), None)) == []
        assert store.calls == 2 and store.timers == {(number + 1) * 1000}
        fired = SimpleNamespace(getExpiryTimeInMs=lambda at=(number + 1) * 1000: at)
        emitted += first.handleExpiredTimer((3, number), None, fired)
    assert len(stores) == 4 and [len(frame) for frame in emitted] == [1] * 4
    store = Store()
    second.init(store)
    got = []
    for frame in emitted:
        assert list(second.handleInputRows((3,), iter([frame]), None)) == []
        now = int(frame["passed"].iloc[0].timestamp() * 1000) + 1
        for at in [t for t in store.timers if t <= now]:
            got += second.handleExpiredTimer((3,), clock(now), SimpleNamespace(getExpiryTimeInMs=lambda at=at: at))
    while store.timers:
        at = min(store.timers)
        got += second.handleExpiredTimer((3,), clock(at), SimpleNamespace(getExpiryTimeInMs=lambda at=at: at))
    assert not store.lists["runs"] and len(got) > 1
    want = [SF.packet_runs(part.drop(columns=B.FIVE_TUPLE), gap).assign(**dict(zip(B.FIVE_TUPLE, key, strict=True)))
            for key, part in rows.groupby(B.FIVE_TUPLE, dropna=False)]
    assert len(want) > 20
    assert by_key(pd.concat(got).rename(columns=SF._OWN), B.RUN) == by_key(pd.concat(want), B.RUN)
