"""Steps of one key of the streaming sessions."""

import numpy as np
import pandas as pd

from wirelens.operators import flows as B
from wirelens.streaming import flows as SF


class _State:
    def __init__(self):
        self.rows, self.timers = [], []

    def getListState(self, name, kind):
        return self

    def exists(self):
        return bool(self.rows)

    def appendList(self, rows):
        self.rows += rows

    put = appendList

    def get(self):
        return iter(self.rows)

    def listTimers(self):
        return iter(())

    def registerTimer(self, at):
        self.timers.append(at)


def _packets(n, seed):
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame({"at": rng.integers(0, 400, n) * 10_000, "length": rng.integers(0, 1500, n), "forward": rng.random(n) < 0.5})
    return rows.assign(**{c: rng.integers(0, 2, n) for c in SF._FLAGS})


def test_rows_that_only_enter_the_state_give_no_frames():
    key = ("a", "b", 1, 2, 6)
    first, second = SF.PacketBuckets(50_000, 1_000_000), SF.OpenSessions(50_000, 1_000_000)
    first.init(_State())
    assert list(first.handleInputRows((*key, 3), iter([_packets(9, 1)]), None)) == []
    assert len(first.packets.rows) == 9 and first.handle.timers == [4000]
    runs = SF.packet_runs(_packets(9, 1), 50_000).rename(columns=SF._PLAIN)
    second.init(_State())
    assert list(second.handleInputRows(key, iter([runs]), None)) == []
    assert len(second.runs.rows) and second.handle.timers


def test_runs_of_one_key_against_plain_loops():
    gap = 50_000
    for seed in range(20):
        packets = _packets(1 + 3 * seed, seed).sort_values("at", kind="stable")
        wanted, held = [], []
        for row in packets.to_dict("records"):
            if held and row["at"] - held[-1]["at"] > gap:
                wanted.append(held)
                held = []
            held.append(row)
        wanted.append(held)
        found = SF.packet_runs(packets.sample(frac=1, random_state=seed), gap)
        assert list(found.columns) == B.RUN and len(found) == len(wanted)
        for (_, run), rows in zip(found.iterrows(), wanted, strict=True):
            sides = {"f": [r["length"] for r in rows if r["forward"]], "b": [r["length"] for r in rows if not r["forward"]]}
            gaps = np.diff([r["at"] for r in rows]).tolist()
            assert (run["_start"], run["_end"], run["_n"]) == (rows[0]["at"], rows[-1]["at"], len(rows))
            for side, values in sides.items():
                assert (run[f"_n{side}"], run[f"_l{side}"]) == (len(values), sum(values))
                assert (run[f"_max_{side}"], run[f"_min_{side}"]) == (max(values), min(values)) if values else run[f"_max_{side}"] is pd.NA
            assert (run["_g_n"], run["_g_sum"]) == (len(gaps), sum(gaps))
            assert (run["_g_max"], run["_g_min"]) == (max(gaps), min(gaps)) if gaps else run["_g_max"] is pd.NA
        # cut anywhere, the runs merge to the same ones
        early = packets["at"] < packets["at"].median()
        parts = [SF.packet_runs(p, gap) for p in (packets[early], packets[~early]) if len(p)]
        pd.testing.assert_frame_equal(SF.merge_runs(pd.concat(parts).sample(frac=1, random_state=seed), gap), found)
