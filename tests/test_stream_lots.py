"""Rows of a stream in lots, and entities that are kept beside their session."""

import json
import random

import pyarrow as pa
import pytest

from chronoloom.schemas import REPLAY, TASK_END
from chronoloom.streaming import trace
from tests.test_stream_order import Session, events, in_order

_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
_LOT_TYPES = ("long", "long", "long", "int", "string", "long", "long", "string", "double", "string")


def lots(rows, size=1000):
    """Lots by session of (session, row)."""
    batches = []
    for at in range(0, len(rows), size):
        some = rows[at : at + size]
        columns = [pa.array([s for s, _ in some], pa.int64())] + [pa.array([r.get(c) for _, r in some], _TYPES[t]) for c, t in zip(trace._LOT, _LOT_TYPES)]
        batches.append(pa.RecordBatch.from_arrays(columns, ["session_id", *trace._LOT]))
    out = {}
    for batch in trace._lots(iter(batches)):
        for row in batch.to_pylist():
            out.setdefault(row["session_id"], []).append(row)
    return out


class Lots(Session):
    def _processor(self):
        processor = trace.Packed(**self.options)
        processor.init(self.handle)
        return processor

    def replayed(self):
        columns = [c.split()[0] for c in REPLAY.split(", ")][1:]
        return [(r["session_id"], *x) for r in self.rows for x in zip(*(r[c] for c in columns))]


@pytest.mark.parametrize("size", (1, 7, 1000))
def test_lots_hold_every_row_of_their_session_in_order(size):
    rng = random.Random(size)
    rows = [(rng.choice((None, 3, -4, 1 << 40)), r) for r in events(200)]
    rows[5] = (rows[5][0], rows[5][1] | {"value": float("inf"), "executor_id": None, "name": None})
    found = lots(rows, size)
    assert set(found) == {s for s, _ in rows}
    for session, held in found.items():
        got = [x for lot in held for x in trace.pickle.loads(lot["rows"])]
        assert got == [tuple(r.get(c) for c in trace._LOT) for s, r in rows if s == session]
    assert size < 1000 or sum(map(len, found.values())) == 4


@pytest.mark.parametrize("near", (0, 2, 64))
def test_lots_replay_as_rows_do(near, monkeypatch):
    """However many entities are kept beside their session."""
    rows = events(300, seed=3)
    want = in_order(rows)
    monkeypatch.setattr(trace, "_NEAR", near)
    monkeypatch.setattr(trace, "_OUT", 5)
    rng = random.Random(near)
    rng.shuffle(rows)
    session = Lots(numbered=True)
    for k in range(10):
        session.at(k).batch(lots([(7, r) for r in rows[30 * k : 30 * k + 30]])[7])
    assert session.replayed() == want and len(want) > 100


def test_a_small_session_is_read_and_written_with_one_entry():
    rows = [r for r in events(200) if r["kind"] != TASK_END]
    session = Session(numbered=False)
    for k in range(0, len(rows), 20):
        session.batch(rows[k : k + 20])
    states = session.handle.states
    assert not states["executors"] and not states["tasks"] and states["tasks"].reads == 0
    assert all(json.loads(states["session"].get()[7]))


def test_ordinary_lines_are_passed_on_whatever_has_been_replayed():
    line = lambda seq: {"seq": seq, "ts_us": seq, "level": "WARN", "name": f"line {seq}"}
    rows = events(20)
    session = Lots(timeline=True).batch(lots([(7, rows[9]), (7, line(5))])[7]).batch(lots([(7, line(3))])[7])
    shown = lambda: [(x[1], x[9], x[12]) for x in session.replayed() if x[5] == "log"]
    assert shown() == [(5, "WARN", "line 5"), (3, "WARN", "line 3")]
    session.at(10**9).batch(lots([(7, line(4)), (7, rows[10])])[7])
    assert shown()[2:] == [(4, "WARN", "line 4")] and session.replayed()[-1][9] == trace.ENDED
