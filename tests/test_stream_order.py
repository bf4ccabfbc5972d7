"""The streaming replay's order, timers and rejects, micro-batch by micro-batch, against the rows in order."""

import random

import pytest

from chronoloom.schemas import EXEC_BEGIN, EXEC_END, IDLE, METRIC, POLL_START, READY_BEGIN, TASK_END, TASK_NEW
from chronoloom.streaming import trace

WAIT, IDLE_MS = 1000, 50_000


class Value:
    def __init__(self):
        self.held = None

    def get(self):
        return self.held

    def update(self, value):
        self.held = tuple(value)

    def clear(self):
        self.held = None


class Map(dict):
    """Counts the entries that are read one by one."""

    reads = 0

    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        self.reads += 1
        return self.get(key)

    def updateValue(self, key, value):
        self[tuple(key)] = tuple(value)

    def removeKey(self, key):
        self.pop(key, None)

    def iterator(self):
        return iter(list(self.items()))


class Handle:
    """State of one session in memory."""

    def __init__(self):
        self.states, self.timers = {}, []

    def getValueState(self, name, schema):
        return self.states.setdefault(name, Value())

    def getMapState(self, name, *schemas):
        return self.states.setdefault(name, Map())

    def registerTimer(self, at):
        self.timers.append(at)


class Session:
    """One session's stream; every micro-batch has a new processor over the same state, as after a restart."""

    def __init__(self, **options):
        self.handle, self.options, self.now, self.rows = Handle(), {"wait_ms": WAIT, "idle_ms": IDLE_MS} | options, 0, []

    def _processor(self):
        processor = trace.Replay(**self.options)
        processor.init(self.handle)
        return processor

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def batch(self, events):
        self.rows += self._processor().handleInputRows((7,), iter(events), self)
        return self

    def at(self, now):
        """Time passes; timers that are due fire."""
        self.now = now
        due, self.handle.timers = [t for t in self.handle.timers if t <= now], [t for t in self.handle.timers if t > now]
        for _ in due:
            self.rows += self._processor().handleExpiredTimer((7,), self, None)
        return self

    def replayed(self):
        return [tuple(r) for r in self.rows if r["rec"] != "reject"]

    def rejected(self):
        return [(r["seq"], r["label"], r["name"]) for r in self.rows if r["rec"] == "reject"]


def events(n=60, seed=0):
    """Numbered rows of two cores; every seventh is an ordinary line, which has no kind."""
    rng = random.Random(seed)
    kinds = [POLL_START, IDLE, READY_BEGIN, EXEC_BEGIN, EXEC_END, TASK_NEW, TASK_END, METRIC]
    out = []
    for i in range(n):
        kind = None if i % 7 == 6 else rng.choice(kinds)
        out.append({"n": i, "seq": 10 * i, "ts_us": 100 * i, "core_id": rng.randrange(2), "kind": kind, "executor_id": rng.randrange(1, 4), "task_id": rng.randrange(1, 4), "name": "m", "value": float(i)})
    return out


def in_order(rows, **options):
    return Session(numbered=True, **options).batch(rows).replayed()


@pytest.mark.parametrize("seed", range(20))
def test_any_permutation_over_ten_micro_batches(seed):
    rows, rng = events(seed=seed), random.Random(seed)
    want = in_order(rows)
    rng.shuffle(rows)
    session = Session(numbered=True)
    for k in range(10):
        session.at(k).batch(rows[6 * k : 6 * k + 6])
    assert session.replayed() == want and len(want) > 20 and session.rejected() == []
    assert not session.handle.states["pending"]


def test_a_gap_is_given_up_after_the_wait():
    rows = events()
    session = Session(numbered=True).batch(rows[:20]).at(10).batch(rows[23:40])
    assert session.replayed() == in_order(rows[:20])
    # neither before the wait, nor where other rows come meanwhile
    session.at(WAIT - 1).batch(rows[40:50])
    assert session.rejected() == []
    session.at(WAIT + 10)
    assert session.rejected() == [(None, trace.MISSING, "20 to 22")]
    # as if the missing lines had held no event
    assert session.replayed() == in_order(rows[:20] + [rows[i] | {"kind": None} for i in (20, 21, 22)] + rows[23:50])
    session.batch(rows[22:23])
    assert session.rejected()[1:] == [(220, trace.LATE, None)]


def test_gaps_are_given_up_one_after_another():
    rows = events()
    session = Session(numbered=True).batch(rows[:5] + rows[6:8] + rows[9:])
    session.at(WAIT)
    assert session.rejected() == [(None, trace.MISSING, "5 to 5")]
    session.at(2 * WAIT)
    assert session.rejected()[1:] == [(None, trace.MISSING, "8 to 8")]
    assert session.replayed() == in_order([r | {"kind": None} if r["n"] in (5, 8) else r for r in rows])


def test_a_gap_that_closes_in_time():
    rows = events()
    session = Session(numbered=True).batch(rows[:10] + rows[11:]).at(WAIT - 1).batch(rows[10:11]).at(5 * WAIT)
    assert session.rejected() == [] and session.replayed() == in_order(rows)


def test_repeated_numbers_are_rejected():
    rows = events()
    session = Session(numbered=True).batch(rows[:10] + rows[12:15] + rows[13:14]).batch(rows[12:13]).batch(rows[3:4])
    assert session.rejected() == [(130, trace.REPEATED, None), (120, trace.REPEATED, None), (30, trace.LATE, None)]
    assert session.batch(rows[10:12] + rows[15:]).replayed() == in_order(rows)


def test_an_idle_session_ends_and_frees_its_state():
    rows = events()
    session = Session(numbered=True).batch(rows[:30] + rows[31:40]).at(IDLE_MS - 1)
    assert [x[1] for x in session.rejected()] == [trace.MISSING]
    session.batch(rows[40:50]).at(IDLE_MS)
    assert session.batch(rows[50:55]).rejected()[1:] == []
    session.at(2 * IDLE_MS).batch(rows[55:56])
    assert session.rejected()[1:] == [(550, trace.ENDED, None)]
    assert not any(session.handle.states[s] for s in ("executors", "tasks", "pending"))


def test_without_numbers_a_late_row_is_rejected():
    rows = events()
    session = Session().batch(rows[:20][::-1]).batch(rows[25:]).batch(rows[20:25])
    assert session.rejected() == [(10 * i, trace.LATE, None) for i in range(20, 25)]
    assert session.replayed() == Session().batch(rows[:20] + rows[25:]).replayed()


def test_reads_do_not_grow_with_ended_tasks():
    """A micro-batch of few events after many tasks that have ended."""
    event = lambda i, kind, task: {"n": i, "seq": i, "ts_us": i, "core_id": 0, "kind": kind, "executor_id": 1, "task_id": task, "name": None, "value": None}
    reads = []
    for ended in (10, 1000):
        rows = [event(0, POLL_START, None)]
        for t in range(1, ended + 1):
            rows += [event(len(rows) + k, kind, t) for k, kind in enumerate((TASK_NEW, READY_BEGIN, EXEC_BEGIN, TASK_END))]
        session = Session(numbered=True).batch(rows)
        tasks = session.handle.states["tasks"]
        assert len(tasks) >= ended
        tasks.reads = 0
        n = len(rows)
        session.batch([event(n, READY_BEGIN, 5000), event(n + 1, EXEC_BEGIN, 5000), event(n + 2, EXEC_END, 5000)])
        reads.append(tasks.reads)
    assert reads[0] == reads[1] <= 10
