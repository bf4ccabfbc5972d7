"""Streaming replay: one stateful processor per session with the state machines of the batch replay.

State is held by entity, as far as there are many: up to ``_NEAR`` executors and as many tasks that have not ended
are kept beside the session and are read and written with it, at once. Of the others a micro-batch reads the
executors and, one by one, the tasks that its events name or that run or are preempted; tasks that have ended are
not read again. It writes what has changed. A session without events for ``idle_ms`` ends and frees its state.

Rows come and go in lots (``Packed``), a row of Spark's for each session's neighbouring rows: the Python worker
takes its input and gives its output cell by cell.

Order. Rows of a micro-batch are ordered by ``seq``; a row below one of an earlier micro-batch is rejected. With
``numbered`` lines (``n`` is 0, 1, 2 ... in each session, as a line counter or a log file gives it) rows may
come in any order: those that come too early wait in the state until the ones before them are there, and are
then released in order. A gap that stays for ``wait_ms`` is given up, and what comes for it later is rejected; with
None it is waited for as long as the session lasts (a backlog that is worked off slowly must lose nothing).
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass
from functools import partial
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chronoloom.operators.step import Core, Executor, Task
from chronoloom.plans.route import parsed, routes
from chronoloom.schemas import MONITOR_KINDS, MONITOR_START, REPLAY

_COLUMNS = [c.split()[0] for c in REPLAY.split(", ")]
_ROW = Row(*_COLUMNS)
#: What a change names, after session_id, seq, sub, ts_us, core_id and rec.
_CHANGE = _COLUMNS[6:]
_EVENT = ("seq", "ts_us", "core_id", "kind", "executor_id", "task_id", "name", "value")
LATE, REPEATED, ENDED, MISSING = "late: a later row was replayed before", "repeated: this number has come before", "late: the session has ended", "missing: given up after the wait"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@dataclass
class _Session:
    """``ahead``: the next number, or the last ``seq``. ``waiting``: rows held back. Times are in ms. ``near``: JSON
    of the executors and tasks that are not in the maps; ``far_executors``, ``far_tasks``: whether there are others."""

    ahead: int = 0
    cores: str = ""
    waiting: int = 0
    gap_until: int | None = None
    seen: int = 0
    timer: int | None = None
    ended: bool = False
    near: str = "[[], []]"
    far_executors: bool = False
    far_tasks: bool = False


_SESSION = "ahead long, cores string, waiting long, gap_until long, seen long, timer long, ended boolean, near string, far_executors boolean, far_tasks boolean"
#: So many executors, and so many tasks, are kept beside their session.
_NEAR = 64


class Replay(StatefulProcessor):
    def __init__(self, numbered: bool = False, wait_ms: int | None = 60_000, idle_ms: int = 86_400_000, timeline: bool = False):
        self.numbered, self.wait_ms, self.idle_ms, self.timeline = numbered, wait_ms, idle_ms, timeline

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", _SESSION)
        self.executors = handle.getMapState("executors", "core_id int, executor_id long", "state string, by long, back string, task long, active string")
        self.tasks = handle.getMapState("tasks", "core_id int, executor_id long, task_id long", "state string, by long")
        self.pending = handle.getMapState("pending", "n long", "seq long, ts_us long, core_id int, kind string, executor_id long, task_id long, name string, value double")

    def _find(self, core: int, executor: int, task: int) -> Task | None:
        x = self.tasks.getValue((core, executor, task)) if self.far_tasks else None
        if x is not None:
            self.held_tasks[core, executor, task] = tuple(x)
        return None if x is None else Task(*x)

    def _open(self) -> tuple[_Session, dict[int, Core]]:
        s = self.session.get()
        session = _Session() if s is None else _Session(*s)
        self.held_executors, self.held_tasks, self.far_tasks = {}, {}, session.far_tasks
        cores = {int(c): self._core(int(c)) for c in session.cores.split(",") if c}
        if cores and not session.ended:
            executors, tasks = json.loads(session.near)
            if session.far_executors:
                for key, x in self.executors.iterator():
                    self.held_executors[tuple(key)] = tuple(x)
                    executors.append((*key, *x))
            for core, executor, *x, active in executors:
                cores[core].executors[executor] = Executor(*x)
                cores[core].active[executor] = {int(t) for t in active.split(",") if t}
            for core, executor, task, *x in tasks:
                cores[core].tasks.setdefault(executor, {})[task] = Task(*x)
        return session, cores

    def _core(self, core: int) -> Core:
        return Core(core, find=partial(self._find, core))

    def _store(self, session: _Session, cores: dict[int, Core], now: int) -> None:
        executors = {(c, i): (*x, ",".join(map(str, sorted(core.active.get(i, ()))))) for c, core in cores.items() for i, x in core.executors.items()}
        session.far_executors = session.far_executors or len(executors) > _NEAR
        if session.far_executors:
            for key, entry in executors.items():
                if self.held_executors.get(key) != entry:
                    self.executors.updateValue(key, entry)
        near: list[tuple] = []
        for key, x in (((c, i, t), x) for c, core in cores.items() for i, tasks in core.tasks.items() for t, x in tasks.items()):
            held = self.held_tasks.get(key)
            if held is None and x.state != "Ended" and len(near) < _NEAR:
                near.append((*key, *x))
            elif held != tuple(x):
                self.tasks.updateValue(key, tuple(x))
                session.far_tasks = True
        session.near = json.dumps([[] if session.far_executors else [(*key, *entry) for key, entry in executors.items()], near])
        session.cores = ",".join(map(str, sorted(cores)))
        due = [x for x in (session.gap_until, None if session.ended else session.seen + self.idle_ms) if x is not None]
        if due and (session.timer is None or min(due) < session.timer):
            session.timer = max(min(due), now + 1)
            self.handle.registerTimer(session.timer)
        self.session.update(astuple(session))

    @staticmethod
    def _row(session_id: int, seq: int | None, **fields) -> tuple:
        out = fields | {"session_id": session_id, "seq": seq}
        return tuple(map(out.get, _COLUMNS))

    def _replayed(self, session_id: int, cores: dict[int, Core], event: tuple) -> Iterator[tuple]:
        seq, ts, at, kind, executor, task, name, value = event
        if kind is None:
            return
        row = partial(self._row, session_id, seq, ts_us=ts)
        if at not in cores:
            if self.timeline:
                yield from (row(sub=0, core_id=at, rec=rec) for rec in (["device"] if not cores else []) + ["new core"])
            cores[at] = self._core(at)
        for core_id in sorted(cores):
            for sub, x in enumerate(cores[core_id].step(kind, at, executor, task, name, value)):
                yield (session_id, seq, sub, ts, core_id, x["rec"], *map(x.get, _CHANGE))
        if self.timeline and kind in MONITOR_KINDS:
            yield row(sub=0, core_id=at, rec="monitor", label="B" if kind == MONITOR_START else "E", name=name)

    def _rejected(self, session_id: int, seq: int | None, reason: str) -> tuple:
        return self._row(session_id, seq, sub=0, rec="reject", label=reason)

    def _in_arrival_order(self, session_id: int, session: _Session, cores: dict[int, Core], events: list[tuple]) -> Iterator[tuple]:
        last = session.ahead
        # a micro-batch of one session is bounded by the source's rate limit
        for _, event in sorted(events, key=lambda e: e[1][0]):
            if event[0] < last:
                yield self._rejected(session_id, event[0], LATE)
            else:
                session.ahead = event[0]
                yield from self._replayed(session_id, cores, event)

    def _released(self, session_id: int, session: _Session, cores: dict[int, Core], fresh: dict[int, tuple]) -> Iterator[tuple]:
        """Replay from the next number on, as far as there is no gap."""
        while True:
            event = fresh.pop(session.ahead, None)
            if event is None and session.waiting:
                event = self.pending.getValue((session.ahead,))
                if event is not None:
                    self.pending.removeKey((session.ahead,))
                    session.waiting -= 1
            if event is None:
                return
            session.ahead += 1
            yield from self._replayed(session_id, cores, tuple(event))

    def _in_order(self, session_id: int, session: _Session, cores: dict[int, Core], events: list[tuple], now: int) -> Iterator[tuple]:
        fresh: dict[int, tuple] = {}
        before = session.ahead
        for n, event in events:
            if n < before:
                yield self._rejected(session_id, event[0], LATE)
            elif n in fresh or (session.waiting and self.pending.containsKey((n,))):
                yield self._rejected(session_id, event[0], REPEATED)
            else:
                fresh[n] = event
        yield from self._released(session_id, session, cores, fresh)
        for n, event in fresh.items():
            self.pending.updateValue((n,), event)
            session.waiting += 1
        if not session.waiting:
            session.gap_until = None
        elif self.wait_ms is not None and (session.gap_until is None or session.ahead > before):
            session.gap_until = now + self.wait_ms

    def _input(self, session_id: int, events: list[tuple], now: int) -> Iterator[tuple]:
        """Replay a micro-batch of (number, event)."""
        session, cores = self._open()
        if session.ended:
            yield from (self._rejected(session_id, event[0], ENDED) for _, event in events)
            return
        session.seen = now
        if self.numbered:
            yield from self._in_order(session_id, session, cores, events, now)
        else:
            yield from self._in_arrival_order(session_id, session, cores, events)
        self._store(session, cores, now)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        events = [(r["n"] if self.numbered else None, tuple(r[c] for c in _EVENT)) for r in rows]
        yield from (_ROW(*x) for x in self._input(key[0], events, timer_values.getCurrentProcessingTimeInMs()))

    def handleExpiredTimer(self, key: tuple, timer_values, expired) -> Iterator[Row]:
        yield from (_ROW(*x) for x in self._expired(key, timer_values))

    def _expired(self, key: tuple, timer_values) -> Iterator[tuple]:
        session, cores = self._open()
        if session.ended:
            return
        now, session.timer = timer_values.getCurrentProcessingTimeInMs(), None
        idle = now >= session.seen + self.idle_ms
        while session.waiting and (idle or (session.gap_until is not None and now >= session.gap_until)):
            first = min(n for (n,) in self.pending.keys())
            yield self._row(key[0], None, sub=0, rec="reject", label=MISSING, name=f"{session.ahead} to {first - 1}")
            session.ahead = first
            yield from self._released(key[0], session, cores, {})
            session.gap_until = now + self.wait_ms if session.waiting and self.wait_ms is not None else None
        if idle:
            # what is left is that the session has been
            for state in (self.executors, self.tasks, self.pending):
                state.clear()
            self.session.update(astuple(_Session(ended=True)))
        else:
            self._store(session, cores, now)

    def close(self) -> None:
        pass


#: Columns of a row in a lot; an ordinary line has its level, and its message as its name.
_LOT = ("n", *_EVENT, "level")
_LOTS = "session_id long, rows binary"
#: Rows of an output row.
_OUT = 2000
_PACKED = "session_id long, " + ", ".join(f"{n} array<{kind}>" for n, kind in (c.split() for c in REPLAY.split(", ")[1:]))
_PACKED_ROW = Row(*_COLUMNS)


def _cells(column: pa.Array) -> list:
    """``to_pylist``, by whole columns."""
    if column.null_count and pa.types.is_floating(column.type):
        found = column.to_numpy(zero_copy_only=False).tolist()
        for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)):
            found[i] = None
        return found
    return column.to_pandas(integer_object_nulls=True).tolist()


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each session of a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        session = batch.column("session_id")
        keys, none = session.fill_null(0).to_numpy(zero_copy_only=False), session.is_null().to_numpy(zero_copy_only=False)
        rows = list(zip(*(_cells(batch.column(c)) for c in _LOT)))
        order = np.lexsort((keys, none))
        if (np.diff(order) != 1).any():
            rows = [rows[i] for i in order]
        starts = np.flatnonzero(np.r_[True, (np.diff(keys[order]) != 0) | (np.diff(none[order]) != 0)])
        ends = [*starts[1:].tolist(), len(rows)]
        yield pa.RecordBatch.from_arrays([session.take(pa.array(order[starts])), pa.array([pickle.dumps(rows[a:b], 5) for a, b in zip(starts.tolist(), ends)], pa.binary())], ["session_id", "rows"])


def _packed(session_id: int, rows: Iterable[tuple]) -> Iterator[Row]:
    for lot in batched(rows, _OUT):
        # tuples, as lists would be copied one by one
        yield _PACKED_ROW(session_id, *tuple(zip(*lot))[1:])


class Packed(Replay):
    """``Replay`` of ``_lots``, whose rows are packed into arrays. With ``timeline`` ordinary lines are passed on,
    whatever their order and whether or not their session has ended."""

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        events, lines = [], []
        for n, seq, ts, at, kind, executor, task, name, value, level in chain.from_iterable(pickle.loads(r["rows"]) for r in rows):
            if kind is not None:
                events.append((n, (seq, ts, at, kind, executor, task, name, value)))
                continue
            if self.timeline and level is not None:
                lines.append(self._row(key[0], seq, sub=0, ts_us=ts, rec="log", label=level, name=name))
            if self.numbered:
                events.append((n, (seq, ts, at, None, executor, task, None, value)))
        replayed = self._input(key[0], events, timer_values.getCurrentProcessingTimeInMs()) if events else ()
        yield from _packed(key[0], chain(lines, replayed))

    def handleExpiredTimer(self, key: tuple, timer_values, expired) -> Iterator[Row]:
        yield from _packed(key[0], self._expired(key, timer_values))


def stream_trace(raw: DataFrame, numbered: bool = False, wait_ms: int | None = 60_000, idle_ms: int = 86_400_000, timeline: bool = False) -> DataFrame:
    """The rows of ``replay`` from a stream of raw_logs, and rows with rec ``reject``; the session needs
    ``use_rocksdb``. ``numbered``: the lines have a number ``n``. ``timeline`` adds rows for new cores, function
    monitors and ordinary lines (rec ``log``), from which ``stream_timeline`` makes records."""
    rows = parsed(raw)
    event, line = F.col("kind").isNotNull(), F.col("kind").isNull() & F.col("reject_reason").isNull()
    if not numbered:
        # every numbered line takes part in the order, whatever it holds
        rows = rows.filter(event | line if timeline else event).withColumn("n", F.lit(None).cast("long"))
    shown = {"level": F.when(line, F.col("level")), "name": F.when(line, F.col("message")).otherwise(F.col("name"))} if timeline else {"level": F.lit(None).cast("string")}
    lots = rows.withColumns(shown).select("session_id", *_LOT).mapInArrow(_lots, _LOTS)
    packed = lots.groupBy("session_id").transformWithState(Packed(numbered, wait_ms, idle_ms, timeline), _PACKED, "Append", "ProcessingTime")
    return packed.select("session_id", F.inline(F.arrays_zip(*_COLUMNS[1:])))


def rejected(replayed: DataFrame) -> DataFrame:
    """session_id, seq, reason, numbers: rows that the stream left out, and the numbers that it gave up (which
    have no ``seq``)."""
    return replayed.filter("rec = 'reject'").select("session_id", "seq", F.col("label").alias("reason"), F.col("name").alias("numbers"))
