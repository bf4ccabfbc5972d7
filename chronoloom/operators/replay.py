"""Ordered replay of routed events: one group per (session, core), or per (session, core, block) of a long
session, read as a stream of batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.blocks import BLOCK_ROWS, with_blocks
from chronoloom.operators.registry import executor_registry, route_events_to_cores
from chronoloom.operators.state_maps import Composed, block_maps
from chronoloom.operators.step import Core, Executor, Task
from chronoloom.schemas import REPLAY
from chronoloom.shared import kept

_INPUT = ("session_id", "target_core", "seq", "ts_us", "core_id", "kind", "executor_id", "task_id", "name", "value")
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
_SCHEMA = pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in REPLAY.split(", "))])


def _started(target: int, states: str | None) -> Core:
    core = Core(target)
    for executor, task, x in json.loads(states) if states else ():
        if task is None:
            core.executors[executor] = Executor(*x)
        else:
            core.put_task(executor, task, Task(*x))
    return core


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partitions sorted by (session, target core, block, seq), a block's first row with the states that it
    starts in; the order is asserted."""
    key, core, last = None, None, None
    for batch in batches:
        rows = []
        n = batch.num_rows
        block, states = (batch.column(c).to_pylist() if c in batch.schema.names else [None] * n for c in ("block", "states"))
        for session, target, seq, ts, at, kind, executor, task, name, value, b, start in zip(*(batch.column(c).to_pylist() for c in _INPUT), block, states):
            if (session, target, b) != key:
                key, core, last = (session, target, b), _started(target, start), None
            if kind is None:
                continue
            if last is not None and seq < last:
                raise ValueError(f"events of session {session} arrive out of order: {seq} after {last}")
            last = seq
            for sub, r in enumerate(core.step(kind, at, executor, task, name, value)):
                rows.append(r | {"session_id": session, "seq": seq, "sub": sub, "ts_us": ts, "core_id": target})
        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


_MAPS, _STATES = "session_id long, target_core int, block long, maps string", "session_id long, target_core int, block long, states string"


def _groups(batches: Iterator[pa.RecordBatch], key: tuple[str, ...], columns: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Neighbouring rows of one key; a group is a block of events."""
    now, held = None, []
    for batch in batches:
        for k, row in zip(zip(*(batch.column(c).to_pylist() for c in key)), zip(*(batch.column(c).to_pylist() for c in columns))):
            if k != now and held:
                yield now, held
                held = []
            now = k
            held.append(row)
    if held:
        yield now, held


def _mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (session, core, block), events in _groups(batches, ("session_id", "target_core", "block"), ("kind", "core_id", "executor_id", "task_id")):
        maps = json.dumps([[k, v] for k, v in block_maps(core, events).items()])
        yield pa.RecordBatch.from_arrays([pa.array([session], pa.int64()), pa.array([core], pa.int32()), pa.array([block], pa.int64()), pa.array([maps])], ["session_id", "target_core", "block", "maps"])


def _read_maps(text: str) -> dict[tuple, list[tuple]]:
    state = lambda kind, x: None if x is None else kind(*x)
    return {tuple(k): [(state(Executor if len(k) == 1 else Task, a), state(Executor if len(k) == 1 else Task, b)) for a, b in pairs] for k, pairs in json.loads(text)}


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partitions of maps sorted by (session, core, block): the states that each block starts in."""
    key, at = None, None
    for batch in batches:
        out = []
        for session, core, block, text in zip(*(batch.column(c).to_pylist() for c in ("session_id", "target_core", "block", "maps"))):
            if (session, core) != key:
                key, at = (session, core), Composed(core)
            maps = _read_maps(text)
            out.append((session, core, block, json.dumps(at.start(maps))))
            at.apply(maps)
        types = (pa.int64(), pa.int32(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), (), ()), types)], ["session_id", "target_core", "block", "states"])


def replay(events: DataFrame, executors: DataFrame | None = None) -> DataFrame:
    """Transitions, core switches and metrics with their executors, told apart by ``rec``. One shuffle by
    (session, core), one sort; a task keeps only the state of the core it is in."""
    routed = route_events_to_cores(events, executor_registry(events) if executors is None else executors)
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = routed.repartition(parts, "session_id", "target_core").sortWithinPartitions("session_id", "target_core", "seq")
    return ordered.select(*_INPUT).mapInArrow(_replay, REPLAY)


def replay_in_blocks(events: DataFrame, executors: DataFrame | None = None, most: int = BLOCK_ROWS) -> DataFrame:
    """The rows of ``replay``, with sessions of more than ``most`` events replayed by blocks at the same time.
    First each block becomes maps from states to states (one task a block), then a scan over a core's maps
    gives the states that each block starts in (one task a core, which reads maps and no events), then blocks
    are replayed (one task a block). Shorter sessions are one block and need no maps."""
    blocked = events if "block" in events.columns else with_blocks(events, most)
    known = executor_registry(events) if executors is None else executors
    routed = kept(route_events_to_cores(blocked, known), "routed")
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block, core = ("session_id", "target_core", "block"), ("session_id", "target_core")
    several = routed.filter("blocks > 1").select(*block, "seq", "kind", "core_id", "executor_id", "task_id")
    maps = several.repartition(parts, *block).sortWithinPartitions(*block, "seq").drop("seq").mapInArrow(_mapped, _MAPS)
    states = maps.repartition(parts, *core).sortWithinPartitions(*block).mapInArrow(_scanned, _STATES)
    rows = routed.select(*_INPUT, "block", F.lit(None).cast("string").alias("states")).unionByName(kept(states, "block-states"), allowMissingColumns=True)
    ordered = rows.repartition(parts, *block).sortWithinPartitions(*block, F.col("kind").isNotNull(), "seq")
    return ordered.select(*_INPUT, "block", "states").mapInArrow(_replay, REPLAY)


def executor_transitions(replayed: DataFrame) -> DataFrame:
    rows = replayed.filter("rec = 'executor' AND prev_label IS NOT NULL")
    return rows.select("session_id", "seq", "ts_us", "core_id", "executor_id", "prev_label", "label", "by_executor_id")


def task_transitions(replayed: DataFrame) -> DataFrame:
    rows = replayed.filter("rec = 'task' AND prev_label IS NOT NULL")
    return rows.select("session_id", "seq", "ts_us", "core_id", "executor_id", "task_id", "prev_label", "label", "by_executor_id")


def core_occupancy(replayed: DataFrame) -> DataFrame:
    return replayed.filter("rec = 'core'").select("session_id", "seq", "ts_us", "core_id", "prev_executor_id", "executor_id")


def attribute_metrics(replayed: DataFrame) -> DataFrame:
    return replayed.filter("rec = 'metric'").select("session_id", "seq", "ts_us", "core_id", "name", "value", "pid")


def state_spans(replayed: DataFrame) -> DataFrame:
    """A row per stay in a state; the last of an entity is open."""
    w = Window.partitionBy("session_id", "core_id", "rec", "executor_id", "task_key").orderBy("seq", "sub")
    # an executor's own rows name the task it polls, which is no part of its key
    rows = replayed.filter("rec IN ('executor', 'task')").withColumn("task_key", F.when(F.col("rec") == "task", F.col("task_id")))
    end = F.lead("ts_us").over(w)
    return rows.select(
        "session_id", F.col("rec").alias("track"), "core_id", "executor_id", F.col("task_key").alias("task_id"), F.col("label").alias("name"), "by_executor_id",
        F.col("ts_us").alias("start_us"), end.alias("end_us"), (end - F.col("ts_us")).alias("dur_us"), F.col("seq").alias("start_seq"), F.lead("seq").over(w).alias("end_seq"),
    )


def occupancy_spans(replayed: DataFrame) -> DataFrame:
    """A row per stay of an executor on its core."""
    w = Window.partitionBy("session_id", "core_id").orderBy("seq", "sub")
    rows = replayed.filter("rec = 'core'").withColumn("end_us", F.lead("ts_us").over(w))
    return rows.filter("executor_id IS NOT NULL").select("session_id", "core_id", "executor_id", F.col("ts_us").alias("start_us"), "end_us", (F.col("end_us") - F.col("ts_us")).alias("dur_us"))
