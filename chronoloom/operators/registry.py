"""Entities of a trace: first event of each core, executor and task, and their display names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.parse import display_name, short_symbol
from chronoloom.schemas import METRIC, MONITOR_KINDS, READY_BEGIN
from chronoloom.shared import kept


def _first(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("seq").alias("first_seq"), F.min_by("ts_us", "seq").alias("first_ts_us"))


def core_registry(events: DataFrame) -> DataFrame:
    return _first(events, "session_id", "core_id")


def executor_registry(events: DataFrame) -> DataFrame:
    """A wake-up may come from another core, so it registers no executor."""
    return _first(events.filter((F.col("kind") != READY_BEGIN) & F.col("executor_id").isNotNull()), "session_id", "core_id", "executor_id")


def task_registry(events: DataFrame, executors: DataFrame | None = None) -> DataFrame:
    """The first event, from any core, that names a task of an executor instance that is there already."""
    executors = executor_registry(events) if executors is None else executors
    e = events.filter("task_id IS NOT NULL").select("session_id", "executor_id", "task_id", "seq", "ts_us")
    x = executors.select("session_id", "executor_id", "core_id", "first_seq")
    return _first(e.join(x, ["session_id", "executor_id"]).filter("seq >= first_seq").drop("first_seq"), "session_id", "core_id", "executor_id", "task_id")


def all_registries(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cores, executors and tasks, each made once and kept: they are far smaller than the events and are read
    by routing, naming and metadata."""
    executors = kept(executor_registry(events), "executors")
    return kept(core_registry(events), "cores"), executors, kept(task_registry(events, executors), "tasks")


def load_symbols(df: DataFrame) -> DataFrame:
    """build_id, address, symbol: later symbols of an address win; address 0 and empty names go."""
    return df.filter("address <> 0 AND symbol <> ''").groupBy("build_id", "address").agg(F.max_by("symbol", "ord").alias("symbol"))


def resolve_symbols(registry: DataFrame, symbols: DataFrame, id_col: str, kind: str) -> DataFrame:
    """``registry`` (with build_id) and display_name. Spark broadcasts the symbols while they are small."""
    s = symbols.select("build_id", F.col("address").alias(id_col), short_symbol(F.col("symbol")).alias("_symbol"))
    return registry.join(s, ["build_id", id_col], "left").withColumn("display_name", display_name(F.col("_symbol"), kind, F.col(id_col))).drop("_symbol")


def _routed(events: DataFrame, executors: DataFrame, keys: list[str]) -> DataFrame:
    x = executors.select(*keys, F.col("core_id").alias("target_core"), "first_seq")
    routed = events.join(x, keys).filter("seq >= first_seq").drop("first_seq")
    own = events.filter(F.col("kind").isin(*MONITOR_KINDS, METRIC)).withColumn("target_core", F.col("core_id"))
    return routed.select(*events.columns, "target_core").unionByName(own)


def route_events_to_cores(events: DataFrame, executors: DataFrame) -> DataFrame:
    """Each event and every core that must see it (target_core): where its executor is known by then;
    monitor and metric events go to their own core. Events that ``with_blocks`` has dealt out meet a copy of
    their session's executors in each block, so a long session is joined by as many tasks as it has blocks."""
    if "block" not in events.columns:
        return _routed(events, executors, ["session_id", "executor_id"])
    used = events.filter("executor_id IS NOT NULL").select("session_id", "block", "executor_id").distinct()
    copies = used.join(executors, ["session_id", "executor_id"])
    return _routed(events, copies, ["session_id", "block", "executor_id"])
