"""Timeline records as a stream: what a viewer draws, as it happens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from chronoloom.plans import timeline
from chronoloom.streaming.trace import stream_trace


def stream_timeline(raw: DataFrame, symbols: DataFrame | None = None, build_id: str | Column = "", **options) -> DataFrame:
    """The records of ``trace_events`` from a stream of raw_logs. Each device, core, executor and task is named
    once, by the processor's first sight of it; symbols are a table, joined to the stream. Lines are read and
    parsed once, for events and log instants. ``options`` are those of ``stream_trace``."""
    return timeline.replayed_records(stream_trace(raw, timeline=True, **options), symbols, build_id)
