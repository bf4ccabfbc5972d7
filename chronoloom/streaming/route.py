"""Streaming split of raw lines into tables of events, log lines and rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from chronoloom.plans.route import compact, parsed, routes
from chronoloom.shared import kept
from chronoloom.sources.logs import passthrough_parsed

NAMES = ("events", "lines", "rejects")


def stream_route(raw: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start writing ``path``/events, lines and rejects. Each micro-batch is parsed once and replaces its own
    folders ``batch=N``, so one that is run again leaves no row twice."""

    def write(batch: DataFrame, number: int) -> None:
        for name, df in zip(NAMES, routes(kept(compact(parsed(batch)), "routed"))):
            df.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def stream_passthrough(raw: DataFrame) -> DataFrame:
    """session_id, seq, text of the lines that are no events, for any sink (``console`` for a live view)."""
    return passthrough_parsed(parsed(raw))


def stop(query: StreamingQuery) -> None:
    """Finish what has arrived, then stop; the tables hold whole micro-batches only."""
    query.processAllAvailable()
    query.stop()
