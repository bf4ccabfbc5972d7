"""Raw lines to typed events, ordinary log lines and rejects. All of it is narrow and streams as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.parse import after_last, bound, normal_level, param, parse_params, real, seconds_text, seconds_to_micros, strip, unpadded, unsigned, value
from chronoloom.schemas import EXECUTOR_KINDS, KINDS, METRIC, MONITOR_KINDS, TASK_KINDS

_FIELDS = ("core_id", "kind", "executor_id", "task_id", "name", "value")


def parse_log_lines(raw: DataFrame) -> DataFrame:
    """``raw`` with ts_us, level, message, and reject_reason where the line is none."""
    line, opened, closed = F.col("line"), F.col("_open"), F.col("_close")
    rows = bound(raw, _open=F.instr(line, "["), _close=F.instr(line, "]"))
    wrong = (
        F.when(line.isNull(), "no line")
        .when(opened == 0, "no opening bracket")
        .when(closed == 0, "no closing bracket")
        .when(closed - opened < 3, "no level between brackets")
    )
    rows = bound(rows, _wrong=wrong, _stamp=strip(F.substring(line, F.lit(1), opened - 1)), _level=strip(F.substring(line, opened + 1, closed - opened - 1)))
    fine = F.col("_wrong").isNull()
    rows = bound(rows, _seconds=F.when(fine, real(F.col("_stamp"))), _known=F.when(fine, normal_level(F.col("_level"))))
    us = seconds_to_micros(F.col("_seconds"))
    reason = F.coalesce(F.col("_wrong"), F.when(F.col("_known").isNull(), "unknown level").when(F.col("_seconds").isNull(), "bad timestamp").when(us.isNull(), "timestamp out of range"))
    rows = bound(rows, ts_us=us, reject_reason=reason, _text=F.trim(F.substring(line, closed + 1, F.length(line))))
    good = F.col("reject_reason").isNull()
    message = unpadded(F.col("_text"))
    return rows.select(*raw.columns, F.when(good, F.col("ts_us")).alias("ts_us"), F.when(good, F.col("_known")).alias("level"), F.when(good, message).alias("message"), "reject_reason")


def decode_events(lines: DataFrame) -> DataFrame:
    """Log lines with params, core_id, kind, executor_id, task_id, name, value (kind is null for an
    ordinary line) and event_parse_error for text that starts like an event but is none."""
    rows = bound(lines, _message=F.col("message"))
    rows = bound(rows, _event=F.coalesce(F.startswith("_message", F.lit("@")), F.lit(False)), _open=F.instr("_message", "("), _close=F.instr("_message", ")"))
    called = F.col("_event") & (F.col("_open") > 0) & (F.col("_close") > F.col("_open"))
    message, opened = F.col("_message"), F.col("_open")
    rows = bound(rows, _kind=F.when(called, strip(F.substring(message, F.lit(2), opened - 2))), _args=F.when(called, F.substring(message, opened + 1, F.col("_close") - opened - 1)))
    kind, args = F.col("_kind"), F.col("_args")
    known, carries_task, carries_executor = kind.isin(*KINDS), kind.isin(*TASK_KINDS), kind.isin(*TASK_KINDS, *EXECUTOR_KINDS)
    named, measured = kind.isin(*MONITOR_KINDS, METRIC), kind == METRIC
    used = {"core": ("core_id", known), "executor": ("executor_id", carries_executor), "task": ("task_id", carries_task), "function": ("function_name", kind.isin(*MONITOR_KINDS)), "metric": ("name", measured), "value": ("value", measured)}
    rows = bound(rows, **{f"_{n}_last": F.when(of, after_last(args, key)) for n, (key, of) in used.items()})
    found = {n: F.when(of, param(args, key, F.col(f"_{n}_last"))) for n, (key, of) in used.items()}
    found["name"] = F.when(measured, found.pop("metric")).otherwise(found.pop("function"))
    rows = bound(rows, **{f"_{n}_text": c for n, c in found.items()})
    rows = bound(rows, **{f"_{n}": value(F.col(f"_{n}_text")) for n in ("core", "executor", "task", "name", "value")})
    rows = bound(rows, _core_id=unsigned(F.col("_core"), 8).cast("int"), _executor_id=unsigned(F.col("_executor"), 32), _task_id=unsigned(F.col("_task"), 32), _number=real(F.col("_value")))
    error = (
        F.when(~F.col("_event"), F.lit(None).cast("string"))
        .when(kind.isNull(), "no call")
        .when(~known, "unknown kind")
        .when(F.col("_core_id").isNull(), "bad core_id")
        .when(carries_executor & F.col("_executor_id").isNull(), "bad executor_id")
        .when(carries_task & F.col("_task_id").isNull(), "bad task_id")
        .when(named & F.col("_name").isNull(), "no name")
        .when(measured & F.col("_number").isNull(), "bad value")
    )
    rows = bound(rows, event_parse_error=error)
    good = F.col("_event") & F.col("event_parse_error").isNull()
    typed = (F.when(good, F.col(c)).alias(n) for n, c in zip(_FIELDS, ("_core_id", "_kind", "_executor_id", "_task_id", "_name", "_number")))
    return rows.select(*lines.columns, parse_params(args).alias("params"), *typed, "event_parse_error")


def parsed(raw: DataFrame) -> DataFrame:
    return decode_events(parse_log_lines(raw))


def compact(rows: DataFrame) -> DataFrame:
    """Parsed rows for writing: the line is left to rejects, the message to ordinary lines. ``routes`` of them
    are the same."""
    return rows.drop("params").withColumns({"line": F.when(F.col("reject_reason").isNotNull(), F.col("line")), "message": F.when(F.col("kind").isNull(), F.col("message"))})


def routes(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(log_events, log_lines, rejects) of parsed rows."""
    events = rows.filter("kind IS NOT NULL").select("session_id", "seq", "ts_us", *_FIELDS)
    lines = rows.filter("kind IS NULL AND reject_reason IS NULL").select("session_id", "seq", "ts_us", "level", "message", "event_parse_error")
    rejects = rows.filter("reject_reason IS NOT NULL").select("session_id", "seq", "line", F.col("reject_reason").alias("reason"))
    return events, lines, rejects


def route_lines(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(log_events, log_lines, rejects) of raw lines; where several are read, write ``parsed`` first."""
    return routes(parsed(raw))


def render_message(kind: Column) -> Column:
    """Wire text of an event row; the inverse of ``decode_events``."""

    def text(*parts) -> Column:
        shown = (F.lit(x) if isinstance(x, str) else F.coalesce(x.cast("string"), F.lit("null")) for x in parts)
        return F.concat(F.lit("@"), F.coalesce(kind, F.lit("null")), *shown, F.lit(")"))

    executor_id, core_id, task_id, name = (F.col(c) for c in ("executor_id", "core_id", "task_id", "name"))
    task = text("(executor_id=", executor_id, ", core_id=", core_id, ", task_id=", task_id)
    executor = text("(executor_id=", executor_id, ", core_id=", core_id)
    monitor = text("(function_name=", name, ",core_id=", core_id)
    metric = text("(name=", name, ",value=", F.col("value"), ",core_id=", core_id)
    return F.when(kind.isin(*TASK_KINDS), task).when(kind.isin(*EXECUTOR_KINDS), executor).when(kind.isin(*MONITOR_KINDS), monitor).otherwise(metric)


def render_event_lines(events: DataFrame) -> DataFrame:
    """session_id, seq, line."""
    line = F.concat(seconds_text(F.col("ts_us")), F.lit(" [INFO ] "), F.coalesce(render_message(F.col("kind")), F.lit("null")))
    return events.select("session_id", "seq", line.alias("line"))
