"""Traces rendered from the driver's ``events`` table: scrambled (hits every guard) and well-formed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom import schemas as S
from chronoloom.functions.parse import seconds_text
from chronoloom.plans.route import render_message

_SCRAMBLED = (S.POLL_START, S.IDLE, S.READY_BEGIN, S.EXEC_BEGIN, S.EXEC_END, S.TASK_NEW, S.TASK_END, S.MONITOR_START, S.MONITOR_END, S.METRIC)


def _base(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("session_id"), "event_id", "event_type", "value", F.round(F.col("value") * 100).cast("long").alias("c100"))


def _pick(number, names):
    return F.get(F.array(*(F.lit(n) for n in names)), number.cast("int"))


def scrambled_events(events: DataFrame) -> DataFrame:
    """log_events, one for each row."""
    b, c = _base(events), F.col("c100")
    kind = _pick(F.floor(c / 12) % 10, _SCRAMBLED)
    monitor, metric = kind.isin(*S.MONITOR_KINDS), kind == S.METRIC
    return b.select(
        "session_id", F.col("event_id").alias("seq"), (F.col("event_id") * 137 + 1000).alias("ts_us"), (c % 2).cast("int").alias("core_id"), kind.alias("kind"),
        F.when(kind.startswith("EVENT_EMBASSY"), F.lit(1073610704) + 16 * (F.floor(c / 2) % 3)).alias("executor_id"),
        F.when(kind.isin(*S.TASK_KINDS), F.lit(1073425160) + 64 * (F.floor(c / 6) % 2)).alias("task_id"),
        F.when(monitor, F.concat(F.lit("fn_"), "event_type")).when(metric, F.col("event_type")).alias("name"), F.when(metric, F.col("value")).alias("value"),
    )


def well_formed_lines(events: DataFrame) -> DataFrame:
    """raw_logs: a life cycle of up to 16 lines for each row, with preemption, plain lines and junk."""
    b = _base(events).withColumn("core_id", (F.col("event_id") % 2).cast("int"))
    b = b.select("*", (F.lit(1073610704) + F.col("core_id") * 256).alias("lo"), (F.lit(1073425160) + 64 * (F.col("c100") % 3) + 4096 * F.col("core_id")).alias("t1"), (F.lit(1073433352) + 4096 * F.col("core_id")).alias("t2"))
    b = b.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(15)))).filter(
        "j IN (1,2,3,4,5,11,12,13) OR (j = 0 AND event_type = 'signup') OR (j BETWEEN 6 AND 10 AND event_type = 'error') OR (j = 14 AND event_type = 'view') OR (j = 15 AND event_type = 'click')"
    )
    kinds = (S.TASK_NEW, S.READY_BEGIN, S.POLL_START, S.EXEC_BEGIN, S.MONITOR_START, S.METRIC, S.POLL_START, S.READY_BEGIN, S.EXEC_BEGIN, S.EXEC_END, S.IDLE, S.MONITOR_END, S.EXEC_END, S.IDLE)
    high = F.col("j").between(6, 10)
    kind = _pick(F.col("j"), kinds)
    rows = b.select(
        "session_id", (F.col("event_id") * 16 + F.col("j")).alias("seq"), (F.col("event_id") * 1000 + F.col("j") * 10).alias("ts_us"), "core_id", "event_id", "j", kind.alias("kind"),
        F.when(high, F.col("lo") + 16).otherwise(F.col("lo")).alias("executor_id"), F.when(high, F.col("t2")).otherwise(F.col("t1")).alias("task_id"),
        F.when(F.col("j") == 5, F.col("event_type")).otherwise(F.concat(F.lit("fn_"), "event_type")).alias("name"), "value",
    )
    stamp = seconds_text(F.col("ts_us"))
    event = F.concat(stamp, F.lit(" [INFO ] "), render_message(F.col("kind")))
    line = F.when(F.col("j") == 14, F.concat(stamp, F.lit(" [WARN ] Hello, world! "), F.col("event_id"))).when(F.col("j") == 15, F.concat(F.lit("no brackets here "), F.col("event_id"))).otherwise(event)
    return rows.select("session_id", "seq", line.alias("line"))


def build_of(session):
    """Two sessions share a build; the well-formed traces that are numbered from a million on have the same ones."""
    return F.concat(F.lit("b"), F.floor(session % 1_000_000 / 2))


def symbol_rows(events: DataFrame) -> DataFrame:
    """build_id, address, symbol, ord: what the builds' symbol tables hold of the scrambled trace's executors
    and tasks. Later rows rename an address; some rows have no name, some no address."""
    c = F.col("c100")
    b = _base(events).select("*", (F.floor(c / 2) % 3).alias("x"), (F.floor(c / 6) % 2).alias("t"))
    address = lambda base, step, n: F.when(c % 7 == 0, F.lit(0)).otherwise(F.lit(base) + step * n).cast("long")
    symbol = lambda kind, n, most: F.when((c % 5 == 0) | (n > most), F.lit("")).otherwise(F.concat(F.lit(f"app::{kind}_"), F.col("event_type"), F.lit("::POOL::h"), F.col("event_id")))
    both = F.array(
        F.struct(address(1073610704, 16, F.col("x")).alias("address"), symbol("executor", F.col("x"), 1).alias("symbol"), (F.col("event_id") * 2).alias("ord")),
        F.struct(address(1073425160, 64, F.col("t")).alias("address"), symbol("task", F.col("t"), 0).alias("symbol"), (F.col("event_id") * 2 + 1).alias("ord")),
    )
    return b.select(build_of(F.col("session_id")).alias("build_id"), F.inline(both))
