"""Fixed schemas and values of the trace tables."""

from __future__ import annotations

# Event names of the wire format, by what they carry.
POLL_START, IDLE = "EVENT_EMBASSY_POLL_START", "EVENT_EMBASSY_EXECUTOR_IDLE"
READY_BEGIN, EXEC_BEGIN, EXEC_END = "EVENT_EMBASSY_TASK_READY_BEGIN", "EVENT_EMBASSY_TASK_EXEC_BEGIN", "EVENT_EMBASSY_TASK_EXEC_END"
TASK_NEW, TASK_END = "EVENT_EMBASSY_TASK_NEW", "EVENT_EMBASSY_TASK_END"
MONITOR_START, MONITOR_END, METRIC = "EVENT_MONITOR_START", "EVENT_MONITOR_END", "EVENT_METRIC"

EXECUTOR_KINDS = (POLL_START, IDLE)
TASK_KINDS = (READY_BEGIN, EXEC_BEGIN, EXEC_END, TASK_NEW, TASK_END)
MONITOR_KINDS = (MONITOR_START, MONITOR_END)
KINDS = (*EXECUTOR_KINDS, *TASK_KINDS, *MONITOR_KINDS, METRIC)
LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR")

RAW_LOGS = "session_id long, seq long, line string"
REPLAY = (
    "session_id long, seq long, sub int, ts_us long, core_id int, rec string, executor_id long, task_id long, prev_label string, "
    "label string, by_executor_id long, prev_executor_id long, name string, value double, pid long"
)
