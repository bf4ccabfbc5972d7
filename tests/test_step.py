"""Every cell of both transition tables, and the notes on them."""

import pytest

from chronoloom.operators.step import Core
from chronoloom.schemas import EXEC_BEGIN, EXEC_END, IDLE, METRIC, POLL_START, READY_BEGIN, TASK_END, TASK_NEW


def run(core, *events):
    out = []
    for kind, at, executor, task in events:
        out = core.step(kind, at, executor, task, None, None)
    return out


POLL, BEGIN, END, SLEEP = (POLL_START, 0, 1, None), (EXEC_BEGIN, 0, 1, 9), (EXEC_END, 0, 1, 9), (IDLE, 0, 1, None)
READY, DONE, OTHER, OTHER_IDLE = (READY_BEGIN, 0, 1, 9), (TASK_END, 0, 1, 9), (POLL_START, 0, 2, None), (IDLE, 0, 2, None)


@pytest.mark.parametrize(
    ("before", "event", "state"),
    [
        ((SLEEP,), POLL, "Scheduling"), ((SLEEP,), BEGIN, "Idle"), ((POLL,), BEGIN, "Polling"), ((POLL,), SLEEP, "Idle"), ((POLL,), END, "Scheduling"), ((POLL, BEGIN), END, "Scheduling"),
        ((POLL, BEGIN), (EXEC_END, 0, 1, 5), "Scheduling"), ((POLL, BEGIN), SLEEP, "Polling"), ((POLL,), OTHER, "Preempted"), ((POLL, BEGIN), OTHER, "Preempted"), ((POLL, BEGIN), (POLL_START, 1, 2, None), "Polling"),
        ((POLL, BEGIN, OTHER), OTHER_IDLE, "Polling"), ((POLL, OTHER), OTHER_IDLE, "Scheduling"), ((POLL, OTHER), (IDLE, 1, 2, None), "Scheduling"), ((POLL, OTHER), (IDLE, 0, 3, None), "Preempted"), ((POLL, OTHER), SLEEP, "Preempted"),
    ],
)
def test_executor_cells(before, event, state):
    core = Core(0)
    run(core, *before, event)
    assert core.executors[1].state == state


@pytest.mark.parametrize(
    ("before", "event", "state"),
    [
        ((POLL, (TASK_NEW, 0, 1, 9)), READY, "Waiting"), ((POLL, (TASK_NEW, 0, 1, 9)), BEGIN, "Spawned"), ((POLL, READY), BEGIN, "Running"), ((POLL, READY, BEGIN), END, "Idle"), ((POLL, READY, BEGIN), READY, "Waiting"),
        ((POLL, READY, BEGIN), DONE, "Ended"), ((POLL, READY, BEGIN, END), READY, "Waiting"), ((POLL, READY, BEGIN, DONE), (TASK_NEW, 0, 1, 9), "Ended"), ((POLL, READY, BEGIN, DONE), READY, "Ended"),
        ((POLL, READY, BEGIN), OTHER, "Preempted"), ((POLL, READY, BEGIN, OTHER), OTHER_IDLE, "Running"), ((POLL, READY, BEGIN, OTHER), READY, "Preempted"), ((POLL, READY, BEGIN), (READY_BEGIN, 1, 1, 9), "Waiting"),
    ],
)
def test_task_cells(before, event, state):
    core = Core(0)
    run(core, *before, event)
    assert core.tasks[1][9].state == state


def test_wake_up_before_its_executor_is_lost():
    core = Core(0)
    assert core.step(READY_BEGIN, 0, 1, 9, None, None) == [] and not core.executors


def test_holder_changes_in_order():
    core = Core(0)
    out = run(core, POLL, BEGIN, OTHER)
    assert [r["rec"] for r in out] == ["executor", "executor", "executor", "core"]
    assert out[-1] == {"rec": "core", "prev_executor_id": 1, "executor_id": 2}


def test_metric_names_the_polling_executor_of_its_core():
    core = Core(0)
    run(core, POLL, BEGIN)
    assert core.step(METRIC, 0, None, None, "m", 1.0)[0]["pid"] == 1
    assert core.step(METRIC, 1, None, None, "m", 1.0) == []
