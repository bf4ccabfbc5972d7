"""One core's state machines: executors, their tasks, who holds the core. No Spark in here.

``executor_after`` and ``task_after`` are the transitions of one entity by one event. ``Core.step`` takes one
event and returns what changed, in a fixed order: executors by id; of each its new tasks, its tasks by id,
then itself; then the core's holder; then a metric's executor.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

from chronoloom.schemas import EXEC_BEGIN, EXEC_END, IDLE, METRIC, POLL_START, READY_BEGIN, TASK_END

#: Next state of an executor by (state, own event), and of a task.
_EXECUTOR = {("Idle", POLL_START): "Scheduling", ("Scheduling", EXEC_BEGIN): "Polling", ("Scheduling", IDLE): "Idle", ("Polling", EXEC_END): "Scheduling"}
_TASK = {
    ("Spawned", READY_BEGIN): "Waiting",
    ("Waiting", EXEC_BEGIN): "Running",
    ("Running", EXEC_END): "Idle",
    ("Running", READY_BEGIN): "Waiting",
    ("Running", TASK_END): "Ended",
    ("Idle", READY_BEGIN): "Waiting",
}


class Executor(NamedTuple):
    """A state, whom it waits for while preempted and the state to come back to, the task it polls."""

    state: str = "Idle"
    by: int | None = None
    back: str | None = None
    task: int | None = None

    @property
    def label(self) -> str:
        return f"Preempted (by {self.by})" if self.state == "Preempted" else self.state

    @property
    def runs(self) -> bool:
        return self.state in ("Scheduling", "Polling")


class Task(NamedTuple):
    state: str = "Spawned"
    by: int | None = None

    @property
    def label(self) -> str:
        return f"Preempted (by {self.by})" if self.state == "Preempted" else self.state

    @property
    def active(self) -> bool:
        """Whether other executors' events can change it."""
        return self.state in ("Running", "Preempted")


def executor_after(x: Executor, own: bool, kind: str, who: int, task_id: int | None) -> Executor:
    """``own``: the event is this executor's. Others' POLL_START are those of its core only."""
    if not own:
        if kind == POLL_START and x.runs:
            return Executor("Preempted", who, x.state, x.task)
        return Executor(x.back, None, None, x.task) if kind == IDLE and x.state == "Preempted" and x.by == who else x
    new = _EXECUTOR.get((x.state, kind))
    return x if new is None else Executor(new, task=task_id if new == "Polling" else None)


def task_after(x: Task, own: bool, kind: str, who: int) -> Task:
    """``own``: the event names this task; otherwise it is another executor's."""
    if not own:
        if kind == POLL_START and x.state == "Running":
            return Task("Preempted", who)
        return Task("Running") if kind == IDLE and x.state == "Preempted" and x.by == who else x
    new = _TASK.get((x.state, kind))
    return x if new is None else Task(new)


@dataclass
class Core:
    """``find`` looks up a task that isn't held here: (executor, task) to its state, or None if it is new."""

    core_id: int
    executors: dict[int, Executor] = field(default_factory=dict)
    tasks: dict[int, dict[int, Task]] = field(default_factory=dict)
    active: dict[int, set[int]] = field(default_factory=dict)
    find: Callable[[int, int], Task | None] | None = None

    def put_task(self, executor: int, task: int, x: Task) -> None:
        self.tasks.setdefault(executor, {})[task] = x
        of = self.active.setdefault(executor, set())
        of.add(task) if x.active else of.discard(task)

    def _known(self, executor: int, task: int) -> bool:
        held = self.tasks.setdefault(executor, {})
        if task not in held and self.find is not None:
            x = self.find(executor, task)
            if x is not None:
                self.put_task(executor, task, x)
        return task in held

    def _holder(self) -> int | None:
        return min((i for i, x in self.executors.items() if x.runs), default=None)

    def _polling(self) -> int | None:
        return min((i for i, x in self.executors.items() if x.state == "Polling"), default=None)

    def step(self, kind: str, core_id: int, executor_id: int | None, task_id: int | None, name: str | None, value: float | None) -> list[dict]:
        out: list[dict] = []
        if executor_id is not None:
            mine = core_id == self.core_id
            others = kind == IDLE or (kind == POLL_START and mine)
            if not (mine or others or executor_id in self.executors):
                return out
            # the holder is looked up after registration, and a new executor does not run yet
            before = self._holder()
            if mine and kind != READY_BEGIN and executor_id not in self.executors:
                self.executors[executor_id] = Executor()
                out.append({"rec": "executor", "executor_id": executor_id, "label": "Created"})
            for i in sorted(self.executors) if others else [executor_id] * (executor_id in self.executors):
                out += self._executor(i, kind, executor_id, task_id)
            # without a change there is no other holder
            after = self._holder() if out else before
            if before != after:
                out.append({"rec": "core", "prev_executor_id": before, "executor_id": after})
        if kind == METRIC and core_id == self.core_id:
            out.append({"rec": "metric", "name": name, "value": value, "pid": self._polling()})
        return out

    def _executor(self, i: int, kind: str, executor_id: int, task_id: int | None) -> list[dict]:
        out, own = [], i == executor_id
        if own and task_id is not None and not self._known(i, task_id):
            self.put_task(i, task_id, Task())
            out.append({"rec": "task", "executor_id": i, "task_id": task_id, "label": "Spawned"})
        for t in ([] if task_id is None else [task_id]) if own else sorted(self.active.get(i, ())):
            self._known(i, t)
            was = self.tasks[i][t]
            now = task_after(was, own, kind, executor_id)
            if now != was:
                self.put_task(i, t, now)
                out.append({"rec": "task", "executor_id": i, "task_id": t, "prev_label": was.label, "label": now.label, "by_executor_id": now.by})
        was = self.executors[i]
        now = executor_after(was, own, kind, executor_id, task_id)
        if now != was:
            self.executors[i] = now
            out.append({"rec": "executor", "executor_id": i, "task_id": now.task if now.state == "Polling" else None, "prev_label": was.label, "label": now.label, "by_executor_id": now.by})
        return out
