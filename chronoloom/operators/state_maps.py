"""What a block of events does to each entity of a core, whatever state it starts in. No Spark in here.

Every executor and task is an automaton of its own: its next state follows from the event and its state alone.
So a block of events is a map from states to states for each entity, and maps of neighbouring blocks compose.
A map's keys are the start states that the block can tell apart: the plain states, preempted by each executor
that goes idle in the block, and ``ABSENT``; any other state stays as it is. The task that an executor polls at
the start is only carried along (``CARRIED``). Entities without an event of their own share one map.
"""

from __future__ import annotations

from chronoloom.operators.step import Core, Executor, Task, executor_after, task_after
from chronoloom.schemas import IDLE, POLL_START, READY_BEGIN

ABSENT = None
#: Stands for the task that an executor polled at the start.
CARRIED = -1
#: Events as (kind, core, executor, task).
Event = tuple[str, int, int | None, int | None]
#: The map of an entity: pairs of start and end.
Map = list[tuple]


class _Paths:
    """The states that an entity can be in now, each with the starts that lead to it."""

    def __init__(self, starts):
        self.now = {s: [s] for s in starts}

    def move(self, change) -> None:
        out: dict = {}
        for s, starts in self.now.items():
            out.setdefault(change(s), []).extend(starts)
        self.now = out

    def pairs(self) -> Map:
        return [(start, end) for end, starts in self.now.items() for start in starts if start != end]


def _executor_starts(idle: set[int], absent: bool) -> list:
    preempted = [Executor("Preempted", x, b, CARRIED if b == "Polling" else None) for x in idle for b in ("Scheduling", "Polling")]
    return [Executor("Idle"), Executor("Scheduling"), Executor("Polling", task=CARRIED), *preempted, *([ABSENT] if absent else [])]


def _task_starts(idle: set[int], absent: bool) -> list:
    return [*(Task(s) for s in ("Spawned", "Waiting", "Running", "Idle", "Ended")), *(Task("Preempted", x) for x in idle), *([ABSENT] if absent else [])]


def block_maps(core_id: int, events: list[Event]) -> dict[tuple, Map]:
    """Maps by entity: (executor,), (executor, task), and for those without own events (None,),
    (executor, None) and (None, None)."""
    events = [e for e in events if e[2] is not None]
    idle = {e[2] for e in events if e[0] == IDLE}
    executors = {(i,): _Paths(_executor_starts(idle, i is not None)) for i in {None, *(e[2] for e in events)}}
    named = {(e[2], e[3]) for e in events if e[3] is not None}
    tasks = {k: _Paths(_task_starts(idle, k[1] is not None)) for k in {(None, None), *((i, None) for (i,) in executors), *named}}
    by_executor: dict = {}
    for k in tasks:
        by_executor.setdefault(k[0], []).append(k)
    for kind, at, who, task in events:
        others = kind == IDLE or (kind == POLL_START and at == core_id)
        created = at == core_id and kind != READY_BEGIN
        for (i,), paths in executors.items():
            own = i == who
            if own:
                paths.move(lambda s: executor_after(Executor() if s is ABSENT and created else s, True, kind, who, task) if s is not ABSENT or created else s)
            elif others:
                paths.move(lambda s: s if s is ABSENT else executor_after(s, False, kind, who, task))
            if own and task is not None:
                tasks[(i, task)].move(lambda s: task_after(Task() if s is ABSENT else s, True, kind, who))
            elif not own and others:
                for k in by_executor[i]:
                    tasks[k].move(lambda s: s if s is ABSENT else task_after(s, False, kind, who))
    return {k: p.pairs() for k, p in (executors | tasks).items()}


def _moved_executor(x: Executor | None, pairs: dict) -> Executor | None:
    if x is ABSENT:
        return pairs.get(ABSENT, ABSENT)
    end = pairs.get(x._replace(task=CARRIED) if x.task is not None else x, x)
    return end._replace(task=x.task) if end is not x and end.task == CARRIED else end


class Composed:
    """A core's state, carried from block to block by their maps."""

    def __init__(self, core_id: int):
        self.core = Core(core_id)

    def start(self, maps: dict[tuple, Map]) -> list[tuple[int, int | None, tuple]]:
        """What a block with these maps has to know: (executor, task or None, state) of its executors, of the
        tasks it names and of those that others' events can change."""
        core = self.core
        out = [(i, None, tuple(x)) for i, x in core.executors.items()]
        wanted = {k for k in maps if len(k) == 2 and k[1] is not None} | {(i, t) for i, of in core.active.items() for t in of}
        return out + [(i, t, tuple(core.tasks[i][t])) for i, t in sorted(wanted) if t in core.tasks.get(i, ())]

    def apply(self, maps: dict[tuple, Map]) -> None:
        core = self.core
        lookup = {k: dict(v) for k, v in maps.items()}
        named = {k for k in maps if len(k) == 2 and k[1] is not None}
        changed = {(i, t): core.tasks.get(i, {}).get(t, ABSENT) for i, t in named | {(i, t) for i, of in core.active.items() for t in of}}
        for (i, t), x in changed.items():
            of = lookup.get((i, t)) if (i, t) in lookup else lookup.get((i, None), lookup[(None, None)])
            new = of.get(x, x)
            if new is not ABSENT:
                core.put_task(i, t, new)
        for i in {*core.executors, *(k[0] for k in maps if len(k) == 1 and k[0] is not None)}:
            new = _moved_executor(core.executors.get(i, ABSENT), lookup.get((i,), lookup[(None,)]))
            if new is not ABSENT:
                core.executors[i] = new
