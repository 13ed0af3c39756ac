"""Queues of bounded size: which jobs are let in, and in which cycles they are served.

What is decided about a job depends on all before it in its queue. So a log is dealt by queue and put in order, and each
queue is folded from its sorted rows as they come: a task holds what waits in one queue, which ``max_cells`` bounds, and
never its log. Different queues run side by side.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of rows of a log, in the order in which those of one time count.
LEAVE, TAKE, ARRIVE = 0, 1, 2
BAND = "bands"


@dataclass
class Job:
    job: object
    caller: object
    cells: int
    kind: str = BAND
    members: int = 1


@dataclass
class Queue:
    """What waits: each caller's jobs by arrival, the callers in the order in which they are due."""

    max_cells: int
    share: float
    cells: int = 0
    waiting: dict = field(default_factory=dict)
    held: dict = field(default_factory=dict)

    def offer(self, job: Job) -> str:
        """Lets the job in, or says why not: over one caller's share it never fits, else perhaps later."""
        own = self.max_cells * self.share
        if job.cells > own:
            return "too_large"
        if self.held.get(job.caller, 0) + job.cells > own or self.cells + job.cells > self.max_cells:
            return "busy"
        self.waiting.setdefault(job.caller, deque()).append(job)
        self._count(job, 1)
        return "admitted"

    def remove(self, caller: object, name: object) -> None:
        """The job is done, if it was let in."""
        for job in [j for j in self.waiting.get(caller, ()) if j.job == name]:
            self.waiting[caller].remove(job)
            self._count(job, -1)
        if caller in self.waiting and not self.waiting[caller]:
            del self.waiting[caller]

    def cycle(self, budget: int) -> list[Job]:
        """The next jobs to serve together: a job a caller and round, the callers in turn, as far as the budget goes.

        The first one is taken whatever it costs. Only band jobs of as many members join it; any other kind is served alone.
        Who was served is due last.
        """
        taken: list[Job] = []
        again = True
        while again:
            again = False
            for caller in [*self.waiting]:
                job = self.waiting[caller][0]
                if taken and (job.kind != BAND or job.members != taken[0].members or job.cells > budget):
                    continue
                rest = self.waiting.pop(caller)
                rest.popleft()
                if rest:
                    self.waiting[caller] = rest
                self._count(job, -1)
                taken.append(job)
                budget -= job.cells
                again = True
                if job.kind != BAND:
                    return taken
        return taken

    def _count(self, job: Job, sign: int) -> None:
        self.cells += sign * job.cells
        self.held[job.caller] = self.held.get(job.caller, 0) + sign * job.cells
        if not self.held[job.caller]:
            del self.held[job.caller]


def _in_order(log: DataFrame, columns: list[str]) -> DataFrame:
    order = ["queue", "at", "step", "job"]
    # No fold reads the time, which may be a struct: Python would make an object of each.
    return log.select(*columns).repartition("queue").sortWithinPartitions(*order).drop("at")


def admitted(log: DataFrame, max_cells: int, share: float = 0.5) -> DataFrame:
    """``queue, job, caller, cells, status, waiting``: what becomes of each arrival of a log
    ``(queue, at, step, job, caller, cells)``, and the cells that wait in the queue after it.

    ``step`` is ARRIVE or LEAVE: the cells of a job that was let in are free once it leaves. Rows count by ``at``; of one time
    what leaves comes first, then by job. A job is ``too_large`` if it is over the caller's share of ``max_cells`` by itself,
    ``busy`` if the caller's share or the queue has no room for it now, else ``admitted``.
    """
    kinds = {c: t for c, t in log.dtypes}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, queue = None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if queue is None or r.queue != name:
                    name, queue = r.queue, Queue(max_cells, share)
                if r.step == LEAVE:
                    queue.remove(r.caller, r.job)
                elif r.step == ARRIVE:
                    out.append((r.queue, r.job, r.caller, r.cells, queue.offer(Job(r.job, r.caller, r.cells)), queue.cells))
            yield pd.DataFrame(out, columns=["queue", "job", "caller", "cells", "status", "waiting"])

    sorted_log = _in_order(log, ["queue", "at", "step", "job", "caller", "cells"])
    return sorted_log.mapInPandas(run, f"queue {kinds['queue']}, job {kinds['job']}, caller {kinds['caller']}, cells long, status string, waiting long")


def served(log: DataFrame, max_cells: int, cycle_cells: int, share: float = 0.5) -> DataFrame:
    """``queue, job, caller, cells, status, cycle, place``: each arrival of a log ``(queue, at, step, job, caller, cells, kind,
    members)``, with the cycle of its queue (from 1) that serves it and its place in that.

    ``step`` is ARRIVE or TAKE: at a TAKE the next cycle is served, of up to ``cycle_cells``; what still waits when the log ends
    is served in cycles without a pause. Refused jobs have no cycle.
    """
    kinds = {c: t for c, t in log.dtypes}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, queue, cycles = None, None, 0

        def taken() -> list[tuple]:
            nonlocal cycles
            jobs = queue.cycle(cycle_cells)
            cycles += bool(jobs)
            return [(name, j.job, j.caller, j.cells, "admitted", cycles, place) for place, j in enumerate(jobs, 1)]

        def rest() -> list[tuple]:
            out = []
            while queue is not None and queue.waiting:
                out += taken()
            return out

        def table(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["queue", "job", "caller", "cells", "status", "cycle", "place"]).astype({"cycle": "Int32", "place": "Int32"})

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if queue is None or r.queue != name:
                    out += rest()
                    name, queue, cycles = r.queue, Queue(max_cells, share), 0
                if r.step == TAKE:
                    out += taken()
                elif r.step == ARRIVE:
                    status = queue.offer(Job(r.job, r.caller, r.cells, r.kind, r.members))
                    out += [] if status == "admitted" else [(r.queue, r.job, r.caller, r.cells, status, None, None)]
            yield table(out)
        yield table(rest())

    sorted_log = _in_order(log, ["queue", "at", "step", "job", "caller", "cells", "kind", "members"])
    return sorted_log.mapInPandas(run, f"queue {kinds['queue']}, job {kinds['job']}, caller {kinds['caller']}, cells long, status string, cycle int, place int")
