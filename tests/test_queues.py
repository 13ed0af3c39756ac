"""Queues and what rides a cycle, against a twin that keeps the whole log, and hand-worked rows."""

from collections import defaultdict

import numpy as np

from bandloom.operators.queues import ARRIVE, LEAVE, TAKE, _in_order, admitted, served
from bandloom.plans import catalog

SMALL = "/root/testdata/sf0.001"
LOG = "queue string, at long, step int, job long, caller string, cells long"


def twin(rows, most, budget, share=0.5):
    """{(queue, job): (status, cycle, place)} of rows (queue, at, step, job, caller, cells, kind, members), by rescanning lists."""
    out = {}
    for queue in {r[0] for r in rows}:
        waits, due, cycles = [], [], 0  # jobs by arrival; callers as they are due

        def cycle():
            nonlocal cycles
            ride, left = [], budget
            while True:
                before = len(ride)
                for caller in list(due):
                    first = next(r for r in waits if r[4] == caller)
                    if ride and not (first[6] == "bands" and first[7] == ride[0][7] and first[5] <= left):
                        continue
                    waits.remove(first)
                    due.remove(caller)
                    due.extend([caller] if any(r[4] == caller for r in waits) else [])
                    ride.append(first)
                    left -= first[5]
                    if first[6] != "bands":
                        break
                if len(ride) == before or ride[-1][6] != "bands":
                    break
            cycles += bool(ride)
            out.update({(queue, r[3]): ("admitted", cycles, i + 1) for i, r in enumerate(ride)})

        for r in sorted((r for r in rows if r[0] == queue), key=lambda r: r[1:4]):
            if r[2] == TAKE:
                cycle()
            else:
                own = sum(x[5] for x in waits if x[4] == r[4])
                if r[5] > most * share or own + r[5] > most * share or sum(x[5] for x in waits) + r[5] > most:
                    out[queue, r[3]] = ("too_large" if r[5] > most * share else "busy", None, None)
                else:
                    waits.append(r)
                    due.extend([] if r[4] in due else [r[4]])
        while waits:
            cycle()
    return out


def test_callers_are_served_in_turn(spark):
    jobs = [("q", 0, ARRIVE, s, "flood", 40, "bands", 1) for s in range(10, 14)] + [("q", 0, ARRIVE, 99, "late", 40, "bands", 1)]
    log = spark.createDataFrame(jobs, LOG + ", kind string, members int")
    got = {r.job: (r.cycle, r.place) for r in served(log, 1000, 130).collect()}
    assert got == {10: (1, 1), 99: (1, 2), 11: (1, 3), 12: (2, 1), 13: (2, 2)}


def test_sizes_do_not_mix_and_other_kinds_ride_alone(spark):
    jobs = [("q", 0, ARRIVE, 1, "a", 1, "bands", 1), ("q", 0, ARRIVE, 2, "b", 1, "bands", 8), ("q", 0, ARRIVE, 3, "c", 10, "misfit", 1), ("q", 0, ARRIVE, 4, "a", 1, "bands", 1)]
    log = spark.createDataFrame(jobs, LOG + ", kind string, members int")
    assert {r.job: r.cycle for r in served(log, 1000, 130).collect()} == {1: 1, 4: 1, 2: 2, 3: 3}


def test_a_queue_pushes_back(spark):
    log = [("q", 0, ARRIVE, 1, "a", 25), ("q", 1, ARRIVE, 2, "a", 25), ("q", 2, ARRIVE, 3, "a", 1), ("q", 3, ARRIVE, 4, "b", 45), ("q", 4, ARRIVE, 5, "b", 51), ("q", 5, ARRIVE, 6, "c", 9)]
    log += [("q", 6, LEAVE, 2, "a", 25), ("q", 6, LEAVE, 3, "a", 1), ("q", 6, ARRIVE, 7, "c", 9), ("p", 0, ARRIVE, 8, "a", 50)]
    got = {r.job: (r.status, r.waiting) for r in admitted(spark.createDataFrame(log, LOG), 100).collect()}
    assert got == {1: ("admitted", 25), 2: ("admitted", 50), 3: ("busy", 50), 4: ("admitted", 95), 5: ("too_large", 95), 6: ("busy", 95), 7: ("admitted", 79), 8: ("admitted", 50)}


def test_cycles_equal_the_twin(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(600):
        queue, step = f"q{rng.integers(0, 5)}", ARRIVE if rng.random() < 0.8 else TAKE
        caller, kind, members = f"c{rng.integers(0, 6)}", "misfit" if rng.random() < 0.1 else "bands", int(rng.choice([1, 8]))
        rows.append((queue, int(k // 3), step, k, caller, int(rng.integers(1, 70)), kind, members))
    log = spark.createDataFrame(rows, LOG + ", kind string, members int").repartition(7)
    got = {(r.queue, r.job): (r.status, r.cycle, r.place) for r in served(log, 120, 60).collect()}
    assert got == twin(rows, 120, 60) and {s for s, *_ in got.values()} == {"admitted", "busy", "too_large"}
    assert served(log.limit(0), 120, 60).collect() == []


def test_the_query_equals_the_twin(spark):
    rows = [tuple(r[c] for c in ("queue", "at", "step", "job", "caller", "cells", "kind", "members")) for r in catalog._served(spark, SMALL).collect()]
    found = catalog.cycles_query(spark, SMALL).collect()
    assert {(r.queue, r.job): (r.status, r.cycle, r.place) for r in found} == twin(rows, catalog.QUEUE_CELLS, catalog.CYCLE_CELLS)
    riders = defaultdict(list)
    for r in found:
        if r.cycle:
            riders[r.queue, r.cycle].append(r)
    assert max(map(len, riders.values())) > 1


def test_times_stay_where_logs_are_sorted(spark):
    log = spark.createDataFrame([("q", (2, 0), ARRIVE, 1, 1, 5), ("q", (1, 0), ARRIVE, 2, 1, 7)], "queue string, at struct<day:int,late:int>, step int, job long, caller long, cells long")
    columns = ["queue", "at", "step", "job", "caller", "cells"]
    assert [tuple(r) for r in _in_order(log, columns).collect()] == [("q", ARRIVE, 2, 1, 7), ("q", ARRIVE, 1, 1, 5)]
