"""Graphs of random workflows against brute force, in as many jobs whatever the length of their paths."""

import random

from gristmill.operators import static_checks as sc

EDGES = "workflow string, source string, target string"


def graphs(count=30):
    r = random.Random(5)
    for w in range(count):
        n = r.randint(1, 7)
        edges = {("", f"f{k}") for k in range(n) if k == 0 or r.random() < 0.15}
        edges |= {(f"f{a}", f"f{b}") for a in range(n) for b in range(a + 1, n) if r.random() < 0.4}
        edges |= {(f"f{a}", sc.END) for a in range(n) if a == n - 1 or r.random() < 0.2}
        yield f"w{w}", edges


def reached(edges, start, gone=None):
    seen, front = {start}, [start]
    for n in front:
        new = {t for s, t in edges if s == n and t != gone} - seen
        seen |= new
        front += new
    return seen


def test_dominators_and_availability(spark):
    all_ = dict(graphs())
    live = {w: {e for e in edges if e[0] in reached(edges, "")} for w, edges in all_.items()}
    edges = spark.createDataFrame([(w, *e) for w, es in all_.items() for e in es], EDGES)
    got = sc.reachable(edges.unionByName(edges))
    assert sorted(map(tuple, got.collect())) == sorted((w, *e) for w, es in live.items() for e in es)
    dom = {(w, n, d) for w, es in live.items() for n in reached(es, "") for d in reached(es, "") if n == d or d == "" or n not in reached(es, "", d)}
    found = list(map(tuple, sc.dominators(got).collect()))
    assert len(found) == len(dom) and set(found) == dom
    reads = [(w, f"f{a}", f"/flows/f{b}/result", k) for w in all_ for a in range(8) for b in range(8) for k in (True, False)]
    want = set()
    for w, f, p, default in reads:
        needed = p.split("/")[2]
        if f not in {t for _, t in live[w]}:
            continue
        if needed not in reached(live[w], ""):
            want.add((w, f, p, "invalid_flow_reference"))
        elif not default and (needed == f or (w, f, needed) not in dom):
            want.add((w, f, p, "unavailable_flow_reference"))
    problems = sc.availability(got, spark.createDataFrame(reads, "workflow string, flow string, pointer string, by_default boolean"), live_only=True)
    assert {tuple(r) for r in problems.collect()} == want


def test_budgets(spark):
    all_, r = dict(graphs()), random.Random(9)
    cost = {(w, f"f{k}"): r.choice([1, 2, 2, 9]) for w in all_ for k in range(8)}

    def paths(es, n):
        yield []
        for s, t in es:
            if s == n and t != sc.END:
                yield from ([t, *p] for p in paths(es, t))

    want = {}
    for w, es in all_.items():
        total, way = min((-sum(cost[w, n] for n in p), p) for p in paths(es, ""))
        sums = [sum(cost[w, n] for n in way[: k + 1]) for k in range(len(way))]
        want[w] = (-total, way, next((n for n, x in zip(way, sums, strict=True) if x > 6), None))
    edges = sc.reachable(spark.createDataFrame([(w, *e) for w, es in all_.items() for e in es], EDGES))
    got = sc.step_budgets(edges, spark.createDataFrame([(*k, c) for k, c in cost.items()], "workflow string, flow string, worst long"), 6)
    assert {x["workflow"]: (x["total"], x["path"], x["crossing"]) for x in got.collect()} == want


def test_worst_steps(spark):
    flows = spark.createDataFrame([(1, "a", 2, 3), (1, "in", 5, 1), (1, "or", 4, 2), (1, "re", 7, 1), (1, "lost", 1, 1), (1, "above", 1, 1), (2, "a", 1, 1)], "workflow int, flow string, steps int, attempts int")
    calls = [(1, "a", "in", "item", "s", 10), (1, "a", "or", "item", "s", 10), (1, "a", "in", "item", "t", 2), (1, "a", "re", "retry", "r", 1), (1, "lost", "none", "item", "s", 1), (1, "above", "lost", "item", "s", 1)]
    got = sc.worst_steps(flows, spark.createDataFrame(calls, "workflow int, flow string, callee string, kind string, step string, times int"))
    assert sorted(map(tuple, got.collect())) == [(1, "a", 3 * (2 + 80 + 10) + 2 * 7), (1, "in", 5), (1, "or", 8), (1, "re", 7), (2, "a", 1)]


def test_no_job_for_each_level(spark):
    """A long chain: nothing runs before the result is asked for, and the plan has one shuffle by workflow a step."""
    chain = [("w", "" if k == 0 else f"f{k - 1}", f"f{k}") for k in range(400)]
    edges = spark.createDataFrame(chain, EDGES)
    spark.sparkContext.setJobGroup("levels", "levels")
    try:
        found = sc.dominators(sc.reachable(edges))
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("levels")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found.count() == 401 * 402 // 2
