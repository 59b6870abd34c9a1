"""Static checks over tables of many workflows: what is available on every path, and how many steps a run may take.

Tables, all with a column workflow:

- edges (source, target): a flow leads to another; source is START for the flows that a run may begin with, target END where
  a run may end.
- reads (flow, pointer, by_default): a flow needs /flows/<name>/... before it begins; END needs what the output reads.
- flows (flow, steps, attempts): own steps, and how often a flow may run.
- calls (flow, callee, kind, step, times): a retry flow (kind ``retry``), or a flow that a collection step runs for each of up
  to ``times`` items (kind ``item``; several callees of one step are alternatives).

Graphs are acyclic. A workflow's tables meet in one row, in which a helper walks its flows in topological order: one shuffle
by workflow, whatever the length of paths, and a task works on one graph at a time. Flows that have no place in the order lie
on a cycle, or behind one; they are reported, and nothing else is said of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "", "/end"

_NODE = ["workflow", "flow"]
#: Workflows that are handed to the helper together.
TOGETHER = 256


def _each_workflow(rows: DataFrame, work: Callable[[list[tuple]], Iterator[tuple]], **fields: str) -> DataFrame:
    """workflow and what ``work`` makes of all rows of one workflow (tuples in the order of their columns): tuples of ``fields``."""
    grouped = rows.groupBy("workflow").agg(F.collect_list(F.struct(*(c for c in rows.columns if c != "workflow"))).alias("rows"))
    types = [{"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}[t] for t in fields.values()]
    names = ["workflow", *fields]

    def values(column: pa.Array) -> list:
        return column.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(column.type) else column.to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                some, lists = (c.slice(at, TOGETHER) for c in batch.columns)
                each = list(zip(*map(values, lists.flatten().flatten()), strict=True))
                ends = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
                out = [(w, *x) for w, i, j in zip(some.to_pylist(), ends, ends[1:], strict=False) for x in work(each[i:j])]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [some.type, *types], strict=True)], names=names)

    workflow = rows.schema["workflow"].dataType.simpleString()
    return grouped.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in {"workflow": workflow, **fields}.items()))


def _in_order(nodes, edges: set[tuple[str, str]]) -> tuple[list[str], dict[str, list[str]]]:
    """Nodes, each after all that lead to it, and what leads to each; nodes on a cycle or behind one are left out."""
    before: dict[str, list[str]] = {n: [] for n in nodes}
    after: dict[str, list[str]] = {}
    for source, target in edges:
        if target in before:
            before[target].append(source)
            after.setdefault(source, []).append(target)
    left = {n: len(b) for n, b in before.items()}
    order = [n for n, k in left.items() if not k]
    for n in order:
        for t in after.get(n, ()):
            left[t] -= 1
            if not left[t]:
                order.append(t)
    return order, before


def _above(edges: set[tuple[str, str]]) -> dict[str, str | None]:
    """Each node's nearest dominator, None where it has none but itself: where the ways up from all its predecessors meet."""
    order, before = _in_order(dict.fromkeys(n for e in edges for n in e), edges)
    above: dict[str, str | None] = {}
    depth: dict[str | None, int] = {None: 0}
    for n in order:
        meet, *others = before[n] or [None]
        for p in others:
            while meet != p:
                if depth[meet] >= depth[p]:
                    meet = above[meet]
                else:
                    p = above[p]
        above[n], depth[n] = meet, depth[meet] + 1
    return above


def _upwards(above: dict[str, str | None], node: str | None) -> Iterator[str]:
    while node is not None:
        yield node
        node = above.get(node)


def _dominators(rows: list[tuple]) -> Iterator[tuple]:
    above = _above(set(rows))
    return ((n, d) for n in above for d in _upwards(above, n))


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select("workflow", "source", "target").where("source IS NOT NULL AND target IS NOT NULL")


def _nodes(edges: DataFrame) -> DataFrame:
    ends = edges.select("workflow", F.explode(F.array("source", "target")).alias("flow"))
    return ends.distinct()


def dominators(edges: DataFrame) -> DataFrame:
    """(workflow, flow, dominator): flows that lie on every path from the start to a flow, the flow itself among them."""
    return _each_workflow(_ends(edges), _dominators, flow="string", dominator="string")


def _reachable(rows: list[tuple]) -> Iterator[tuple]:
    after: dict[str, set[str]] = {}
    for source, target in rows:
        after.setdefault(source, set()).add(target)
    seen = {START: None}
    front = [START]
    for n in front:
        new = [t for t in after.get(n, ()) if t not in seen]
        seen.update(dict.fromkeys(new))
        front += new
    for source in seen:
        for target in after.get(source, ()):
            yield source, target


def reachable(edges: DataFrame) -> DataFrame:
    """The edges that a run can take; cycles are no obstacle."""
    return _each_workflow(_ends(edges), _reachable, source="string", target="string")


def unsettled(edges: DataFrame) -> DataFrame:
    """(workflow, flow) on a cycle, or behind one."""
    return _nodes(edges).join(dominators(edges).select(*_NODE).distinct(), _NODE, "left_anti")


def needed_flow(pointer: Column) -> Column:
    """The flow whose record a pointer reads; NULL of other pointers."""
    name = F.regexp_extract(pointer, r"\A/flows/([^/]+)(?:/|\z)", 1)
    return F.when(name != "", F.replace(F.replace(name, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))


def _availability(live_only: bool) -> Callable[[list[tuple]], Iterator[tuple]]:
    def find(rows: list[tuple]) -> Iterator[tuple]:
        edges = {r[:2] for r in rows if r[0] is not None}
        above, live = _above(edges), {target for _, target in edges}
        for source, _, flow, pointer, needed, by_default in rows:
            if source is not None or live_only and flow not in live:
                continue
            if needed not in above or needed in (START, END):
                yield flow, pointer, "invalid_flow_reference"
            elif by_default is False and (needed == flow or needed not in _upwards(above, above.get(flow))):
                yield flow, pointer, "unavailable_flow_reference"

    return find


def availability(edges: DataFrame, reads: DataFrame, live_only: bool = False) -> DataFrame:
    """(workflow, flow, pointer, problem) of reads that can fail: the flow does not run before on every path (and there is
    no default), does not exist, or is the reader itself. live_only: only those by flows that an edge leads to."""
    r = reads.select(*_NODE, "pointer", needed_flow(F.col("pointer")).alias("needed"), "by_default").where("needed IS NOT NULL")
    rows = _ends(edges).unionByName(r, allowMissingColumns=True)
    return _each_workflow(rows, _availability(live_only), flow="string", pointer="string", problem="string")


def _worst_steps(rows: list[tuple]) -> Iterator[tuple]:
    names = ("flow", "steps", "attempts", "callee", "kind", "step", "times")
    all_ = [dict(zip(names, r, strict=True)) for r in rows]
    flows = {r["flow"]: r for r in all_ if r["callee"] is None}
    calls = [r for r in all_ if r["callee"] is not None]
    of: dict[str, list[dict]] = {}
    for r in calls:
        of.setdefault(r["flow"], []).append(r)
    edges = {(r["callee"], r["flow"]) for r in calls}
    order, _ = _in_order(dict.fromkeys([*flows, *(c for c, _ in edges if c not in flows)]), edges)
    worst: dict[str, int | None] = {}
    for n in order:
        if n not in flows or any(r["callee"] not in worst for r in of.get(n, ())):
            continue  # it calls what is not there
        steps, attempts = flows[n]["steps"], flows[n]["attempts"]
        # of the callees of one step, the worst counts
        each: dict[tuple, list[dict]] = {}
        for r in of.get(n, ()):
            each.setdefault((r["kind"], r["step"]), []).append(r)
        more = {"item": 0, "retry": 0}
        for (kind, _), some in each.items():
            inner = max((worst[r["callee"]] for r in some if worst[r["callee"]] is not None), default=None)
            if kind in more and inner is not None and some[0]["times"] is not None:
                more[kind] += inner * some[0]["times"]
        worst[n] = None if steps is None or attempts is None else attempts * (steps + more["item"]) + (attempts - 1) * more["retry"] if of.get(n) else steps * attempts
        yield n, worst[n]


def worst_steps(flows: DataFrame, calls: DataFrame) -> DataFrame:
    """(workflow, flow, worst): the steps that one run of a flow may visit, with all attempts, retries and items."""
    own = flows.select(*_NODE, F.col("steps").cast("long").alias("steps"), F.col("attempts").cast("long").alias("attempts"))
    other = calls.where("callee IS NOT NULL").select(*_NODE, "callee", "kind", "step", F.col("times").cast("long").alias("times"))
    return _each_workflow(own.unionByName(other, allowMissingColumns=True), _worst_steps, flow="string", worst="long")


def _budgets(limit: int) -> Callable[[list[dict]], Iterator[tuple]]:
    def costliest(rows: list[tuple]) -> Iterator[tuple]:
        edges = {r[:2] for r in rows if r[0] is not None}
        cost = {target: worst or 0 for source, target, worst in rows if source is None}
        order, before = _in_order(dict.fromkeys(n for e in edges for n in e), edges)
        found: dict[str, tuple[int, str | None]] = {}  # total, and the flow before on the best path

        def path(n: str | None) -> list[str]:
            out = []
            while n is not None and before[n]:
                out.append(n)
                n = found[n][1]
            return out[::-1]

        for n in order:
            best = None
            for p in before[n]:
                if best is None or found[p][0] > found[best][0] or found[p][0] == found[best][0] and path(p) < path(best):
                    best = p
            found[n] = (0, None) if best is None else (found[best][0] + cost.get(n, 0), best)
        if found:
            most = max(total for total, _ in found.values())
            way = min(path(n) for n, (total, _) in found.items() if total == most)
            yield most, way, next((n for n in way if found[n][0] > limit), None)

    return costliest


def step_budgets(edges: DataFrame, worst: DataFrame, limit: int) -> DataFrame:
    """(workflow, total, path, crossing): the costliest path of each workflow, and the flow at which a run on it passes limit.

    Of paths that cost the same, the one whose names come first. crossing is NULL where no path passes the limit.
    """
    costs = worst.select("workflow", F.col("flow").alias("target"), F.col("worst").cast("long").alias("worst"))
    rows = _ends(edges).where(F.col("target") != END).unionByName(costs, allowMissingColumns=True)
    return _each_workflow(rows, _budgets(limit), total="long", path="array<string>", crossing="string")
