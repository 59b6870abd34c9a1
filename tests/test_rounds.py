"""Repeats with retry flows, collections inside collections, and results that are not always there, on small tables."""

import json

import pytest
from gristmill.functions.values import literal, parse
from gristmill.operators import records as rc
from gristmill.operators import static_checks as sc
from gristmill.plans.collections import collect, run_collection
from gristmill.plans.workflow import Flow, Outcome, Repeat, Step, Workflow
from pyspark.sql import functions as F
from test_runs import ECHO, envelopes


def failing(value):
    return Step("s", lambda i: Outcome(i["x"], error=F.when(F.to_json(i["x"]) == value, "invalid_output")), {"x": {"pointer": "/payload/x"}})


def test_retry_failure_ends_the_run_and_keeps_the_attempt(spark):
    retry = Flow("again", [failing("2")])
    rounds = Repeat(3, {"pointer": "/payload/stop", "equals": True}, retry=retry, retry_input={"x": {"pointer": "/payload/x"}}, continue_when={"pointer": "/flows/again/result/x", "gt": 2})
    runs = Workflow([Flow("a", [ECHO], repeat=rounds)], "a").run(envelopes(spark, {"x": 1}, {"x": 2}, {"x": 3}, {"x": 3, "stop": True}, {"y": 0}))
    got = [(r["status"], r["error"], r["a"]["status"], r["a"]["stopped_by"], r["a"]["attempts"], r["again"]["status"], [h["role"] for h in r["a"]["history"]]) for r in runs.orderBy("run_id").collect()]
    assert got == [
        ("completed", None, "completed", "continue_when", 1, "completed", ["attempt", "retry"]),
        ("failed", "invalid_output", "completed", "failure", 1, "failed", ["attempt", "retry"]),
        ("completed", None, "completed", "exhausted", 3, "completed", ["attempt", "retry"] * 2 + ["attempt"]),
        ("completed", None, "completed", "until", 1, None, ["attempt"]),
        ("failed", "missing_binding", "failed", "failure", 1, None, ["attempt"]),
    ]


def test_input_that_cannot_be_bound(spark):
    missing = {"x": {"pointer": "/flows/a/result/none"}}
    rounds = Repeat(3, {"pointer": "/payload/none", "present": True}, missing)
    r = Workflow([Flow("a", [ECHO], repeat=rounds)], "a").run(envelopes(spark, {"x": 1})).first()
    assert (r["status"], r["error"], r["a"]["status"], r["a"]["stopped_by"]) == ("failed", "missing_binding", "completed", "failure")
    rounds = Repeat(3, {"pointer": "/payload/none", "present": True}, retry=Flow("again", [ECHO]), retry_input=missing)
    r = Workflow([Flow("a", [ECHO], repeat=rounds)], "a").run(envelopes(spark, {"x": 1})).first()
    assert (r["status"], r["error"], r["again"]["status"], r["a"]["history"][1]["error"]) == ("failed", "missing_binding", "failed", "missing_binding")


def test_plan_does_not_grow_with_attempts(spark):
    def plan(n):
        w = Workflow([Flow("a", [ECHO], repeat=Repeat(n, {"pointer": "/payload/x", "equals": 0}))], "a")
        return w.run(envelopes(spark, {"x": 1}))._jdf.queryExecution().optimizedPlan().toString().count("\n")

    assert plan(2) == plan(5)


def test_unavailable_results():
    route = [({"pointer": "/payload/x", "equals": 1}, "b"), (None, "c")]
    read = lambda **more: {"x": {"pointer": "/flows/b/result", **more}}
    for flows, where in (
        ([Flow("a", [], route), Flow("b", [], "c"), Flow("c", [], input=read())], ["c"]),
        ([Flow("a", [], route), Flow("b", [], "c"), Flow("c", [], input=read(default=0))], []),
        ([Flow("a", [], "b"), Flow("b", [], "c"), Flow("c", [], input=read())], []),
        ([Flow("a", [], "b", on_review="c"), Flow("b", [], "c"), Flow("c", [], input=read())], ["c"]),
        ([Flow("a", [], "b", input=read()), Flow("b", [])], ["a"]),
    ):
        assert [w for w, _ in Workflow(flows, "a").unavailable()] == where
    w = Workflow([Flow("a", [], route), Flow("b", []), Flow("c", [])], "a", output={"first_of": ["/flows/b/result", "/flows/c/result"]})
    assert [p for _, p in w.unavailable()] == ["/flows/b/result", "/flows/c/result"]
    with pytest.raises(ValueError):
        w.run(None)


def test_services_are_not_called_after_a_failure(spark):
    asked = spark.sparkContext.accumulator(0)

    def provider(df):
        rows = [tuple(r) for r in df.collect()]
        asked.add(len(rows))
        out = [(r[0], r[1], "failed" if r[1] == "2" else "completed") for r in rows]
        return spark.createDataFrame(out, f"run_id {df.schema['run_id'].dataType.simpleString()}, result string, status string")

    items = [[{"id": f"i{k}", "flow": "f", "input": {"x": x}} for k, x in enumerate(xs)] for xs in ([1, 2, 3, 4], [5], [])]
    df = spark.createDataFrame(list(enumerate(map(json.dumps, items))), "run_id long, t string").select("run_id", parse(F.col("t")).alias("items"))
    flow = Flow("f", [Step("s", inputs={"x": {"pointer": "/payload/x"}}, provider=provider)])
    got = sorted((r["run_id"], r["pos"], r["status"]) for r in run_collection(df, [flow]).collect())
    assert got == [(0, 0, "completed"), (0, 1, "failed"), (0, 2, "skipped"), (0, 3, "skipped"), (1, 0, "completed")] and asked.value == 3


def test_empty_and_refused_collections(spark):
    step = collect("each", {"pointer": "/payload/items"}, [Flow("f", [ECHO])], most=2)
    good, ids = {"id": "a", "flow": "f", "input": {"x": 1}}, [{"id": i, "flow": "f", "input": {"x": 1}} for i in ("a", "a")]
    runs = Workflow([Flow("b", [step])], "b").run(envelopes(spark, {"items": []}, {"items": [good]}, {"items": ids}, {"items": [good | {"flow": "g"}]}, {"items": [good | {"id": str(k)} for k in "abc"]}, {"items": [good | {"input": {}}]}))
    got = [(r["status"], r["error"], r["t"]) for r in runs.withColumn("t", F.to_json("b.steps.each.result")).orderBy("run_id").collect()]
    assert [g[:2] for g in got] == [("completed", None), ("completed", None), *[("failed", "invalid_input")] * 3, ("failed", "item_failed")]
    assert json.loads(got[0][2]) == {"items": []} and json.loads(got[1][2])["items"][0]["result"] == {"x": 1}
    inner = [Flow("f", [ECHO])]
    for _ in range(4):
        last, inner = inner, [Flow("f", [collect("c", {"pointer": "/payload/items"}, inner)])] if _ < 3 else inner
    with pytest.raises(ValueError):
        collect("c", {"pointer": "/payload/items"}, inner)


def test_equal_lines_are_asked_once(spark):
    df = spark.createDataFrame([("same",)] * 3, "run_id string").select("run_id", parse(F.lit('{"x": 1}')).alias("payload"), literal({}).alias("metadata"))
    step = Step("s", inputs={"x": {"pointer": "/payload/x"}}, provider=lambda d: d.select("run_id", F.col("x").alias("result"), F.lit("completed").alias("status")))
    assert Workflow([Flow("a", [step])], "a").run(df).count() == 3


def test_graphs_with_cycles_and_dead_ends(spark):
    edges = spark.createDataFrame([("w", "", "a"), ("w", "a", "b"), ("w", "b", "c"), ("w", "c", "b"), ("w", "a", "d"), ("v", "", "a"), ("u", "x", "y")], "workflow string, source string, target string")
    assert sorted(map(tuple, sc.unsettled(edges).collect())) == [("w", "b"), ("w", "c")]
    assert sorted(map(tuple, sc.reachable(edges.where("workflow <> 'w'")).collect())) == [("v", "", "a")]
    assert {tuple(r) for r in sc.dominators(edges).where("workflow = 'w' AND flow = 'd'").collect()} == {("w", "d", "d"), ("w", "d", "a"), ("w", "d", "")}


def test_sums_by_containment(spark):
    rows = [("r", [], 1), ("r", [0], 2), ("r", [0, 0], 4), ("r", [0, 1], None), ("r", [1], 8), ("s", [], None)]
    got = {(r["k"], tuple(r["p"])): (r["t_known"], r["t_unknown"], r["t_total"]) for r in rc.roll_up(spark.createDataFrame(rows, "k string, p array<int>, t long"), "k", "p", {"t": "t"}).collect()}
    assert got == {("r", ()): (15, 1, None), ("r", (0,)): (6, 1, None), ("r", (0, 0)): (4, 0, 4), ("r", (0, 1)): (0, 1, None), ("r", (1,)): (8, 0, 8), ("s", ()): (0, 1, None)}


def test_owner_walks(spark):
    doc = {"flows": {"f/g": {"status": "completed", "steps": {"plain": {"status": "completed", "result": {"items": [{"status": "x"}]}}, "c": {"status": "failed", "kind": "flow_collection", "partial_result": {"items": [{"flow": "h", "status": "failed"}]}}}}}}
    want = {"/flows/f~1g": "completed", "/flows/f~1g/result/x": "completed", "/flows/f~1g/steps/plain/result/items/0": "completed", "/flows/f~1g/steps/c/partial_result/items/0/result": "failed", "/flows/f~1g/steps/c/partial_result/items/00": "failed", "/flows/none/x": None, "/payload": None}
    df = spark.createDataFrame([(p,) for p in want], "p string").withColumn("o", rc.owner(parse(F.lit(json.dumps(doc))), F.col("p")))
    got = {r["p"]: (r["o"]["owner"], r["o"]["status"]) for r in df.collect()}
    assert {p: s for p, (_, s) in got.items()} == want
    assert got["/flows/f~1g/steps/c/partial_result/items/0/result"][0].endswith("items/0") and got["/flows/f~1g/steps/plain/result/items/0"][0].endswith("plain") and got["/flows/f~1g/steps/c/partial_result/items/00"][0].endswith("/c")


def test_attempts_are_built_once(monkeypatch):
    """However many pointers go into the attempts of a repeat, its expressions hold them once."""
    from gristmill.plans import workflow as wf

    built = []
    whole = wf._attempts
    monkeypatch.setattr(wf, "_attempts", lambda history, role: built.append(role) or whole(history, role))
    seen = {}
    monkeypatch.setattr(wf, "holds", lambda context, condition: seen.update(context) or F.lit(True))
    monkeypatch.setattr(wf.Workflow, "_retry", lambda self, df, again, context, attempt: df)

    class Rows:
        """Stands for a DataFrame, and keeps the columns that it is given."""

        def __init__(self):
            self.given = {}

        def withColumn(self, name, column):
            self.given[name] = column
            return self

        def withColumns(self, columns):
            self.given |= columns
            return self

        def drop(self, *names):
            return self

    rows = Rows()
    repeat = wf.Repeat(3, {"pointer": "/flows/f/result", "present": True}, {"n": {"first_of": [f"/flows/f/attempts/{k}/attempt" for k in range(3)]}})
    flow = wf.Flow("f", [], repeat=repeat)
    wf.Workflow([flow], "f")._decide(rows, flow, {}, 1)
    assert built == ["attempt"] and str(rows.given["_next"]).count("_tries") >= 3 and "_history" not in str(rows.given["_next"])
