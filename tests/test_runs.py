"""Workflows, journals, streams and comparisons on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from gristmill.functions.values import literal, parse
from gristmill.operators import compare as cp
from gristmill.operators import decisions as dc
from gristmill.operators import metrics as mt
from gristmill.plans.workflow import Cases, Flow, Outcome, Repeat, Step, Workflow, identity_error
from gristmill.sources import journal
from gristmill.sources.envelopes import decode, read_envelopes, read_gold
from gristmill.streaming.runs import run_stream, stream_envelopes


def envelopes(spark, *payloads):
    df = spark.createDataFrame([(k, json.dumps(p)) for k, p in enumerate(payloads)], "run_id long, p string")
    return df.select("run_id", parse(F.col("p")).alias("payload"), literal({}).alias("metadata"))


ECHO = Step("echo", lambda i: i["x"], {"x": {"pointer": "/payload/x"}})


def test_failure_keeps_the_payload_and_skips_the_rest(spark):
    flows = [Flow("a", [ECHO, Step("late", lambda i: literal(1))], "b", output={"pointer": "/steps/echo/result"}), Flow("b", [ECHO])]
    got = {r["run_id"]: r for r in Workflow(flows, "a").run(envelopes(spark, {"x": 1}, {"y": 1})).withColumn("payload", F.to_json("payload")).collect()}
    assert (got[0]["status"], got[0]["b"]["status"], got[0]["steps_used"]) == ("completed", "completed", 3)
    assert (got[1]["status"], got[1]["error"], got[1]["payload"]) == ("failed", "missing_binding", '{"y":1}')
    assert (got[1]["a"]["steps"]["late"]["status"], got[1]["b"]["status"]) == ("skipped", "skipped")


def test_cases_fail_on_other_types(spark):
    w = Workflow([Flow("a", [ECHO], Cases("/payload/x", {"go": "completed"}, "needs_review"))], "a")
    got = [r["status"] for r in w.run(envelopes(spark, {"x": "go"}, {"x": None}, {"x": "no"}, {"x": 3})).orderBy("run_id").collect()]
    assert got == ["completed", "needs_review", "needs_review", "failed"]


def test_repeat_stops_on_review_and_when_exhausted(spark):
    step = Step("s", lambda i: Outcome(i["x"], F.when(F.to_json(i["x"]) == "9", "needs_review").otherwise("completed")), {"x": {"pointer": "/payload/x"}})
    w = Workflow([Flow("a", [step], repeat=Repeat(3, {"pointer": "/flows/a/result/x", "equals": 1}))], "a")
    got = [(r["a"]["stopped_by"], r["a"]["attempts"]) for r in w.run(envelopes(spark, {"x": 1}, {"x": 2}, {"x": 9})).orderBy("run_id").collect()]
    assert got == [("until", 1), ("exhausted", 3), ("review", 1)]


def test_provider_sees_only_the_rows_that_need_it(spark):
    def provider(asked):
        return asked.select("run_id", F.concat(F.lit("["), "x", F.lit("]")).alias("result"), F.when(F.col("x") == "2", "failed").otherwise("completed").alias("status"))

    step = Step("call", inputs={"x": {"pointer": "/payload/x"}}, when={"pointer": "/payload/x", "lt": 3}, provider=provider)
    got = Workflow([Flow("a", [step])], "a").run(envelopes(spark, {"x": 1}, {"x": 2}, {"x": 3})).select("run_id", "status", "error", "a.steps.call.status", F.to_json("a.steps.call.result").alias("r")).orderBy("run_id").collect()
    assert [tuple(r)[1:] for r in got] == [("completed", None, "completed", "[1]"), ("failed", "dependency_failure", "failed", None), ("completed", None, "skipped", None)]


def test_step_limit(spark):
    got = Workflow([Flow("a", [ECHO, Step("b", lambda i: literal(1))])], "a", max_steps=1).run(envelopes(spark, {"x": 1})).first()
    assert (got["status"], got["error"], got["steps_used"]) == ("failed", "step_limit", 1)


@pytest.mark.parametrize("flows, start", [([Flow("a", [], "b"), Flow("b", [], "a")], "a"), ([Flow("a", [], "gone")], "a"), ([Flow("a", []), Flow("b", [])], "a"), ([Flow("a", [], on_review="completed")], "a"), ([Flow("a", [], [(None, "completed"), (None, "completed")])], "a")])
def test_graph_is_checked(flows, start):
    with pytest.raises(ValueError):
        Workflow(flows, start).order()


def test_mermaid():
    assert Workflow([Flow("a", [])], "a").mermaid() == "flowchart TD\n  start --> a\n  a --> completed\n  a --> needs_review"


def test_identity(spark):
    df = spark.createDataFrame([('{"tenant_id":"t"}',), ('{"tenant_id":"u"}',), ("{}",)], "m string").select(identity_error(parse(F.col("m")), F.lit("t"), F.lit("p")).alias("e"))
    assert [r["e"] for r in df.collect()] == [None, "forbidden", None]


def test_envelopes(spark, tmp_path):
    deep = "[" * 70 + "]" * 70
    lines = ['{"payload": {"a": 1}}', '{"payload": 1, "payload": 2}', '{"payload": NaN}', f'{{"payload": {deep}}}', '{"payload": 1, "x": 2}', '{"metadata": {}}', "", '{"payload": "[[[", "metadata": {"a": 1}}']
    got = decode(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r["error"] for r in got] == [None, *["invalid_input"] * 6, None]
    (tmp_path / "in.jsonl").write_text("\n".join(lines[:2]))
    assert read_envelopes(spark, str(tmp_path)).select("run_id").distinct().count() == 2


def test_gold(spark, tmp_path):
    gold = {"name": "g", "revision": "1", "suites": [{"name": "s", "cases": [{"id": "c", "input": {"payload": 1}, "expectations": [{"name": "n", "path": "/x", "expected": None, "comparison": "exact"}, {"name": "m", "path": "/y", "expected": 2, "comparison": "exact"}]}]}]}
    (tmp_path / "gold.json").write_text(json.dumps(gold))
    got = read_gold(spark, str(tmp_path)).orderBy("check_ordinal").collect()
    assert [(r["case_id"], r["name"], r["expected"], r["input"]) for r in got][1] == ("c", "m", "2", '{"payload":1}')


def test_journal(spark, tmp_path):
    path = str(tmp_path / "j")
    rows = [("i", "a", 1, 1, '{"x": 1}', 0.5, "old"), ("i", "a", 1, 2, '{"x": 1}', 0.5, "new"), ("other", "b", 1, 1, "{}", 0.5, "r")]
    df = spark.createDataFrame(rows, "identity string, case_id string, repetition int, w long, input string, seconds double, result string").withColumn("written", F.timestamp_seconds("w")).drop("w")
    journal.record(df, path)
    own = journal.load(spark, path, "i")
    assert [r["result"] for r in own.collect()] == ["new"]
    gold = spark.createDataFrame([("a", 1, '{ "x":1 }'), ("c", 1, "{}")], "case_id string, repetition int, input string")
    assert [r["case_id"] for r in journal.to_run(gold, own).collect()] == ["c"]
    assert journal.replay(gold.where("case_id = 'a'"), own.select("case_id", "repetition", "input", "result")).count() == 1
    with pytest.raises(ValueError):
        journal.replay(gold, own.select("case_id", "repetition", "input"))
    report = str(tmp_path / "r")
    journal.write_report(gold, report)
    with pytest.raises(Exception, match="exists"):
        journal.write_report(gold, report)


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"payload": {"x": 1}}\n{"payload": {}}\nno json\n')
    run_stream(Workflow([Flow("a", [ECHO])], "a"), stream_envelopes(spark, str(tmp_path / "in")), str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "runs")).collect()
    assert sorted((r["status"], r["error"] or "") for r in got) == [("completed", ""), ("failed", "invalid_input"), ("failed", "missing_binding")]


def test_compare(spark):
    def side(outcomes):
        return spark.createDataFrame([(c, 1, k, o) for c, os in outcomes.items() for k, o in enumerate(os)], "case_id string, repetition int, check_ordinal int, outcome string")

    a, b = side({"x": ["passed", "failed"], "y": ["failed"], "z": ["missing"]}), side({"x": ["failed", "passed"], "y": ["passed"], "z": ["error"]})
    assert {r["case_id"]: r["change"] for r in cp.compare_cases(a, b).collect()} == {"x": "mixed", "y": "improved", "z": "unchanged"}
    low, high = cp.ratio_interval(cp.case_samples(a))
    assert 0 <= low <= 0.25 <= high <= 1 and cp.ratio_interval(cp.case_samples(a)) == (low, high)
    assert cp.ratio_interval(cp.case_samples(a.where("case_id = 'x'"))) is None
    assert not cp.unmatched(a, b.where("case_id <> 'z'"), ["case_id"]).isEmpty()


def test_relations(spark):
    r = spark.createDataFrame([("a", "1", "2", "requires"), ("a", "2", "3", "requires"), ("a", "3", "1", "requires"), ("b", "1", "2", "requires"), ("b", "2", "2", "requires"), ("c", "1", "2", "requires"), ("c", "2", "1", "excludes")], "run_id string, source string, target string, kind string")
    assert {x["run_id"] for x in dc.requirement_cycles(r).collect()} == {"a", "b"}
    got = {(x["run_id"], x["source"], x["target"]): x["problems"] for x in dc.relation_problems(r).collect()}
    assert got["b", "2", "2"] == ["self", "cycle"] and got["b", "1", "2"] == [] and all(got["a", x, y] == ["cycle"] for x, y in ("12", "23", "31"))
    assert got["c", "1", "2"] == [] and got["c", "2", "1"] == ["exclusive_dependency"]
    chain = spark.createDataFrame([("d", k, k + 1, "requires") for k in range(70)] + [("d", 70, 0, "excludes"), ("d", 0, 70, "excludes")], "run_id string, source long, target long, kind string")
    assert dc.requirement_cycles(chain).isEmpty()
    assert [x["problems"] for x in dc.relation_problems(chain).where("kind = 'excludes'").collect()] == [["duplicate", "exclusive_dependency"]] * 2


def test_providers_scan_the_source_once(spark, tmp_path):
    """Each provider step starts from rows that are written down, so the source is not in its plan again."""
    seen = []

    def give(asked):
        seen.append(asked._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return asked.select("run_id", F.lit("1").alias("result"), F.lit("completed").alias("status"))

    envelopes(spark, {"x": 1}, {"x": 2}).select("run_id", F.to_json("payload").alias("p")).write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s")).select("run_id", parse(F.col("p")).alias("payload"), literal({}).alias("metadata"))
    steps = [Step(f"s{k}", inputs={"x": {"pointer": "/payload/x"}}, provider=give) for k in range(4)]
    out = Workflow([Flow("f", steps)], "f").run(df)
    assert out.count() == 2 and seen == [0] * 4


def test_empty_evaluations(spark):
    """Without rows, counts are 0, rates unknown, and no field has gold."""
    none = spark.createDataFrame([], "case_id long, status string, path string, check_ordinal int, gold string")
    counts = cp.compare_statuses(none, none).collect()
    assert len(counts) == 5 and all(r["before"] == r["after"] == r["delta"] == 0 for r in counts)
    (rates,) = cp.compare_status_rates(none, none).collect()
    assert all(v is None for v in rates)
    one_side = none.limit(0).unionByName(spark.createDataFrame([(1, "failed", "/r/x", 0, "g")], none.schema))
    (rates,) = cp.compare_status_rates(none, one_side).collect()
    assert rates["after_failure_rate"] == 1.0 and rates["after_review_rate"] == 0.0 and rates["failure_rate_delta"] is None
    assert mt.field_gold(none, "/r", ["x"]).isEmpty() and mt.field_gold(one_side, "/r", []).isEmpty()
    assert [tuple(r) for r in mt.field_gold(one_side, "/r", ["y", "x"]).collect()] == [(1, 1, "x", "g")]
