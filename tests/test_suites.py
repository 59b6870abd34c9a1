"""Evaluations that run: journals, repetitions, refused cases."""

import json

import pytest
from gristmill.operators import suites as st
from gristmill.plans.workflow import Flow, Outcome, Step, Workflow
from pyspark.sql import functions as F


def suite(spark, *xs):
    rows = [(f"c{k}", json.dumps(x)) for k, x in enumerate(xs)]
    cases = spark.createDataFrame(rows, "case_id string, input string")
    gold = cases.select("case_id", F.lit(0).alias("check_ordinal"), F.lit("/flows/a/result/x").alias("path"), F.lit("1").alias("expected"), F.lit("exact").alias("comparison"), F.lit(False).alias("absent_as_null"))
    return cases, gold


def test_resumes_from_the_journal(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def provider(asked):
        rows = [tuple(r) for r in asked.collect()]
        calls.add(len(rows))
        return spark.createDataFrame([(r, x, "failed" if x == "9" else "completed") for r, x in rows], "run_id string, result string, status string")

    w = Workflow([Flow("a", [Step("s", inputs={"x": {"pointer": "/payload/x"}}, provider=provider)])], "a")
    cases, gold = suite(spark, {"payload": {"x": 1}}, {"payload": {"x": 2}}, {"payload": {"x": 9}}, {"load": 1})
    path = f"file://{tmp_path}/journal"
    first = st.run_suite(cases, gold, w, 2, path, "suite-1")
    assert sorted((r["case_id"], r["repetition"], r["status"], r["code"], r["resumed"]) for r in first.attempts.collect()) == [
        ("c0", 1, "completed", None, False), ("c0", 2, "completed", None, False), ("c1", 1, "completed", None, False), ("c1", 2, "completed", None, False),
        ("c2", 1, "failed", "dependency_failure", False), ("c2", 2, "failed", "dependency_failure", False), ("c3", 1, "failed", "invalid_input", False), ("c3", 2, "failed", "invalid_input", False),
    ]
    assert calls.value == 6 and st.repetition_problems(first.attempts, 2).isEmpty()
    changed = cases.withColumn("input", F.when(F.col("case_id") == "c1", '{"payload": {"x": 5}}').otherwise(F.col("input")))
    again = st.run_suite(changed, gold, w, 2, path, "suite-1")
    assert calls.value == 10  # the failed ones and those with another input
    assert {(r["case_id"], r["resumed"]) for r in again.attempts.collect()} == {("c0", True), ("c1", False), ("c2", False), ("c3", False)}
    assert sorted((r["case_id"], r["outcome"], r["owner_status"]) for r in again.checks.where("repetition = 1").collect()) == [("c0", "passed", "completed"), ("c1", "failed", "completed"), ("c2", "error", "failed"), ("c3", "missing", None)]
    r = again.report().first()
    assert (r["runs"], r["resumed"], r["source_cases"], r["total"], r["passed"]) == (8, 2, 4, 8, 2)
    st.run_suite(cases, gold, w, 2, path, "another")
    assert calls.value == 16


def test_repetitions_and_repeated_cases(spark):
    cases, gold = suite(spark, {"payload": {"x": 1}})
    w = Workflow([Flow("a", [Step("s", lambda i: Outcome(i["x"]), {"x": {"pointer": "/payload/x"}})])], "a")
    with pytest.raises(ValueError):
        st.run_suite(cases.unionByName(cases), gold, w)
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1), ("c", 1), ("d", 2), ("d", 3), ("e", None), ("e", 1)], "case_id string, repetition int")
    assert sorted(map(tuple, st.repetition_problems(rows, 2).collect())) == [("b", "incomplete"), ("c", "repeated"), ("d", "incomplete"), ("e", "repeated")]
    assert st.run_suite(cases.where("false"), gold, w).checks.count() == 0


def test_saved_evaluations(spark, tmp_path):
    from gristmill.plans.workflow import flow_input, run_step
    from gristmill.sources import reports as rp
    from test_runs import envelopes

    w = Workflow([Flow("a", [Step("s", lambda i: Outcome(i["x"]), {"x": {"pointer": "/payload/x"}}, when={"pointer": "/payload/none", "present": True})])], "a")
    cases, gold = suite(spark, {"payload": {"x": 1}}, {"payload": {"x": 2}})
    one, two, three = (f"file://{tmp_path}/{k}" for k in "123")
    rp.save(st.run_suite(cases, gold, w), one)
    rp.save(st.run_suite(cases.where("case_id = 'c0'"), gold, w), two)
    assert rp.compare_saved(spark, one, one)[1].first()["unchanged"] == 2
    with pytest.raises(ValueError):
        rp.compare_saved(spark, one, two)
    with pytest.raises(Exception):
        rp.save(st.run_suite(cases, gold, w), one)
    saved = st.run_suite(cases, gold, w, 2)
    rp.save(saved._replace(attempts=saved.attempts.where("repetition = 2 OR case_id = 'c0'")), three, 2)
    with pytest.raises(ValueError):
        rp.read(spark, three)
    assert run_step(w, "a", "s", envelopes(spark, {"x": 4})).select(F.to_json("payload")).first()[0] == "4"
    for call in (lambda: flow_input(w, "none", F.lit(1), F.lit(1)), lambda: run_step(w, "a", "t", None), lambda: flow_input(w, "a", F.lit(1), F.lit(1), {"b": F.lit(1)})):
        with pytest.raises(ValueError):
            call()
