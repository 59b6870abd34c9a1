"""Decision steps: questions, inputs, answers, and where their reviews lead."""

import pytest
from pyspark.sql import functions as F

from gristmill.operators import decision_steps as ds
from gristmill.plans.workflow import Flow, Outcome, Step, Workflow


def test_questions():
    (q,) = ds.asked("tone", "Is it kind?", ["a", "b"], ds.Question("predicate"))
    assert (q.id, q.prompt, q.sources) == ("tone", "Is it kind?", ("a", "b"))
    own = ds.Question("predicate", id="x", prompt="?", sources=("a",))
    assert ds.asked("s", "", ["a"], [own]) == [own]
    for wrong in ([], [own, own], [ds.Question("predicate")], [ds.Question("predicate", id="x", prompt="?", sources=("c",))]):
        with pytest.raises(ValueError):
            ds.asked("s", "", ["a"], wrong)


def test_answers(spark):
    one = [ds.Question("choice", ("x", "y"), "q", "?", ("a",))]
    two = [*one, ds.Question("multiselect", ("x", "y", "z"), "m", "?", ("a",), 1, 2)]
    item = '{"question":"%s","status":"%s","issues":[%s],"answer":[%s]}'
    rows = [
        (1, item % ("q", "answerable", "", '"y"')),
        (2, item % ("q", "not_answerable", '"no_supported_answer"', "")),
        (3, item % ("q", "not_answerable", '"no_supported_answer","conflicting_information"', "")),
        (4, item % ("q", "answerable", "", "")),
        (5, item % ("q", "perhaps", "", '"y"')),
        (6, item % ("q", "answerable", "", '"y"') + "," + item % ("q", "answerable", "", '"x"')),
        (7, item % ("q", "answerable", "", '"x","y"')),
        (8, '{"status":"answerable"}'),
    ]
    df = spark.createDataFrame([(k, f'{{"results":[{r}]}}') for k, r in rows] + [(9, None), (10, "[]")], "k int, output string")
    got = {r["k"]: r["d"] for r in df.select("k", ds.decision_result(F.col("output"), one, True, "z", ["no_supported_answer"]).alias("d")).collect()}
    assert {k: (d.problems, d.answerable, d.answer_key, d.issues, d.selection, d.origin) for k, d in got.items() if k < 4} == {
        1: ([], True, "y", [], "y", "model"),
        2: ([], False, None, ["no_supported_answer"], "z", "fallback"),
        3: ([], False, None, ["no_supported_answer", "conflicting_information"], None, None),
    }
    assert {k: d.problems for k, d in got.items() if k > 3} == {4: ["q:answer-required"], 5: ["q:unknown-status"], 6: ["duplicate:q"], 7: ["q:too-many"], 8: ["malformed"], 9: ["malformed"], 10: ["malformed"]}
    both = item % ("m", "partially_answerable", '"multiple_valid_options"', '"z","x"') + "," + item % ("q", "undetermined", '"conflicting_information"', "")
    d = spark.createDataFrame([(f'{{"results":[{both}]}}',)], "output string").select(ds.decision_result(F.col("output"), two).alias("d")).first()["d"]
    assert (d.problems, [r.question for r in d.results], d.answerable, d.issues, d.answer_key) == ([], ["q", "m"], False, [], None)


def test_inputs(spark):
    q = ds.asked("s", "?", ["a"], ds.Question("predicate"))
    df = spark.createDataFrame([(1, '"x "'), (2, '" \\n"'), (3, "5"), (4, None)], "k int, v string")
    value = F.try_parse_json("v")
    got = {r["k"]: (r["t"] and r["t"].sources[0].text, r["j"] and r["j"].sources[0].text) for r in df.select("k", ds.decision_input(q, {"a": value}).alias("t"), ds.decision_input(q, {"a": value}, {"a"}).alias("j")).collect()}
    assert got == {1: ("x ", '"x "'), 2: (None, '" \\n"'), 3: (None, "5"), 4: (None, None)}


def _flow(name, status, issues, origin=None, **more):
    lit = lambda x: F.lit(x).cast("string")
    return Flow(name, [Step("s", lambda i: Outcome(F.parse_json(F.lit("1")), F.lit(status), None, F.array(*map(F.lit, issues)).cast("array<string>"), lit(origin)))], **more)


@pytest.mark.parametrize(
    "status, issues, origin, wanted",
    [
        ("needs_review", ["no_supported_answer"], None, ("completed", None, ["a", "b"])),
        ("needs_review", ["no_supported_answer", "conflicting_information"], None, ("needs_review", None, ["a", "needs_review"])),
        ("needs_review", [], "fallback", ("needs_review", None, ["a", "needs_review"])),
        ("completed", [], "model", ("completed", None, ["a", "completed"])),
        ("completed", ["no_supported_answer"], None, ("failed", "invalid_output", ["a"])),
        ("needs_review", ["other"], None, ("failed", "invalid_output", ["a"])),
        ("needs_review", ["no_supported_answer"] * 2, None, ("failed", "invalid_output", ["a"])),
        ("completed", [], "fallback", ("failed", "invalid_output", ["a"])),
        ("needs_review", [], "model", ("failed", "invalid_output", ["a"])),
        ("completed", [], "oracle", ("failed", "invalid_output", ["a"])),
    ],
)
def test_reviews(spark, status, issues, origin, wanted):
    flows = [_flow("a", status, issues, origin), _flow("b", "completed", [], on_review="needs_review")]
    w = Workflow(flows, "a", on_review={"no_supported_answer": "b", "default": "needs_review"})
    assert ("a", "b") in w.edges() and w.flows[0].on_review == w.on_review and w.flows[1].on_review == "needs_review"
    e = spark.range(1).select(F.col("id").alias("run_id"), F.parse_json(F.lit("{}")).alias("payload"), F.lit(None).cast("variant").alias("metadata"))
    r = w.run(e).first()
    assert (r["status"], r["error"], [t.target for t in r["transitions"]][: len(wanted[2])]) == wanted


def test_wrong_reviews():
    for on_review in ({"no_supported_answer": "needs_review"}, {"other": "needs_review", "default": "needs_review"}):
        with pytest.raises(ValueError):
            Workflow([Flow("a", [])], "a", on_review=on_review)
    with pytest.raises(ValueError, match="review never completes"):
        Workflow([Flow("a", [])], "a", on_review={"no_supported_answer": "completed", "default": "needs_review"}).order()


def test_answers_are_parsed_once(spark):
    """However many rules look at the answers: the plan parses the text in one place."""
    questions = ds.asked("triage", "", ["note"], [ds.Question("predicate", id="a", prompt="?", sources=("note",)), ds.Question("choice", ("x", "y"), "b", "?", ("note",))])
    d = spark.createDataFrame([("{}",)], "output string").select(ds.decision_result(F.col("output"), questions).alias("d")).select("d.problems", "d.results", "d.answerable", "d.issues")
    plan = d._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("from_json(") + plan.count("jsontostructs(") == 1
