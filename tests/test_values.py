"""Pointers, bindings and conditions against a small model in Python."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gristmill.functions import comparisons as cmp
from gristmill.functions.conditions import full_match, holds
from gristmill.functions.values import bind, parse, project, render, tokens

DOC = {"text": "abc", "none_text": "", "n": 3, "ratio": 2.5, "yes": True, "nothing": None, "items": [1, {"a/b": 2}], "no_items": [], "object": {"0": "zero"}, "number_text": "3"}


def one(spark, column, doc=DOC):
    return spark.createDataFrame([(json.dumps(doc),)], "doc string").withColumn("v", parse(F.col("doc"))).select(column.alias("x")).first()["x"]


def value(spark, binding, doc=DOC):
    got = one(spark, F.to_json(bind({"": F.col("v")}, binding)), doc)
    return None if got is None else json.loads(got)


@pytest.mark.parametrize("pointer, wanted", [("/n", 3), ("/items/0", 1), ("/items/1/a~1b", 2), ("/object/0", "zero"), ("/items/00", None), ("/gone", None), ("/items/9", None), ("/text/0", None)])
def test_pointer(spark, pointer, wanted):
    assert value(spark, {"pointer": pointer}) == wanted


def test_null_is_found_and_absent_takes_the_default(spark):
    assert one(spark, F.to_json(bind({"": F.col("v")}, {"pointer": "/nothing", "default": 1}))) == "null"
    assert value(spark, {"pointer": "/gone", "default": 1}) == 1
    assert value(spark, {"first_of": ["/nothing", "/gone"], "default": 1}) == 1
    assert value(spark, {"fields": {"a": {"pointer": "/n"}, "b": {"pointer": "/gone"}}}) is None


def test_bad_pointers():
    for p in ("a", "/a~2", "/" * 66):
        with pytest.raises(ValueError):
            tokens(p)


def test_project_and_render(spark):
    doc = {"items": [{"id": 1}, {"id": 2}]}
    assert one(spark, F.to_json(project(bind({"": F.col("v")}, {"pointer": "/items"}), "/id")), doc) == "[1,2]"
    assert one(spark, project(bind({"": F.col("v")}, {"pointer": "/items"}), "/gone"), doc) is None
    assert one(spark, render("{{{{ {{ a }} }}}} {{ a }}", {"a": bind({"": F.col("v")}, {"literal": "{{ a }}"})})) == '{{ "{{ a }}" }} "{{ a }}"'


TRUTH = [
    ("n", "gt", 2, True), ("gone", "gt", 2, False), ("number_text", "gt", 2, False), ("yes", "gte", 1, False), ("ratio", "lt", 3, True), ("n", "equals", 3.0, True), ("yes", "equals", 1, False),
    ("nothing", "equals", None, True), ("gone", "not_equals", 3, True), ("gone", "in", [1, None], True), ("text", "not_in", ["x"], True), ("nothing", "present", False, True), ("no_items", "empty", True, True),
    ("n", "empty", True, False), ("none_text", "empty", True, True), ("text", "matches", "a.c", True), ("text", "matches", "a", False), ("n", "matches", "3", False), ("items", "length", {"equals": 2}, True),
    ("object", "length", {"gte": 1, "lt": 2}, True), ("n", "length", {"gte": 0}, False), ("items", "equals", [1, {"a/b": 2.0}], True), ("object", "equals", {"0": "zero", "1": 1}, False),
]


def test_truth_table(spark):
    cs = [{"pointer": f"/{p}", op: arg} for p, op, arg, _ in TRUTH]
    got = one(spark, F.array(*(holds({"": F.col("v")}, c) for c in cs), *(holds({"": F.col("v")}, {"not": c}) for c in cs)))
    assert got == [w for *_, w in TRUTH] + [not w for *_, w in TRUTH]


def test_conditions_are_checked():
    for bad in ({"pointer": "/a"}, {"pointer": "/a", "gt": 1, "lt": 2}, {"all": []}, {"pointer": "/a", "in": []}):
        with pytest.raises(ValueError):
            holds({"": F.lit(None)}, bad)
    for bad in ("(a+)+", "x" * 257):
        with pytest.raises(ValueError):
            full_match(bad)


def test_pattern_takes_the_whole_text(spark):
    c = {"pointer": "/t", "matches": r"\d+"}
    assert [one(spark, holds({"": F.col("v")}, c), {"t": t}) for t in ("12\n", "12", "١٢", "1" * 1025)] == [False, True, True, False]


scalars = st.one_of(st.none(), st.booleans(), st.integers(-5, 5), st.sampled_from([0.5, 1.0, -2.5]), st.sampled_from(["", "a", "1"]))


def model(x, op, arg):
    number = isinstance(x, (int, float)) and not isinstance(x, bool)
    same = lambda a, b: a == b and isinstance(a, bool) == isinstance(b, bool)
    return {"equals": same(x, arg), "not_equals": not same(x, arg), "gt": number and x > 1, "lte": number and x <= 1, "present": x is not None}[op]


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(scalars, scalars), min_size=20, max_size=30))
def test_model(spark, pairs):
    out, wanted = [], []
    docs = spark.createDataFrame([(json.dumps([x for x, _ in pairs]),)], "doc string").select(parse(F.col("doc")).alias("v"))
    for k, (x, y) in enumerate(pairs):
        for op, arg in (("equals", y), ("not_equals", y), ("gt", 1), ("lte", 1), ("present", True)):
            out.append(holds({"": F.col("v")}, {"pointer": f"/{k}", op: arg}))
            wanted.append(model(x, op, arg))
    assert docs.select(F.array(*out).alias("x")).first()["x"] == wanted


def test_equality_of_checks_keeps_types(spark):
    rows = [("1", "1.0", False), ('{"a":1,"b":2}', '{ "b":2, "a":1 }', True), ("null", "null", True), ("NaN(", "1", False), (None, "null", False)]
    df = spark.createDataFrame(rows, "a string, b string, w boolean")
    assert all(r["x"] == r["w"] for r in df.select(cmp.exact(F.col("a"), F.col("b")).alias("x"), "w").collect())
    texts = spark.createDataFrame([("Straße  x", "STRASSE X")], "a string, b string")
    assert texts.select(cmp.same_text(F.col("a"), F.col("b"))).first()[0]


def test_span(spark):
    df = spark.createDataFrame([("aXaXa", "aXa", 2, 3, 1, 5, True), ("aXaXa", "aXa", 0, 1, 1, 5, False), ("😀ab", "ab", 1, 3, 1, 3, True), ("ab", "", 0, 0, 0, 2, False)], "t string, c string, r0 int, r1 int, a0 int, a1 int, w boolean")
    got = df.select(cmp.in_span(F.col("c"), F.col("t"), (F.col("r0"), F.col("r1")), (F.col("a0"), F.col("a1"))).alias("x"), "w").collect()
    assert all(r["x"] == r["w"] for r in got)
