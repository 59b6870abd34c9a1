"""Schemas that recur, on nested values; the cases of the column form hold here too."""

import json

import pytest
from gristmill.functions.conditions import full_match
from gristmill.functions.patterns import UnsafePattern, check_pattern
from gristmill.functions.schemas import valid
from gristmill.functions.values import parse
from gristmill.operators.nested_schemas import validate
from pyspark.sql import functions as F
from test_schemas import CASES

TREE = {"$ref": "#/$defs/tree", "$defs": {"tree": {"type": "object", "properties": {"v": {"type": "integer"}, "kids": {"type": "array", "items": {"$ref": "#/$defs/tree"}}}, "additionalProperties": False}}}
GAME = {"$defs": {"win": {"contains": {"not": {"$ref": "#/$defs/win"}}, "type": "array"}}, "$ref": "#/$defs/win"}


def wins(v):
    return any(not wins(x) for x in v)


def judged(spark, values, schema, registry=None):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, text string").withColumn("v", parse(F.col("text")))
    verdicts, broken = validate(df, "k", "v", schema, registry)
    return {r["k"]: r["valid"] for r in verdicts.collect()}, sorted(map(tuple, broken.collect()))


def test_recurring(spark):
    deep = {"v": 1}
    for n in range(12):
        deep = {"v": n, "kids": [deep, {"v": n}]}
    bad = json.loads(json.dumps(deep).replace('"v": 3', '"v": "3"', 1))
    values = [json.dumps(v) for v in (deep, bad, {"kids": [{"kids": [{"secret": 1}]}]}, {"kids": {}}, [])] + [None, "no json"]
    good, broken = judged(spark, values, TREE)
    assert good == {0: True, 1: False, 2: False, 3: False, 4: False, 5: False, 6: False}
    assert broken == [(1, "/kids/0" * 8 + "/v", "type"), (2, "/kids/0/kids/0/*", "false"), (3, "/kids", "type"), (4, "", "type")]


def test_negation_below(spark):
    """A verdict that turns with every level: who is to move wins if some move loses."""
    values = [[], [[]], [[[]]], [[], [[]]], [[[], [[]]], [[[]]]], [[[[]]], [[], []]]]
    assert judged(spark, list(map(json.dumps, values)), GAME)[0] == {k: wins(v) for k, v in enumerate(values)}


def test_registry_and_refused(spark):
    registry = {"a/b.json": {"items": {"$ref": "../c.json#/$defs/n"}}, "c.json": {"$defs": {"n": {"type": "number", "maximum": 9007199254740992}}}}
    good, broken = judged(spark, ["[1, 2.5]", "[9007199254740993]", "[[]]"], {"$ref": "a/b.json"}, registry)
    assert good == {0: True, 1: False, 2: False} and broken == [(1, "/0", "maximum"), (2, "/0", "type")]
    for schema in ({"$ref": "none.json"}, {"$ref": "#"}, {"anyOf": [{"$ref": "#"}]}, {"minimun": 1}):
        with pytest.raises(ValueError):
            judged(spark, ["1"], schema)


@pytest.mark.parametrize("n", range(0, len(CASES), 3))
def test_as_columns(spark, n):
    schema, fit, unfit = CASES[n]
    good, _ = judged(spark, [json.dumps(v) for v in [*fit, *unfit]], schema)
    assert list(good.values()) == [True] * len(fit) + [False] * len(unfit)


def test_exact_bounds_and_unicode(spark):
    one = lambda text, schema: spark.range(1).select(valid(parse(F.lit(text)), schema)).first()[0]
    assert not one("9007199254740992", {"minimum": 9007199254740993}) and one("9007199254740993", {"minimum": 9007199254740993})
    assert one('"é"', {"pattern": r"^\w+$"}) and one('"٣"', {"pattern": r"^\d$"}) and not one('"a"', {"pattern": r"^\d$"})
    assert not one('{"é": 1}', {"patternProperties": {r"^\w$": {"type": "string"}}, "additionalProperties": True})


def test_patterns():
    for p in (r"(a|a)*", r"(a|ab)*c", r"((a+)b?)*", "(a+)+", r"(\s*x)*", "(a{1,2})*", "(a{1,2}){1,40}", "a*a*a*a*b", "(", "(?:ab|Ab)*", "(x?){0,50}", "((a{1,2}){1,40}){1,40}"):
        with pytest.raises(UnsafePattern):
            check_pattern(p, 1024)
    for p in (r"\d+(?:\.\d+)?", ".*a.*b.*", "(?:foo|bar)+", "(a{1,2}){1,4}", "(?>a+)+", "(a++)+", "[a-z]+-[0-9]{4}", "(a|b)*", "(?P<x>a)(?(x)b|c)", "(?=a+)b", "a{2,5}", "(?:a|A)*"):
        check_pattern(p, 1024)
    with pytest.raises(ValueError):
        full_match("(a|ab)*c")
