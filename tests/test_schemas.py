"""Schemas as columns, and lookups by each row's own pointer, on small values."""

import json

import pytest
from pyspark.sql import functions as F

from gristmill.functions.schemas import valid
from gristmill.functions.values import lookup_each, parse

CASES = [
    (True, [1, None], []),
    (False, [], [1, None]),
    ({"type": "integer"}, [1, 1.0, -3], [1.5, "1", None, True]),
    ({"type": ["string", "null"]}, ["x", None], [1, [], {}]),
    ({"const": None}, [None], [0, ""]),
    ({"enum": [1, "a", [1, {"b": None}]]}, [1, 1.0, "a", [1, {"b": None}]], [2, [1, {}], None]),
    ({"multipleOf": 0.5}, [1, 1.5, "x"], [1.25]),
    ({"minimum": 2, "exclusiveMaximum": 4}, [2, 3.5, "x"], [4, 1]),
    ({"minLength": 2, "maxLength": 3}, ["ab", "äöü", 1], ["a", "abcd"]),
    ({"pattern": "b+"}, ["abba", 1], ["a"]),
    ({"prefixItems": [{"type": "string"}, {"type": "number"}], "items": False}, [[], ["a"], ["a", 1], "x"], [[1], ["a", 1, 2]]),
    ({"contains": {"type": "number"}, "minContains": 2, "maxContains": 3}, [[1, 2], [1, "a", 2, 3]], [[1], [1, 2, 3, 4]]),
    ({"uniqueItems": True, "minItems": 1}, [[1, "1", True], [[1], [2]]], [[], [1, 1.0], [{"a": 1}, {"a": 1}]]),
    ({"properties": {"0": {"type": "null"}}, "required": ["0"]}, [{"0": None}, 5], [{}, {"0": 1}]),
    ({"properties": {"a": True}, "patternProperties": {"^x": {"type": "number"}}, "additionalProperties": {"type": "string"}}, [{"a": [], "x1": 1, "b": "s"}, {}], [{"x1": "s"}, {"b": 1}]),
    ({"propertyNames": {"maxLength": 2}, "maxProperties": 2}, [{"ab": 1}], [{"abc": 1}, {"a": 1, "b": 1, "c": 1}]),
    ({"dependentRequired": {"a": ["b"]}}, [{}, {"b": 1}, {"a": 1, "b": 1}], [{"a": 1}]),
    ({"oneOf": [{"type": "number"}, {"minimum": 3}]}, [1, "x"], [4]),
    ({"allOf": [{"not": {"type": "null"}}, {"anyOf": [{"const": 1}, {"type": "object"}]}]}, [1, {}], [None, 2]),
    ({"if": {"type": "string"}, "then": {"minLength": 1}, "else": {"type": "number"}}, ["a", 2], ["", []]),
    ({"$ref": "#/$defs/a~1b", "$defs": {"a/b": {"items": {"$ref": "#/$defs/n"}}, "n": {"type": "number"}}}, [[1, 2], []], [["a"]]),
]


def test_schemas(spark):
    values = [(n, json.dumps(v), good) for n, (_, *sides) in enumerate(CASES) for good, side in zip((True, False), sides) for v in side]
    df = spark.createDataFrame(values, "n int, text string, good boolean").withColumn("v", parse(F.col("text")))
    for n, (schema, *_) in enumerate(CASES):
        wrong = df.where(F.col("n") == n).where(valid(F.col("v"), schema) != F.col("good")).select("text").collect()
        assert not wrong, (schema, wrong)


def test_absent_and_refused(spark):
    df = spark.range(1).select(parse(F.lit("no json")).alias("v"))
    assert df.select(valid(F.col("v"), True)).first()[0] is False
    for schema in ({"$ref": "#/$defs/a", "$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}}, {"$ref": "other.json"}, {"minimun": 1}, {"type": "text"}):
        with pytest.raises(ValueError):
            valid(F.col("v"), schema)


def test_lookup_each(spark):
    doc = json.dumps({"a": [{"b/c": 1}, 2], "0": {"x y": "z", "1": [[5]]}, "": 3, "\"'": {"q": [7]}})
    want = {"/a/0/b~1c": "1", "/a/1": "2", "/0/x y": '"z"', "/none": None, "/a/9": None, "/0/1/0/0": "5", "/a/00": None, "/\"'/q/0": "7", "/": "3", "": doc.replace(", ", ",").replace(": ", ":")}
    rows = spark.createDataFrame([(p,) for p in want], "p string").select("p", F.to_json(lookup_each(parse(F.lit(doc)), F.col("p"))).alias("found")).collect()
    assert {r.p: r.found if r.p else json.loads(r.found) for r in rows} == {p: w if p else json.loads(w) for p, w in want.items()}
