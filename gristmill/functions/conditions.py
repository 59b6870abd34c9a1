"""The condition language as Boolean columns: total and two-valued, never NULL.

A condition is ``{"all": [...]}``, ``{"any": [...]}``, ``{"not": ...}``, or one source (pointer, first_of, literal) with one
operator: present, empty, equals, not_equals, in, not_in, gt, gte, lt, lte, matches, length. An explicit null counts as absent.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import check_pattern
from .values import Context, bind, fields_of, given, items_of, kind, number_of, present, text_of

SOURCES = {"pointer", "first_of", "literal"}
ORDER = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}
OPERATORS = {"present", "empty", "equals", "not_equals", "in", "not_in", "matches", "length", *ORDER}
#: Longer text never matches a pattern.
LONGEST = 1024
TRACE = "array<struct<location: string, operator: string, reason: string>>"


def certain(value: Column) -> Column:
    return F.coalesce(value, F.lit(False))


def equal(value: Column, wanted: Any) -> Column:
    """Deep equality with a literal without coercion; numbers are equal by value, and null equals absent."""
    if wanted is None:
        return ~present(value)
    return certain(_equal(value, wanted))


def _equal(value: Column, wanted: Any) -> Column:
    if wanted is None:
        return F.is_variant_null(value)
    if isinstance(wanted, bool):
        return (kind(value) == "boolean") & (F.try_variant_get(value, "$", "boolean") == F.lit(wanted))
    if isinstance(wanted, int) and abs(wanted) < 10**38:  # wide numbers are compared exactly
        exact = F.try_variant_get(value, "$", "decimal(38,0)")
        return (kind(value) == "number") & (exact == F.lit(str(wanted)).cast("decimal(38,0)")) & (number_of(value) == F.lit(float(wanted)))
    if isinstance(wanted, (int, float)):
        return number_of(value) == F.lit(float(wanted))
    if isinstance(wanted, str):
        return text_of(value) == F.lit(wanted)
    if isinstance(wanted, list):
        items = items_of(value)
        out = certain(F.size(items) == len(wanted))
        for k, w in enumerate(wanted):
            out = out & certain(_equal(F.try_element_at(items, F.lit(k + 1)), w))
        return out
    fields = fields_of(value)
    out = certain(F.size(fields) == len(wanted))
    for k, w in wanted.items():
        out = out & certain(_equal(F.try_element_at(fields, F.lit(k)), w))
    return out


def java_pattern(pattern: str) -> str:
    """A pattern, in the dialect of Python, as one that Java searches for: Unicode classes, line ends as there."""
    re.compile(pattern)
    return f"(?dU){re.sub(r'\(\?P<([A-Za-z][A-Za-z0-9]*)>', r'(?<\1>', pattern)}"


def full_match(pattern: str) -> str:
    """A pattern, in the dialect of Python, as one that Java matches against the whole text."""
    if len(pattern) > 256:
        raise ValueError("a pattern has 256 characters at most")
    check_pattern(pattern, LONGEST)
    return rf"(?dU)\A(?:{java_pattern(pattern).removeprefix('(?dU)')})\z"


def length_of(value: Column) -> Column:
    """Code points of text, items of an array or members of an object."""
    return F.coalesce(F.length(text_of(value)), F.size(items_of(value)), F.size(fields_of(value)))


def _leaf(condition: Mapping[str, Any]) -> tuple[dict, str, Any]:
    source, ops = {k: v for k, v in condition.items() if k in SOURCES}, [k for k in condition if k not in SOURCES]
    if len(source) != 1 or len(ops) != 1 or ops[0] not in OPERATORS:
        raise ValueError(f"a condition has one source and one operator: {dict(condition)}")
    return source, ops[0], condition[ops[0]]


#: Characters that a description has at most (a fixed value).
DESCRIBED = 512


def describe(condition: Mapping[str, Any]) -> str:
    """Where a condition looks and by which operators, without the values that it compares with, so it may stand in logs and
    on edges of drawn graphs."""
    whole = _described(condition)
    return whole if len(whole) <= DESCRIBED else whole[: DESCRIBED - 3] + "..."


def _described(condition: Mapping[str, Any]) -> str:
    if "not" in condition:
        return f"not({_described(condition['not'])})"
    group = next((name for name in ("all", "any") if name in condition), None)
    if group:
        return f"{group}({'; '.join(map(_described, condition[group]))})"
    source, name, argument = _leaf(condition)
    place = source.get("pointer")
    if place is None:
        place = f"first_of({', '.join(source['first_of'])})" if "first_of" in source else "literal"
    said = {"length": lambda: f"length {' '.join(argument) if isinstance(argument, Mapping) else ''}".rstrip(), "present": lambda: f"present={str(argument).lower()}", "empty": lambda: f"empty={str(argument).lower()}"}
    return f"{place or chr(34) * 2} {said[name]() if name in said else name}"


def holds(context: Context, condition: Mapping[str, Any], depth: int = 8) -> Column:
    """Whether a condition holds."""
    return _compiled(context, condition, depth, "")[0]


def trace(context: Context, condition: Mapping[str, Any]) -> Column:
    """Leaves that were reached, in authored order, and met a value of the wrong type or too long a text."""
    return _compiled(context, condition, 8, "")[1]


def _compiled(context: Context, condition: Mapping[str, Any], depth: int, location: str) -> tuple[Column, Column]:
    if depth < 0:
        raise ValueError("conditions nest 8 deep at most")
    for name, stops in (("all", False), ("any", True)):
        if name in condition:
            if set(condition) != {name} or not 1 <= len(condition[name]) <= 32:
                raise ValueError(f"{name} has 1 to 32 operands")
            out, notes = F.lit(not stops), F.array().cast(TRACE)
            for k, operand in enumerate(condition[name]):
                value, note = _compiled(context, operand, depth - 1, f"{location}/{name}/{k}")
                notes = F.concat(notes, F.when(out == F.lit(not stops), note).otherwise(F.array().cast(TRACE)))
                out = out | value if stops else out & value
            return out, notes
    if "not" in condition:
        if set(condition) != {"not"}:
            raise ValueError("not stands alone")
        value, note = _compiled(context, condition["not"], depth - 1, f"{location}/not")
        return ~value, note
    source, name, argument = _leaf(condition)
    value = bind(context, source)
    return _operate(value, name, argument), _note(value, name, location)


def _operate(value: Column, name: str, argument: Any) -> Column:
    if name == "present":
        return present(value) == F.lit(argument)
    if name == "empty":
        return (~present(value) | certain(length_of(value) == 0)) == F.lit(argument)
    if name in ("equals", "not_equals"):
        out = equal(value, argument)
        return out if name == "equals" else ~out
    if name in ("in", "not_in"):
        if not 1 <= len(argument) <= 64:
            raise ValueError("in has 1 to 64 values")
        out = F.lit(False)
        for wanted in argument:
            out = out | equal(value, wanted)
        return out if name == "in" else ~out
    if name in ORDER:
        return certain(ordered(value, name, argument))
    if name == "matches":
        text = text_of(value)
        return certain((F.length(text) <= LONGEST) & text.rlike(full_match(argument)))
    size, out = length_of(value), F.lit(True)
    for k, n in argument.items():
        out = out & certain(size == n if k == "equals" else ORDER[k](size, F.lit(n)))
    return out


def ordered(value: Column, name: str, argument: Any) -> Column:
    near = ORDER[name](number_of(value), F.lit(float(argument)))
    if not isinstance(argument, int) or abs(argument) >= 10**38:
        return near
    whole = F.schema_of_variant(value).rlike(r"\A(BIGINT|DECIMAL\([0-9]+,0\))\z")  # whole numbers are compared exactly
    return F.when(whole, ORDER[name](F.try_variant_get(value, "$", "decimal(38,0)"), F.lit(str(argument)).cast("decimal(38,0)"))).otherwise(near)


def _note(value: Column, name: str, location: str) -> Column:
    what = kind(given(value))
    wrong = {"matches": what != "string", "length": what.isin("number", "boolean")} | dict.fromkeys(ORDER, what != "number")
    if name not in wrong:
        return F.array().cast(TRACE)
    reason = F.when(wrong[name], "incompatible_type")
    if name == "matches":
        reason = reason.when(F.length(text_of(value)) > LONGEST, "value_too_long")
    return F.when(reason.isNotNull(), F.array(F.struct(F.lit(location).alias("location"), F.lit(name).alias("operator"), reason.alias("reason")))).otherwise(F.array()).cast(TRACE)
