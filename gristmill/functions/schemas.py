"""JSON Schema (draft 2020-12) as Boolean columns over values.

A schema is compiled to one expression; references to ``$defs`` are followed, unless they recur (see nested_schemas). ``format`` and the
annotations assert nothing, and a keyword that is not known is refused. Items of arrays are told apart as JSON text, so
1 and 1.0 inside items that are arrays or objects are two values to ``uniqueItems``.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .conditions import ORDER, certain, equal, java_pattern, ordered
from .values import fields_of, items_of, kind, lookup_static, member, number_of, text_of

Schema = bool | Mapping[str, Any]
#: Keywords that assert nothing.
SILENT = {"$schema", "$comment", "$defs", "definitions", "title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly"}
BOUNDS = {"minimum": "gte", "maximum": "lte", "exclusiveMinimum": "gt", "exclusiveMaximum": "lt"}
SIZES = {"minLength": ("string", "gte"), "maxLength": ("string", "lte"), "minItems": ("array", "gte"), "maxItems": ("array", "lte"), "minProperties": ("object", "gte"), "maxProperties": ("object", "lte")}
MEASURE = {"string": lambda v: F.length(text_of(v)), "array": lambda v: F.size(items_of(v)), "object": lambda v: F.size(fields_of(v))}
#: Schemas nest at most so deep.
DEEPEST = 32


class Rule(NamedTuple):
    location: str
    keyword: str
    ok: Column


def valid(value: Column, schema: Schema) -> Column:
    """Whether a value fits a schema; an absent value does not."""
    return value.isNotNull() & _fits(value, schema, schema, ())


def violations(value: Column, schema: Schema) -> Column:
    """Broken keywords with their places in the schema's properties, in authored order, without any content of the value."""
    broken = [F.when(~r.ok, F.lit(f"{r.location} {r.keyword}".strip())) for r in _rules(value, schema, schema, (), "")]
    return F.when(value.isNotNull(), F.array_compact(F.array(*broken, F.lit(None).cast("string"))))


def _fits(value: Column, schema: Schema, root: Schema, via: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for rule in _rules(value, schema, root, via, ""):
        out = out & rule.ok
    return out


def _of(value: Column, name: str, ok: Column) -> Column:
    """A rule for values of one kind; others pass."""
    return F.when(kind(value) == name, certain(ok)).otherwise(True)


def _typed(value: Column, name: str) -> Column:
    if name == "integer":
        return certain(number_of(value) == F.floor(number_of(value)))
    if name not in ("null", "boolean", "number", "string", "array", "object"):
        raise ValueError(f"unknown type {name!r}")
    return certain(kind(value) == name)


def _rules(value: Column, schema: Schema, root: Schema, via: tuple[str, ...], at: str) -> list[Rule]:
    if isinstance(schema, bool):
        return [] if schema else [Rule(at, "false", F.lit(False))]
    if len(via) > DEEPEST:
        raise ValueError(f"schemas nest {DEEPEST} deep at most")
    fits = lambda v, s: _fits(v, s, root, (*via, ""))
    out: list[Rule] = []
    for word, arg in schema.items():
        if word in SILENT or word in ("then", "else"):
            continue
        if word == "$ref":
            if arg in via:
                raise ValueError(f"schema {arg!r} recurs; a column has a finite depth")
            if not arg.startswith("#"):
                raise ValueError(f"reference to another document: {arg!r}")
            out += _rules(value, lookup_static(root, arg[1:]), root, (*via, arg), at)
        elif word == "properties":
            for name, own in arg.items():
                child = F.when(kind(value) == "object", member(value, name))
                out += [Rule(r.location, r.keyword, child.isNull() | r.ok) for r in _rules(child, own, root, (*via, ""), f"{at}/{name}")]
        elif word == "allOf":
            for part in arg:
                out += _rules(value, part, root, (*via, ""), at)
        else:
            out.append(Rule(at, word, _asserted(value, word, arg, schema, fits)))
    return out


def _asserted(value: Column, word: str, arg: Any, schema: Mapping[str, Any], fits) -> Column:
    total = lambda parts: sum((p.cast("int") for p in parts), F.lit(0))
    match word:
        case "type":
            return total(_typed(value, t) for t in ([arg] if isinstance(arg, str) else arg)) > 0
        case "const":
            return _same(value, arg)
        case "enum":
            return total(_same(value, x) for x in arg) > 0
        case "minimum" | "maximum" | "exclusiveMinimum" | "exclusiveMaximum":
            return _of(value, "number", ordered(value, BOUNDS[word], arg))
        case "multipleOf":
            return _of(value, "number", F.rint(number_of(value) / F.lit(float(arg))) * F.lit(float(arg)) == number_of(value))
        case "minLength" | "maxLength" | "minItems" | "maxItems" | "minProperties" | "maxProperties":
            name, order = SIZES[word]
            return _of(value, name, ORDER[order](MEASURE[name](value), F.lit(arg)))
        case "pattern":
            return _of(value, "string", text_of(value).rlike(java_pattern(arg)))
        case "required":
            return _of(value, "object", F.size(F.array_except(F.array(*map(F.lit, arg)).cast("array<string>"), F.map_keys(fields_of(value)))) == 0)
        case "prefixItems":
            items = items_of(value)
            each = [F.coalesce(F.size(items) <= k, F.lit(True)) | fits(F.try_element_at(items, F.lit(k + 1)), s) for k, s in enumerate(arg)]
            return _of(value, "array", total(each) == len(arg))
        case "items":
            rest = F.slice(items_of(value), F.lit(len(schema.get("prefixItems", [])) + 1), F.size(items_of(value)))
            return _of(value, "array", F.forall(rest, lambda x: fits(x, arg)))
        case "contains" | "minContains" | "maxContains":
            n = F.size(F.filter(items_of(value), lambda x: fits(x, schema.get("contains", True))))
            if word == "contains":
                return _of(value, "array", n >= schema.get("minContains", 1))
            return _of(value, "array", n <= arg) if word == "maxContains" and "contains" in schema else F.lit(True)
        case "uniqueItems":
            text = F.transform(items_of(value), lambda x: F.coalesce(F.concat(F.lit("n"), number_of(x).cast("string")), F.to_json(x)))
            return _of(value, "array", F.size(text) == F.size(F.array_distinct(text))) if arg else F.lit(True)
        case "patternProperties":
            one = lambda p, s: F.forall(F.map_entries(fields_of(value)), lambda e: ~e.key.rlike(java_pattern(p)) | fits(e.value, s))
            each = [one(p, s) for p, s in arg.items()]
            return _of(value, "object", total(map(certain, each)) == len(each))
        case "additionalProperties":

            def known(e: Column) -> Column:
                named = e.key.isin(*schema.get("properties", {})) if schema.get("properties") else F.lit(False)
                for p in schema.get("patternProperties", {}):
                    named = named | e.key.rlike(java_pattern(p))
                return named | fits(e.value, arg)

            return _of(value, "object", F.forall(F.map_entries(fields_of(value)), known))
        case "propertyNames":
            return _of(value, "object", F.forall(F.map_keys(fields_of(value)), lambda k: fits(F.try_variant_get(F.to_variant_object(F.struct(k.alias("k"))), "$.k", "variant"), arg)))
        case "dependentRequired":
            keys = F.map_keys(fields_of(value))
            each = [~F.array_contains(keys, name) | (F.size(F.array_except(F.array(*map(F.lit, needs)).cast("array<string>"), keys)) == 0) for name, needs in arg.items()]
            return _of(value, "object", total(map(certain, each)) == len(each))
        case "anyOf":
            return total(fits(value, s) for s in arg) > 0
        case "oneOf":
            return total(fits(value, s) for s in arg) == 1
        case "not":
            return ~fits(value, arg)
        case "if":
            return F.when(fits(value, arg), fits(value, schema.get("then", True))).otherwise(fits(value, schema.get("else", True)))
    raise ValueError(f"unknown keyword {word!r}")


def asserted(value: Column, word: str, arg: Any, schema: Mapping[str, Any]) -> Column:
    """What a keyword says of a value by itself; schemas inside it (propertyNames) do not recur."""
    return _asserted(value, word, arg, schema, lambda v, s: _fits(v, s, s, ("",)))


def _same(value: Column, wanted: Any) -> Column:
    return certain(F.is_variant_null(value)) if wanted is None else equal(value, wanted)
