"""JSON values as VARIANT columns: pointers, bindings and templates.

SQL NULL stands for an absent value, a variant null for an explicit null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

Context = Mapping[str, Column]

_INDEX = re.compile(r"0|[1-9][0-9]{0,8}")
_KINDS = {"VOID": "null", "BOOLEAN": "boolean", **dict.fromkeys(("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "number"), "STRING": "string", "ARRAY": "array", "OBJECT": "object"}
_KINDS_MAP = f"map({', '.join(repr(x) for pair in _KINDS.items() for x in pair)})"  # one call to the JVM, not eighteen


def parse(text: Column) -> Column:
    """JSON text as a value; text that is no JSON (also NaN, or a repeated key) is absent."""
    return F.try_parse_json(text)


def literal(value: Any) -> Column:
    return F.parse_json(F.lit(json.dumps(value, ensure_ascii=False)))


def kind(value: Column) -> Column:
    """null, boolean, number, string, array or object; NULL if absent."""
    return F.try_element_at(F.expr(_KINDS_MAP), F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0))


def given(value: Column) -> Column:
    """The value, or absent if it is an explicit null."""
    return F.when(~F.is_variant_null(value), value)


def present(value: Column) -> Column:
    return value.isNotNull() & ~F.is_variant_null(value)  # is_variant_null is false for NULL


def text_of(value: Column) -> Column:
    """The text of a string; NULL of anything else."""
    return F.when(kind(value) == "string", F.try_variant_get(value, "$", "string"))


def number_of(value: Column) -> Column:
    return F.when(kind(value) == "number", F.try_variant_get(value, "$", "double"))


def items_of(value: Column) -> Column:
    """The items of an array; NULL of anything else."""
    return F.when(kind(value) == "array", F.try_variant_get(value, "$", "array<variant>"))


def fields_of(value: Column) -> Column:
    return F.when(kind(value) == "object", F.try_variant_get(value, "$", "map<string,variant>"))


def tokens(pointer: str) -> list[str]:
    """Unescaped tokens of an RFC 6901 pointer of at most 64 tokens."""
    if pointer and not pointer.startswith("/") or re.search(r"~(?![01])", pointer):
        raise ValueError(f"not a JSON pointer: {pointer!r}")
    parts = [t.replace("~1", "/").replace("~0", "~") for t in pointer.split("/")[1:]]
    if len(parts) > 64:
        raise ValueError("a pointer has 64 tokens at most")
    return parts


def member(value: Column, token: str) -> Column:
    """A member of an object, or an item of an array where the token is a number without leading zeros."""
    if "'" in token and '"' in token:
        found = fields_of(value).getItem(token)
    else:
        quote = '"' if "'" in token else "'"
        found = F.try_variant_get(value, f"$[{quote}{token}{quote}]", "variant")
    return F.coalesce(found, F.try_variant_get(value, f"$[{token}]", "variant")) if _INDEX.fullmatch(token) else found


def lookup_static(document: Any, pointer: str) -> Any:
    """What a pointer finds in a document that is no column."""
    for token in tokens(pointer):
        document = document[int(token)] if isinstance(document, list) else document[token]
    return document


def tokens_of(pointer: Column) -> Column:
    """Unescaped tokens of a JSON pointer in a column."""
    return F.transform(F.slice(F.split(pointer, "/"), 2, 64), lambda t: F.replace(F.replace(t, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))


def member_each(value: Column, token: Column) -> Column:
    """As member, with a token in a column."""
    # whole objects and arrays are taken apart, since a path in a column would be parsed anew for each row and token
    named = F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), token)
    index = F.when(token.rlike(r"\A(0|[1-9][0-9]{0,8})\z"), token.try_cast("int"))
    return F.coalesce(named, F.when(index.isNotNull(), F.get(F.try_variant_get(value, "$", "array<variant>"), index)))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """What body makes of a value that is computed once, however often body names it: inside lambdas too, where Spark shares nothing."""
    return F.get(F.transform(F.array(value), body), 0)


def lookup_each(value: Column, pointer: Column) -> Column:
    """What each row's own pointer finds in its value, token by token."""
    return F.aggregate(tokens_of(pointer), value, member_each)


def lookup(context: Context, pointer: str) -> Column:
    """What a pointer finds; the longest root of the context that the pointer goes through holds the document."""
    parts = tokens(pointer)
    for n in range(len(parts), -1, -1):
        root = "".join("/" + p.replace("~", "~0").replace("/", "~1") for p in parts[:n])
        if root in context:
            value = context[root]
            for token in parts[n:]:
                value = member(value, token)
            return value
    return F.lit(None).cast("variant")


def bind(context: Context, binding: Mapping[str, Any]) -> Column:
    """The value of a binding: pointer, first_of, literal (each with a default, if wanted) or fields.

    A default stands for an absent value only; first_of passes over explicit nulls too. NULL: a value is missing.
    """
    kinds = [k for k in ("pointer", "first_of", "literal", "fields") if k in binding]
    if len(kinds) != 1 or set(binding) - {*kinds, "default"}:
        raise ValueError(f"a binding has one of pointer, first_of, literal or fields: {dict(binding)}")
    which = kinds[0]
    if which == "pointer":
        out = lookup(context, binding["pointer"])
    elif which == "first_of":
        if not 1 <= len(binding["first_of"]) <= 16:
            raise ValueError("first_of has 1 to 16 members")
        out = F.coalesce(*(given(lookup(context, p)) for p in binding["first_of"]), F.lit(None).cast("variant"))
    elif which == "literal":
        out = literal(binding["literal"])
    else:
        if len(binding["fields"]) > 128:
            raise ValueError("fields has 128 members at most")
        parts = {k: bind(context, b) for k, b in binding["fields"].items()}
        whole = object_of(parts)
        for part in parts.values():
            whole = F.when(part.isNotNull(), whole)
        out = whole
    return F.coalesce(out, literal(binding["default"])) if "default" in binding else out


def object_of(parts: Mapping[str, Column]) -> Column:
    """An object with exactly these members; an absent one becomes null."""
    if not parts:
        return literal({})
    return F.to_variant_object(F.struct(*(F.coalesce(v, F.parse_json(F.lit("null"))).alias(k) for k, v in parts.items())))


def bind_all(context: Context, bindings: Mapping[str, Mapping[str, Any]]) -> dict[str, Column]:
    return {name: bind(context, b) for name, b in bindings.items()}


def project(value: Column, each: str) -> Column:
    """What the relative pointer finds in every item of an array; NULL if that is no array or an item lacks it."""

    def found(item: Column) -> Column:
        for token in tokens(each):
            item = member(item, token)
        return item

    items = items_of(value)
    return F.when(F.forall(items, lambda x: found(x).isNotNull()), F.transform(items, found))


_PLACE = re.compile(r"(\{{4}|\}{4})|\{\{\s*([a-z][a-z0-9_]*)\s*\}\}")


def render(template: str, inputs: Mapping[str, Column]) -> Column:
    """A template with ``{{ name }}`` replaced by the JSON text of an input, once; four braces stand for two."""
    out, at = [], 0
    for m in _PLACE.finditer(template):
        out.append(F.lit(template[at : m.start()]))
        if m[2] and m[2] not in inputs:
            raise ValueError(f"unknown input {m[2]!r}")
        out.append(F.lit(m[1][:2]) if m[1] else F.to_json(inputs[m[2]]))
        at = m.end()
    return F.concat(*out, F.lit(template[at:]))
