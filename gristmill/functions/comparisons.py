"""Comparisons of results with gold values, on JSON text: exact, set, one_of, text, contains, source_span.

Equality here is that of canonical JSON text: 1 and 1.0 differ. A NULL operand stands for an absent value and never matches.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .conditions import certain


def _dumped(text: str | None) -> str | None:
    try:
        return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        return None


@F.pandas_udf(StringType())
def canonical(text: pd.Series) -> pd.Series:
    """JSON text with sorted keys and no white space, numbers as they are written; NULL if it is no JSON."""
    return text.map(_dumped)


@F.pandas_udf(ArrayType(StringType()))
def canonical_items(text: pd.Series) -> pd.Series:
    """Canonical texts of the items of an array; NULL of anything else."""
    return text.map(lambda t: [_dumped(json.dumps(x)) for x in v] if t is not None and _dumped(t) is not None and isinstance(v := json.loads(t), list) else None)


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """Text with full case folding, runs of white space as one space."""
    return text.map(lambda t: None if t is None else " ".join(t.casefold().split()))


def exact(actual: Column, gold: Column) -> Column:
    return certain(canonical(actual) == canonical(gold))


def same_set(actual: Column, gold: Column) -> Column:
    order = lambda c: F.array_sort(F.array_distinct(canonical_items(c)))
    return certain(order(actual) == order(gold))


def one_of(actual: Column, gold: Column) -> Column:
    return certain(F.array_contains(canonical_items(gold), canonical(actual)))


def same_text(actual: Column, gold: Column) -> Column:
    """Both are plain strings, not JSON text."""
    return certain(folded(actual) == folded(gold))


def contains_text(actual: Column, gold: Column) -> Column:
    return certain(folded(actual).contains(folded(gold)))


def in_span(candidate: Column, text: Column, required: tuple[Column, Column], allowed: tuple[Column, Column]) -> Column:
    """Whether the candidate occurs in text within the allowed range of code points, and covers the required one."""
    n = F.length(candidate)
    # the first place from where the required range can be covered, by the JVM's own search
    first = F.greatest(allowed[0], required[1] - n, F.lit(0))
    at = F.call_function("locate", candidate, text, (first + 1).cast("int")) - 1
    return certain((n > 0) & (at >= first) & (at <= required[0]) & (at + n <= allowed[1]))


def category_key(text: Column) -> Column:
    """Lower-case ASCII with runs of anything but letters and digits as one underscore; NULL if none is left or text isn't printable ASCII."""
    key = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(text.rlike(r"\A[\x20-\x7E]*\z") & (key != ""), key)


def fingerprint(text: Column) -> Column:
    return F.sha2(canonical(text), 256)
