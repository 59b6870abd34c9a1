"""Evaluation from end to end: gold and runs give checks, and checks and runs a report."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import comparisons as cmp
from ..functions.values import lookup_each, parse, text_of
from .checks import EXECUTED, case_pass_rate, check_summary, outcome, owners, ratio

COMPARISONS = {"exact": cmp.exact, "set": cmp.same_set, "one_of": cmp.one_of}
TEXTS = {"text": cmp.same_text, "contains": cmp.contains_text}


def matched(actual: Column, expected: Column, comparison: Column, scorers: Mapping[str, Callable[[Column, Column], Column]] | None = None) -> Column:
    """Whether JSON text fits the gold under the comparison that the row names; NULL if there is no such comparison.

    scorers: further comparisons of a caller by name, over JSON text and gold.
    """
    plain = lambda c: text_of(parse(c))
    out = F.when(F.lit(False), F.lit(False))
    for name, fits in COMPARISONS.items():
        own = lambda c, name=name: F.when(comparison == name, c)
        out = out.when(comparison == name, fits(own(actual), own(expected)))  # Python is called for every row: others give it nothing to parse
    for name, fits in (scorers or {}).items():
        out = out.when(comparison == name, F.coalesce(fits(actual, expected), F.lit(False)))
    for name, fits in TEXTS.items():
        out = out.when(comparison == name, fits(plain(actual), plain(expected)))
    return out


def evaluate(gold: DataFrame, runs: DataFrame, records: DataFrame) -> DataFrame:
    """Each check of each run with its outcome.

    gold: case_id, check_ordinal, path, expected (JSON text), comparison, absent_as_null; runs: run_id, case_id, document
    (the value that paths go into); records: run_id, path, status. The status of the innermost record over a path decides
    what an absent value means. A case without a run has its checks too, with a null run_id; they are missing.
    """
    asked = gold.join(runs.select("run_id", "case_id", "document"), "case_id", "left")
    found = asked.withColumn("actual", F.to_json(lookup_each(F.col("document"), F.col("path")))).drop("document")
    known = owners(found, records, "run_id")
    fits = matched(F.col("actual"), F.col("expected"), F.col("comparison"))
    as_null = matched(F.lit("null"), F.col("expected"), F.col("comparison"))
    return known.withColumn("outcome", outcome(F.col("actual").isNotNull(), fits, F.col("owner_status"), F.col("absent_as_null"), as_null))


def report(checks: DataFrame, runs: DataFrame, *by: str) -> DataFrame:
    """Checks by outcome, the share of runs with every check passed, and runs by status with their failure and review rates.

    ``by``: columns of both. What a group has no run or no check for is NULL.
    """
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    total = F.count(F.lit(1))
    own = [total.alias("runs"), *(n(s).alias(s) for s in EXECUTED), n("failed", "cancelled").alias("stopped")]
    rates = [ratio(n("failed", "cancelled"), total).alias("failure_rate"), ratio(n("needs_review"), total).alias("review_rate")]
    states = runs.groupBy(*by).agg(*own, *rates)
    parts = [check_summary(checks, *by), case_pass_rate(checks.where("run_id IS NOT NULL"), ["run_id"], *by).drop("attempts")]
    names = [c for part in (*parts, states) for c in part.columns if c not in by]
    out = states
    for part in parts:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.groupBy(*by).agg(*(F.max(c).alias(c) for c in names))  # one row of each part, null groups too
