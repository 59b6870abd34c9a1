"""Checks of results against gold, and their owners.

A check's outcome is passed, failed, missing, skipped or error. Rates divide by all checks, whatever happened to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXECUTED = ("completed", "needs_review")
#: Outcomes from the worst to the best.
OUTCOME_RANK = {"error": 0, "missing": 0, "skipped": 0, "failed": 1, "passed": 2}
STATUS_RANK = {"error": 0, "failed": 0, "cancelled": 0, "needs_review": 1, "completed": 2}


def outcome(present: Column, matched: Column, owner_status: Column, absent_as_null: Column, null_matches: Column) -> Column:
    """Outcome of a check: present tells whether the path was found, matched and null_matches whether the value (or null) fits."""
    as_null = absent_as_null & owner_status.isin(*EXECUTED)
    found = F.when(matched, "passed").otherwise("failed")
    absent = F.when(owner_status == "skipped", "skipped").when(owner_status.isin("failed", "cancelled"), "error")
    return F.when(present, found).otherwise(absent.when(F.coalesce(as_null, F.lit(False)), F.when(null_matches, "passed").otherwise("failed")).otherwise("missing"))


def ratio(part: Column, whole: Column) -> Column:
    """NULL where there is no whole."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def check_summary(checks: DataFrame, *by: str) -> DataFrame:
    """Counts by outcome, pass_rate and coverage; rates are 0 where there are no checks."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    total, zero = F.count(F.lit(1)), F.lit(0.0)
    rates = [F.coalesce(ratio(n("passed"), total), zero).alias("pass_rate"), F.coalesce(ratio(n("passed") + n("failed"), total), zero).alias("coverage")]
    return checks.groupBy(*by).agg(total.alias("total"), *(n(o).alias(o) for o in ("passed", "failed", "missing", "skipped", "error")), *rates)


def case_pass_rate(checks: DataFrame, attempt: list[str], *by: str) -> DataFrame:
    """Share of attempts of which every check passed."""
    each = checks.groupBy(*by, *attempt).agg(F.bool_and(F.col("outcome") == "passed").alias("ok"))
    return each.groupBy(*by).agg(F.count(F.lit(1)).alias("attempts"), ratio(F.count_if("ok"), F.count(F.lit(1))).alias("case_pass_rate"))


def owners(checks: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Each check with the innermost record whose path holds the check's path: the longest prefix at a token's edge.

    Each check looks up its prefixes, one for each token, so this is a join on equal paths.
    """
    parts = F.split("path", "/")
    prefix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    asked = checks.withColumn("owner_path", F.explode(prefix))
    own = records.select(key, F.col("path").alias("owner_path"), F.col("status").alias("owner_status"))
    hit = asked.join(own, [key, "owner_path"]).groupBy(key, "path").agg(F.max_by(F.struct("owner_path", "owner_status"), F.length("owner_path")).alias("o"))
    return checks.join(hit, [key, "path"], "left").select(*checks.columns, F.col("o.owner_path").alias("owner_path"), F.col("o.owner_status").alias("owner_status"))
