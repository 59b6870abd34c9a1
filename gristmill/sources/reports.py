"""Saved evaluations, and comparisons of two of them from their files alone."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compare import compare_cases, compare_status_rates, compare_totals
from ..operators.suites import Evaluation, repetition_problems

ATTEMPTS = ("case_id", "repetition", "status", "code", "resumed")
CHECKS = ("case_id", "repetition", "check_ordinal", "path", "comparison", "outcome")


class Saved(NamedTuple):
    """suite: a fingerprint of its cases' inputs and gold; repeat: attempts of each case."""

    suite: str
    repeat: int
    attempts: DataFrame
    checks: DataFrame


def fingerprint(evaluation: Evaluation) -> str:
    """A digest of inputs and gold, whatever their order: sums of row digests over all rows, which are equal for equal rows."""
    row = lambda df, *columns: df.select(F.xxhash64(*columns).cast("decimal(38,0)").alias("h"), F.xxhash64(F.lit(1), *columns).cast("decimal(38,0)").alias("g"))
    first = evaluation.attempts.where("repetition = 1")
    gold = evaluation.checks.where("repetition = 1")
    both = row(first, F.col("case_id").cast("string"), F.col("input")).unionByName(row(gold, F.col("case_id").cast("string"), *(F.col(c) for c in ("check_ordinal", "path", "expected", "comparison"))))
    r = both.agg(F.sum("h").alias("h"), F.sum("g").alias("g"), F.count(F.lit(1)).alias("n")).first()
    return f"{r['h']}:{r['g']}:{r['n']}"


def save(evaluation: Evaluation, path: str, repeat: int = 1) -> None:
    """Writes an evaluation to a new folder; what is there is never overwritten."""
    spark = evaluation.attempts.sparkSession
    evaluation.attempts.select(*ATTEMPTS).write.mode("errorifexists").parquet(f"{path}/attempts")
    evaluation.checks.select(*CHECKS).write.mode("errorifexists").parquet(f"{path}/checks")
    about = spark.range(1).select(F.lit(fingerprint(evaluation)).alias("suite"), F.lit(repeat).alias("repeat"))
    about.write.mode("errorifexists").json(f"{path}/about")  # last: a folder without it is not whole


def read(spark: SparkSession, path: str) -> Saved:
    """A saved evaluation; one whose attempts are not the repetitions that it names is an error."""
    about = spark.read.schema("suite string, repeat int").json(f"{path}/about").first()
    attempts, checks = (spark.read.parquet(f"{path}/{name}") for name in ("attempts", "checks"))
    if about is None or not repetition_problems(attempts, about["repeat"]).isEmpty():
        raise ValueError(f"no whole evaluation at {path}")
    return Saved(about["suite"], about["repeat"], attempts, checks)


def compare_saved(spark: SparkSession, baseline: str, candidate: str) -> tuple[DataFrame, DataFrame]:
    """Changes by attempt, and one row of totals with rates of both sides. Evaluations of other suites, or with other
    repetitions, are not compared."""
    a, b = read(spark, baseline), read(spark, candidate)
    if (a.suite, a.repeat) != (b.suite, b.repeat):
        raise ValueError("the evaluations are of different suites or repetitions")
    cases = compare_cases(a.checks, b.checks, (a.attempts, b.attempts))
    totals = compare_totals(cases).join(compare_status_rates(a.attempts, b.attempts))  # a row of each
    return cases, totals
