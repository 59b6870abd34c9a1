"""Journals of attempts, saved reports, and replays of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import settled
from ..functions.comparisons import canonical
from ..functions.values import kind, member, number_of, parse, text_of
from ..operators.compare import unmatched
from .lines import read_placed

ATTEMPT = "identity string, case_id string, repetition int, written timestamp, input string, seconds double, result string"


def record(attempts: DataFrame, path: str) -> None:
    """Appends attempts to a journal; several writers may append at once."""
    attempts.write.mode("append").partitionBy("identity").parquet(path)


def latest(journal: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last record of each key; of records that are equal in order, the one that is largest in its other columns."""
    rest = [c for c in journal.columns if c not in key]
    last = journal.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order, *(c for c in rest if c not in order))).alias("r"))
    return last.select(*key, *(F.col(f"r.{c}").alias(c) for c in rest))


def load(spark: SparkSession, path: str, identity: str) -> DataFrame:
    """The last attempt of each case and repetition under this identity."""
    own = spark.read.schema(ATTEMPT).parquet(path).where(F.col("identity") == identity)
    return latest(own, ["case_id", "repetition"], ["written"])


class OtherIdentity(ValueError):
    """The journal holds this suite for another variant, configuration or target."""


def read_lines(spark: SparkSession, path: str, suite: str | None = None, identity: str | None = None) -> DataFrame:
    """The last attempt of each case and repetition in a journal of JSON lines, by place; with the suite and identity asked for.

    A line is an object of kind ``attempt`` with identity (an object that names the suite), case_id, repetition from 1, input,
    seconds from 0 and result (an object). Empty lines count for nothing, and neither does a torn line at the end of its file;
    any other line that is no such record is an error, and so is a record of the same suite with another identity.
    identity: JSON text; equal whatever the order of its keys. Files follow each other by name.
    """
    lines = read_placed(spark, path).where(F.trim("value") != "").withColumn("v", parse(F.col("value")))
    of = lambda name: member(F.col("v"), name)
    repetition, seconds = number_of(of("repetition")), number_of(of("seconds"))
    good = (kind(F.col("v")) == "object") & (text_of(of("kind")) == "attempt") & (kind(of("identity")) == "object") & text_of(of("case_id")).isNotNull()
    good = good & (repetition >= 1) & (repetition == F.floor(repetition)) & (seconds >= 0) & of("input").isNotNull() & (kind(of("result")) == "object")
    good = F.coalesce(good, F.lit(False))
    torn = F.col("last") & F.col("v").isNull()
    own = F.lit(True) if suite is None else F.coalesce(text_of(member(of("identity"), "suite")) == suite, F.lit(False))
    rows = settled(
        lines.where(~torn).select(
            "file", "place", good.alias("good"), own.alias("own"), F.to_json(of("identity")).alias("identity"), text_of(of("case_id")).alias("case_id"), repetition.cast("int").alias("repetition"),
            F.to_json(of("input")).alias("input"), seconds.alias("seconds"), F.to_json(of("result")).alias("result"),
        )
    )
    if bad := rows.where("NOT good").select("file", "place").first():
        raise ValueError(f"no record at byte {bad['place']} of {bad['file']}")
    rows = rows.where("own")
    if identity is not None and not rows.where(canonical("identity") != canonical(F.lit(identity))).isEmpty():
        raise OtherIdentity(f"the journal holds suite {suite!r} under another identity")
    return latest(rows.drop("good", "own"), ["case_id", "repetition"], ["file", "place"])


def recorded_cases(journal: DataFrame) -> DataFrame:
    return journal.select("case_id").distinct()


def to_run(gold: DataFrame, journal: DataFrame) -> DataFrame:
    """Cases (case_id, repetition, input) without a recorded attempt of the same input."""
    same = journal.select("case_id", "repetition", canonical("input").alias("_input"))
    return gold.withColumn("_input", canonical("input")).join(same, ["case_id", "repetition", "_input"], "left_anti").drop("_input")


def replay(gold: DataFrame, saved: DataFrame) -> DataFrame:
    """Gold attempts beside saved results; cases that only one side has, or whose input differs, are an error."""
    key = ["case_id", "repetition"]
    if not unmatched(gold.select(*key).distinct(), saved.select(*key).distinct(), key).isEmpty():
        raise ValueError("gold and saved attempts differ")
    both = gold.join(saved.withColumnRenamed("input", "_saved"), key)
    if not both.where(canonical("input") != canonical("_saved")).isEmpty():
        raise ValueError("a saved attempt has another input")
    return both.drop("_saved")


def write_report(report: DataFrame, path: str, form: str = "parquet") -> None:
    """Writes a report; what is there is never overwritten."""
    report.write.mode("errorifexists").format(form).save(path)
