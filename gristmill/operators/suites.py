"""Evaluations that run the workflow: cases in, and attempts, checks and a report out.

Each case runs ``repeat`` times. With a journal, attempts that it holds under the same identity, of the same input, are taken
from there instead, and new ones that completed or need a review are added; so an evaluation that broke off goes on where it
ended. An attempt's document is the run's public result: status, payload, error and the records of flows that ran and of
their steps, without what is absent. Checks find their values and their owners on the way down that document.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settled
from ..functions.values import items_of, lookup_each, parse
from ..plans.workflow import Workflow
from ..sources import journal as jn
from ..sources.envelopes import decode
from .checks import outcome
from .evaluate import matched, report
from .records import owner

Scorer = Callable[[Column, Column], Column]
KEY = ["case_id", "repetition"]


class Evaluation(NamedTuple):
    """attempts: case_id, repetition, run_id, status, code, resumed, document; checks: each with its outcome."""

    attempts: DataFrame
    checks: DataFrame

    def report(self, *by: str) -> DataFrame:
        """One row (of each group): checks by outcome, pass rates of cases, runs by status, resumed attempts."""
        counts = self.attempts.groupBy(*by).agg(F.count_if("resumed").alias("resumed"), F.count_distinct("case_id").alias("source_cases"))
        whole = report(self.checks, self.attempts, *by)
        if not by:
            return whole.join(counts)  # a row of each
        same = [whole[c].eqNullSafe(counts[c]) for c in by]
        return whole.join(counts, same, "left").select(whole["*"], "resumed", "source_cases")


def document(runs: DataFrame, workflow: Workflow) -> Column:
    """A run's public result as JSON text."""
    error = lambda code: F.when(code.isNotNull(), F.struct(code.alias("code")))
    flows = []
    for f in workflow.order():
        at = lambda c, f=f: F.col(f"{f.name}.{c}")
        steps = [
            F.struct(*(F.col(f"{f.name}.steps.{s.name}.{c}").alias(c) for c in ("status", "result", "partial_result")), F.when(F.lit(hasattr(s.provider, "flows")), "flow_collection").alias("kind")).alias(s.name)
            for s in f.steps
        ]
        record = F.struct(at("status").alias("status"), at("result").alias("result"), error(at("error")).alias("error"), *([F.struct(*steps).alias("steps")] if steps else []))
        flows.append(F.when(at("status") != "skipped", record).alias(f.name))
    return F.to_json(F.struct("status", F.when(F.col("status") != "failed", F.col("payload")).alias("payload"), error(F.col("error")).alias("error"), F.struct(*flows).alias("flows")))


def run_suite(
    cases: DataFrame, expectations: DataFrame, workflow: Workflow, repeat: int = 1, journal: str | None = None, identity: str = "", scorers: Mapping[str, Scorer] | None = None
) -> Evaluation:
    """Runs cases (case_id, input: an envelope as JSON text, and columns to report by) and scores them.

    expectations: case_id, check_ordinal, path, expected (JSON text), comparison, absent_as_null, and each if wanted. A case
    that is there twice is an error: attempts of a case are its repetitions 1 to ``repeat``.
    """
    if not cases.groupBy("case_id").count().where("count > 1").isEmpty():
        raise ValueError("a case is there twice")
    spark = cases.sparkSession
    asked = cases.withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(repeat))))
    asked = settled(asked.withColumn("run_id", F.concat_ws("#", F.col("case_id").cast("string"), "repetition")))
    saved = None
    if journal is not None and _exists(spark, journal):
        saved = settled(jn.load(spark, journal, identity).withColumn("case_id", F.col("case_id").cast(cases.schema["case_id"].dataType)))
        open_ = jn.to_run(asked, saved)
    else:
        open_ = asked
    decoded = decode(open_.select("run_id", F.col("input").alias("value")))
    ran = settled(workflow.run(decoded.where("error IS NULL")))
    new = ran.select("run_id", "status", F.col("error").alias("code"), document(ran, workflow).alias("text"))
    refused = decoded.where("error IS NOT NULL").select("run_id", F.lit("failed").alias("status"), F.col("error").alias("code"), F.lit('{"status":"failed","error":{"code":"invalid_input"},"flows":{}}').alias("text"))
    new = settled(asked.join(new.unionByName(refused), "run_id").withColumn("resumed", F.lit(False)))
    attempts = new
    if journal is not None:
        done = new.where("status IN ('completed', 'needs_review')")
        jn.record(done.select(F.lit(identity).alias("identity"), F.col("case_id").cast("string").alias("case_id"), "repetition", F.current_timestamp().alias("written"), "input", F.lit(None).cast("double").alias("seconds"), F.col("text").alias("result")), journal)
        if saved is not None:
            again = asked.join(new.select("run_id"), "run_id", "left_anti").join(saved.select(*KEY, F.col("result").alias("text")), KEY)
            status = F.get_json_object("text", "$.status").alias("status")
            again = again.select("*", status, F.lit(None).cast("string").alias("code"), F.lit(True).alias("resumed"))
            attempts = new.unionByName(again)
    attempts = attempts.withColumn("document", parse(F.col("text"))).drop("text")
    return Evaluation(attempts, settled(scored(attempts, expectations, scorers)))  # a report, or a saved evaluation, reads the checks more than once


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def scored(attempts: DataFrame, expectations: DataFrame, scorers: Mapping[str, Scorer] | None = None) -> DataFrame:
    """Each expectation of each attempt with its outcome; each: a pointer into every item of what path finds."""
    each = F.col("each") if "each" in expectations.columns else F.lit(None).cast("string")
    asked = attempts.join(expectations, "case_id")
    found = lookup_each(F.col("document"), F.col("path"))
    parts = F.transform(items_of(F.col("_found")), lambda x: lookup_each(x, F.col("_each")))
    picked = F.when(F.forall(parts, lambda x: x.isNotNull()), F.to_json(F.to_variant_object(parts)))
    d = asked.withColumns({"_each": each, "_found": found, "_owner": owner(F.col("document"), F.col("path"))})
    d = d.withColumn("actual", F.when(F.col("_each").isNull(), F.to_json("_found")).otherwise(picked))
    fits, as_null = (matched(c, F.col("expected"), F.col("comparison"), scorers) for c in (F.col("actual"), F.lit("null")))
    d = d.withColumns({"owner_path": F.col("_owner.owner"), "owner_status": F.col("_owner.status")})
    d = d.withColumn("outcome", outcome(F.col("actual").isNotNull(), fits, F.col("owner_status"), F.col("absent_as_null"), as_null))
    return d.drop("_each", "_found", "_owner", "document")


def repetition_problems(attempts: DataFrame, repeat: int) -> DataFrame:
    """case_id and problem of cases whose attempts are not exactly the repetitions 1 to repeat; none where a report is sound."""
    n = attempts.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("repetition").alias("d"), F.min("repetition").alias("low"), F.max("repetition").alias("high"))
    problem = F.when(F.col("n") > F.col("d"), "repeated").when(F.coalesce((F.col("low") != 1) | (F.col("high") != repeat) | (F.col("d") != repeat), F.lit(True)), "incomplete")
    return n.select("case_id", problem.alias("problem")).where("problem IS NOT NULL")

