"""Summaries of runs: failures, latency, usage, cost, steps, flows, groups of inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.comparisons import canonical, canonical_items
from ..functions.usage import total_or_unknown
from ..functions.values import kind
from .checks import ratio


def failures_by_code(runs: DataFrame, *by: str) -> DataFrame:
    """Failed runs by code, with their place: the most frequent first, then by code."""
    from pyspark.sql.window import Window

    n = runs.where((F.col("status") == "failed") & F.col("code").isNotNull()).groupBy(*by, "code").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(*by or [F.lit(1)]).orderBy(F.desc("n"), "code")))


def latency(seconds: Column) -> list[Column]:
    """count, unavailable, min, median (midpoint), p95 (nearest rank) and max."""
    return [
        F.count(seconds).alias("count"),
        F.count_if(seconds.isNull()).alias("unavailable"),
        F.min(seconds).alias("min"),
        F.percentile(seconds, 0.5).alias("median"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {seconds._jc.toString()})").alias("p95"),
        F.max(seconds).alias("max"),
    ]


def latency_summary(df: DataFrame, seconds: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(*latency(F.col(seconds)))


def usage_summary(df: DataFrame, fields: list[str], *by: str) -> DataFrame:
    """observed, unknown, known_total (NULL if none is known) and total (NULL if one is unknown) of each count."""
    parts = []
    for f in fields:
        parts += [F.count(f).alias(f"{f}_observed"), F.count_if(F.col(f).isNull()).alias(f"{f}_unknown"), F.sum(f).alias(f"{f}_known_total"), total_or_unknown(F.col(f)).alias(f"{f}_total")]
    return df.groupBy(*by).agg(*parts)


def cost_summary(df: DataFrame, *by: str) -> DataFrame:
    """known, unknown, amount (six places, half to even; NULL if one is unknown) and the single currency, of rows with
    requests, amount and currency. A row without requests costs nothing."""
    amount = F.when(F.col("requests") == 0, F.lit(0).cast("decimal(38,12)")).otherwise(F.col("amount"))
    d = df.withColumn("_amount", amount)
    one = F.count_distinct("currency") <= 1
    total = F.when(one & (F.count(F.lit(1)) == F.count("_amount")), F.bround(F.sum("_amount"), 6))
    return d.groupBy(*by).agg(F.count("_amount").alias("known"), F.count_if(F.col("_amount").isNull()).alias("unknown"), total.cast("decimal(38,6)").alias("amount"), F.when(one, F.max("currency")).alias("currency"))


def usage_by_model(df: DataFrame, *by: str) -> DataFrame:
    """Sums of tokens by model; unknown parts make a sum unknown."""
    return df.groupBy(*by, "model").agg(F.sum("requests").alias("requests"), *(total_or_unknown(F.col(c)).alias(c) for c in ("input_tokens", "output_tokens")))


def step_summary(attempts: DataFrame, records: DataFrame, scope: list[tuple[str, str]]) -> DataFrame:
    """By flow and step: invocations, statuses, latency, fallbacks. attempts: run_id; records: run_id, flow, step, status,
    seconds, origin. An attempt without a record of a step in scope is one unavailable observation of it."""
    steps = F.explode(F.array(*(F.struct(F.lit(f).alias("flow"), F.lit(s).alias("step")) for f, s in scope)))
    wanted = attempts.select("run_id", steps.alias("s")).select("run_id", "s.*")
    joined = wanted.join(records, ["run_id", "flow", "step"], "left")
    n = lambda s: F.count_if(F.col("status") == s)
    ran = F.count_if(F.col("status") != "skipped")
    counts = [F.count("status").alias("invocations"), F.count_if(F.col("status").isNull()).alias("no_record"), *(n(s).alias(s) for s in ("completed", "needs_review", "failed", "skipped"))]
    return joined.groupBy("flow", "step").agg(*counts, ratio(F.count_if(F.col("origin") == "fallback"), ran).alias("fallback_rate"), *latency(F.col("seconds")))


def flow_summary(attempts: DataFrame, records: DataFrame, scope: list[str]) -> DataFrame:
    own = records.withColumn("step", F.lit("")).withColumn("origin", F.lit(None).cast("string"))
    return step_summary(attempts, own, [(f, "") for f in scope]).drop("step", "fallback_rate")


def duration_histogram(df: DataFrame, seconds: str, edges: list[float], *by: str) -> DataFrame:
    """Number of durations in each bucket (up to and with its edge; the last has none); unknown durations have a null bucket."""
    bucket = F.array_position(F.array(*(F.lit(e) >= F.col(seconds) for e in edges)), True)
    return df.groupBy(*by, F.when(F.col(seconds).isNotNull(), F.when(bucket == 0, len(edges) + 1).otherwise(bucket)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def grouped(df: DataFrame, value: Column, text: Column, ordinal: str) -> DataFrame:
    """df with its group: the value (a variant, with its JSON text), or each distinct item of an array (member).

    Absent and null are different groups, keys are type-sensitive, an empty array joins none. Columns: present, member, key.
    """
    scalar, member = F.lit(False).alias("member"), F.lit(True).alias("member")
    many = kind(value) == "array"
    d = df.withColumns({"_many": F.coalesce(many, F.lit(False)), "_text": text, "present": value.isNotNull()})
    one = d.where("NOT _many").select(*df.columns, "present", scalar, F.when(F.col("present"), canonical("_text")).alias("key"))
    items = d.where("_many").select(*df.columns, "present", member, F.explode(F.array_distinct(canonical_items("_text"))).alias("key"))
    return one.unionByName(items)


def group_report(groups: DataFrame, ordinal: str, *aggregates: Column) -> DataFrame:
    """Aggregates by group, and group_ordinal: the first place where the group occurs."""
    return groups.groupBy("present", "member", "key").agg(*aggregates, F.min(ordinal).alias("group_ordinal"))
