"""Envelopes: a JSON object with payload and metadata on each line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import fields_of, kind, member
from .lines import read_placed

DEEPEST = 64
LONGEST = 1 << 20


def depth(text: Column) -> Column:
    """How deep the brackets of JSON text nest."""
    marks = F.split(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"|[^\[\]{}]', ""), "")
    step = lambda c: F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    grow = lambda s, c: F.struct((s.now + step(c)).alias("now"), F.greatest(s.most, s.now + step(c)).alias("most"))
    return F.aggregate(marks, start, grow, lambda s: s.most)


def decode(df: DataFrame, text: str = "value") -> DataFrame:
    """df with payload and metadata as variants, and error: invalid_input for what is no envelope."""
    d = df.withColumn("_v", F.when((F.octet_length(text) <= LONGEST) & (depth(F.col(text)) <= DEEPEST), F.try_parse_json(text)))
    payload, metadata = member(F.col("_v"), "payload"), F.coalesce(member(F.col("_v"), "metadata"), F.parse_json(F.lit("{}")))
    known = F.size(F.array_except(F.map_keys(fields_of(F.col("_v"))), F.array(F.lit("payload"), F.lit("metadata")))) == 0
    good = F.coalesce(payload.isNotNull() & known & (kind(metadata) == "object"), F.lit(False))
    return d.withColumns({"payload": F.when(good, payload), "metadata": F.when(good, metadata), "error": F.when(~good, "invalid_input")}).drop("_v")


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """One envelope on each line of the files at path; run_id is a digest of the file and the line's place there."""
    lines = read_placed(spark, path)
    return decode(lines.select("value", F.sha2(F.concat_ws("\n", "file", "place"), 256).alias("run_id")))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """suite, case_id, case_ordinal, input, check_ordinal, name, path, expected, comparison of gold manifests at path."""
    expectation = "struct<name: string, path: string, expected: variant, comparison: string, each: string, absent_as_null: boolean>"
    schema = f"name string, revision string, suites array<struct<name: string, workflow: string, cases: array<struct<id: string, input: variant, expectations: array<{expectation}>>>>>"
    docs = spark.read.schema(schema).json(path, multiLine=True)
    suites = docs.select(F.col("name").alias("dataset"), "revision", F.explode("suites").alias("s"))
    cases = suites.select("dataset", "revision", F.col("s.name").alias("suite"), F.posexplode("s.cases").alias("case_ordinal", "c"))
    checks = cases.select("dataset", "revision", "suite", "case_ordinal", F.col("c.id").alias("case_id"), F.to_json("c.input").alias("input"), F.posexplode("c.expectations").alias("check_ordinal", "e"))
    return checks.select("dataset", "revision", "suite", "case_ordinal", "case_id", "input", "check_ordinal", "e.name", "e.path", F.to_json("e.expected").alias("expected"), "e.comparison", "e.each", "e.absent_as_null")
