"""Tasks of queries over narrow rows: their number grows with the rows."""

import gristmill
import gristmill.more_queries as more
import gristmill.queries as q
from conftest import DATA
from gristmill.functions.values import lookup_each, parse
from gristmill.operators.records import owner
from gristmill.operators.suites import run_suite
from pyspark.sql import functions as F


def parts(df):
    return df.rdd.getNumPartitions()


def test_dealt_by_rows(spark):
    df = spark.range(1000)
    assert [parts(gristmill.dealt(df, "id", most=m)) for m in (100, 300, 5000)] == [10, 4, 1]
    assert parts(gristmill.dealt(df, "id", most=100, of=spark.range(250))) == 3
    assert parts(gristmill.dealt(df.where("id < 0"), "id")) == 1


def test_lines_of_nested_usage_are_dealt_by_rows(spark, monkeypatch):
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    monkeypatch.setattr(gristmill, "DEALT", lines // 7)
    plan = q.QUERIES["nested_usage"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and ", 8), REPARTITION_BY_NUM" in plan


def test_checks_of_a_suite_are_computed_once(spark):
    """Reports and saved evaluations read the checks more than once; walks and comparisons are done by then."""
    cases, gold, workflow = more.sized_suite(spark, DATA)
    checks = run_suite(cases, gold, workflow, scorers={"sum_below_3": more.below_3}).checks
    plan = checks._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "Join" not in plan and "ExistingRDD" in plan


def test_members_by_odd_names(spark):
    doc = """{"a": {"0": 1, "x'\\"y": 2, "b]": null}, "l": [5, {"c": 6}], "": 7}"""
    rows = [("/a/0", "1"), ("/a/x'\"y", "2"), ("/a/b]", "null"), ("/a/1", None), ("/l/0", "5"), ("/l/1/c", "6"), ("/l/2", None), ("/l/01", None), ("/l/x", None), ("/", "7"), ("/l/999999999", None), ("/l/9999999999", None), ("/a/0/0", None)]
    table = spark.createDataFrame(rows, "path string, wanted string").withColumn("doc", F.lit(doc))
    found = table.select("path", "wanted", F.to_json(lookup_each(parse(F.col("doc")), F.col("path"))).alias("got")).collect()
    assert [(r["path"], r["got"]) for r in found] == rows
    # one walk reads each member once: no path is parsed for a row, and the steps of a walk are bound
    plan = table.select(owner(parse(F.col("doc")), F.col("path")).alias("o"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("map<string,variant>") <= 2
