"""Metrics over observations: classification, sets of labels, and fields.

Observations have a state: observed, excluded, abstained, missing, skipped, error or invalid. Support is all but the
excluded ones, so failures stay in every denominator. Undefined rates are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import ratio

STATES = ("observed", "excluded", "abstained", "missing", "skipped", "error", "invalid")


def observed_state(gold: Column, pred: Column, present: Column, owner_status: Column, labels: list[str], null_label: bool = False) -> Column:
    """State of one observation, in the order in which causes are looked for."""
    none = F.lit(null_label)
    return (
        F.when(gold.isNull() & ~none, "excluded")
        .when(owner_status == "skipped", "skipped")
        .when(owner_status.isin("failed", "cancelled", "error"), "error")
        .when(~F.coalesce(present, F.lit(False)), "missing")
        .when(pred.isNull(), F.when(none, "observed").otherwise("abstained"))
        .when(~pred.isin(*labels), "invalid")
        .otherwise("observed")
    )


def metric_summary(observations: DataFrame, *by: str) -> DataFrame:
    """support, counts by state, accuracy and coverage of observations (state, gold, pred).

    Arrays of labels are correct where they are equal as sets.
    """
    n = {s: F.count_if(F.col("state") == s) for s in STATES}
    support = F.count_if(F.col("state") != "excluded")
    many = observations.schema["gold"].dataType.typeName() == "array"
    gold, pred = (F.array_sort(F.array_distinct(c)) if many else F.col(c) for c in ("gold", "pred"))
    correct = F.count_if((F.col("state") == "observed") & gold.eqNullSafe(pred))
    return observations.groupBy(*by).agg(support.alias("support"), *(c.alias(s) for s, c in n.items()), correct.alias("correct"), ratio(correct, support).alias("accuracy"), ratio(n["observed"], support).alias("coverage"))


def confusion_matrix(observations: DataFrame, labels: list[str]) -> DataFrame:
    """A row for each pair of labels, in the catalog's order, zeros included: gold_no, gold, pred_no, pred, n."""
    spark = observations.sparkSession
    cells = [(i, g, j, p) for i, g in enumerate(labels) for j, p in enumerate(labels)]
    grid = spark.createDataFrame(cells, "gold_no int, gold string, pred_no int, pred string")
    seen = observations.where("state = 'observed'").groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    match = grid.gold.eqNullSafe(seen.gold) & grid.pred.eqNullSafe(seen.pred)
    return grid.join(seen, match, "left").select(grid.gold_no, grid.gold, grid.pred_no, grid.pred, F.coalesce(seen.n, F.lit(0)).alias("n"))


def label_counts(observations: DataFrame, labels: list[str]) -> DataFrame:
    """label, tp, fp, fn, tn of each label over observed rows; gold and pred are labels or arrays of labels."""
    many = observations.schema["gold"].dataType.typeName() == "array"
    has = lambda c, label: F.coalesce(F.array_contains(c, label), F.lit(False)) if many else F.coalesce(F.col(c) == label, F.lit(False))
    o = observations.where("state = 'observed'")
    counts = []
    for k, label in enumerate(labels):
        g, p = has("gold", label), has("pred", label)
        counts += [F.count_if(x).alias(f"{name}_{k}") for name, x in (("tp", g & p), ("fp", ~g & p), ("fn", g & ~p), ("tn", ~g & ~p))]
    rows = [F.struct(F.lit(k).alias("label_no"), F.lit(label).alias("label"), *(F.col(f"{c}_{k}").alias(c) for c in ("tp", "fp", "fn", "tn"))) for k, label in enumerate(labels)]
    return o.agg(*counts).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def rates(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 of rows with tp, fp and fn; a missed label has an f1 of 0 even without a precision."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def micro_macro(counts: DataFrame) -> DataFrame:
    """Rates of pooled counts, and means of label rates, which are NULL as soon as one label has none."""
    names = ("precision", "recall", "f1")
    pooled = rates(counts.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))).select(F.lit("micro").alias("average"), *names)
    mean = [F.when(F.count(F.lit(1)) == F.count(c), F.sum(c) / F.count(c)).alias(c) for c in names]
    return pooled.unionByName(rates(counts).agg(*mean).select(F.lit("macro").alias("average"), *names))


def field_gold(checks: DataFrame, path: str, fields: list[str]) -> DataFrame:
    """case_id, field_no, field, gold: the first check of each case on the pointer of each field below path.

    The catalog of fields belongs to the metric, not to the data, so it is the side that is broadcast.
    """
    pointers = [(k, f, f"{path}/{f.replace('~', '~0').replace('/', '~1')}") for k, f in enumerate(fields)]
    catalog = checks.sparkSession.createDataFrame(pointers, "field_no int, field string, path string")
    found = checks.join(F.broadcast(catalog), "path")
    return found.groupBy("case_id", "field_no", "field").agg(F.min_by(F.struct("gold"), "check_ordinal").alias("first")).select("case_id", "field_no", "field", "first.gold")


FIELD_OUTCOMES = ("correct_value", "correct_null", "hallucinated", "missed", "wrong_value", "unavailable")


def field_outcome(available: Column, gold: Column, actual: Column, matched: Column) -> Column:
    """Outcome of one field; a field that an executed record leaves out counts as null."""
    return (
        F.when(~F.coalesce(available, F.lit(False)), "unavailable")
        .when(gold.isNull(), F.when(actual.isNull(), "correct_null").otherwise("hallucinated"))
        .when(actual.isNull(), "missed")
        .when(matched, "correct_value")
        .otherwise("wrong_value")
    )


def field_summary(fields: DataFrame) -> DataFrame:
    """Counts by outcome of every field and of all (field NULL), support and accuracy."""
    n = [F.count_if(F.col("outcome") == o).alias(o) for o in FIELD_OUTCOMES]
    right, all_ = F.count_if(F.col("outcome").isin("correct_value", "correct_null")), F.count(F.lit(1))
    return fields.rollup("field").agg(*n, all_.alias("support"), ratio(right, all_).alias("accuracy"))


def macro_field_accuracy(fields: DataFrame) -> DataFrame:
    """Mean accuracy of the fields that have support."""
    each = field_summary(fields).where("field IS NOT NULL")
    return each.agg((F.sum("accuracy") / F.count("accuracy")).alias("macro_accuracy"))
