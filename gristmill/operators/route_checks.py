"""Static checks of routes over tables of many workflows: conditions that never or always hold, entries that no value reaches,
cases that cannot match and values without a case.

Tables, all with a column workflow:

- entries (flow, position, pointer, operator, operands): the leaves of a route, first match first; operands: an array of JSON
  texts (one, but for in and not_in). The last entry has no operator: it takes what is left.
- values (pointer, value): a pointer whose values are known has a row for each, as JSON text.
- ranges (pointer, low, high): a pointer whose values are numbers from low to high.
- cases (flow, pointer, key): targets by text.

What a pointer can find is cut into elements that no condition of the flow tells apart: its values; for a range, the numbers
that conditions name and what lies between them; and its absence, which fits no condition but the negated ones. An element
goes to the first entry on this pointer that fits it, so an entry that gets none is never reached, whichever way its elements
were taken. Conditions on pointers without known values say nothing, and are never reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.comparisons import canonical, canonical_items
from ..functions.values import bound

_FLOW = ["workflow", "flow"]
NEGATED = ("not_equals", "not_in")
#: Texts that are their own canonical JSON.
PLAIN = r'\A("[ !#-\[\]-~]*"|0|-?[1-9][0-9]{0,17})\z'
#: What the elements of a pointer show of a condition: some are there, one of these fits, one does not, an element or the absence
#: does not fit, and one gets to it.
THERE, SOME, NOT_EVERY, NOT_ALWAYS, OWN = 1, 2, 4, 8, 16
ORDER = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}


def _canonical(text: Column) -> Column:
    """As canonical; texts that are canonical as they stand (plain strings, short whole numbers) do not pass through Python."""
    plain = _plain(text)
    return F.when(plain, text).otherwise(canonical(F.when(~plain, text)))


def _plain(text: Column) -> Column:
    return F.coalesce(text.rlike(PLAIN), F.lit(False))


def _known(values: DataFrame, ranges: DataFrame) -> DataFrame:
    """workflow, values and ranges: what is known of its pointers, a row for each workflow."""
    v = values.select("workflow", F.struct("pointer", _canonical(F.col("value")).alias("element")).alias("v")).groupBy("workflow").agg(F.collect_list("v").alias("values"))
    r = ranges.select("workflow", F.struct("pointer", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high")).alias("r")).groupBy("workflow").agg(F.collect_list("r").alias("ranges"))
    return v.join(r, "workflow", "full")


def _elements(pointer: Column, values: Column, ranges: Column, cuts: Column) -> Column:
    """What a pointer can find: element (canonical JSON text, NULL for absence) and number (NULL of what is none); empty where
    nothing is known. cuts: the numbers that conditions name."""
    one = lambda element, number: F.struct(element.alias("element"), number.alias("number"))
    texts = F.transform(F.filter(values, lambda v: v.pointer == pointer), lambda v: one(v.element, v.element.try_cast("double")))

    def numbers(r: Column) -> Column:
        ends = F.array_sort(F.array_distinct(F.concat(F.array(r.low, r.high), F.filter(cuts, lambda c: (c > r.low) & (c < r.high)))))
        between = lambda ends: F.filter(F.transform(ends, lambda x, k: (x + F.get(ends, k + 1)) / 2), lambda x: x.isNotNull())
        return F.transform(bound(ends, lambda e: F.concat(e, between(e))), lambda n: one(n.cast("string"), n))

    none = F.array().cast("array<struct<element: string, number: double>>")
    spans = F.flatten(F.transform(F.filter(ranges, lambda r: r.pointer == pointer), numbers))
    found = F.array_distinct(F.concat(F.coalesce(texts, none), F.coalesce(spans, none)))
    absence = F.array(one(F.lit(None).cast("string"), F.lit(None).cast("double")))
    return F.when(F.size(found) > 0, F.concat(found, absence)).otherwise(none)


def _fits(operator: Column, operands: Column, x: Column) -> Column:
    """Whether an element fits a condition; numbers are equal by value, other values as canonical JSON."""
    same = F.exists(operands, lambda o: F.coalesce(x.element == o.text, F.lit(False)) | F.coalesce(x.number == o.number, F.lit(False)))
    out = F.when(operator.isin(*NEGATED), ~same).when(operator.isin("equals", "in"), same)
    for name, ordered in ORDER.items():
        out = out.when(operator == name, ordered(x.number, F.get(operands, F.lit(0)).number))
    return F.coalesce(out, F.lit(False))


def route_problems(entries: DataFrame, values: DataFrame, ranges: DataFrame) -> DataFrame:
    """workflow, flow, position, problem: condition_always_true or condition_always_false (of values that are there; absence
    may differ), and route_unreachable_entry.

    Rows are dealt by workflow. The conditions of a flow on one pointer, and what its workflow knows of it, are in one row.
    """
    plain = F.coalesce(F.forall("operands", _plain), F.lit(False))
    whole = F.when(~plain & F.col("operator").isNotNull(), F.concat(F.lit("["), F.array_join("operands", ","), F.lit("]")))
    texts = F.when(plain, F.col("operands")).otherwise(canonical_items(whole))
    e = entries.select(*_FLOW, "position", "pointer", "operator", "operands", F.transform(texts, lambda t: F.struct(t.alias("text"), t.try_cast("double").alias("number"))).alias("of"))
    judged = F.col("operator").isNotNull() & F.col("flow").isNotNull() & F.col("pointer").isNotNull()
    cuts = F.flatten(F.collect_list(F.when(judged, F.transform("operands", lambda c: c.try_cast("double")))))
    group = e.repartition("workflow").groupBy(*_FLOW, "pointer").agg(F.collect_list(F.struct("position", "operator", "of")).alias("conditions"), F.array_compact(F.array_distinct(cuts)).alias("cuts"))
    x = group.join(_known(values, ranges), "workflow", "left").select(*_FLOW, "conditions", _elements(F.col("pointer"), F.col("values"), F.col("ranges"), F.col("cuts")).alias("elements"))
    # each element goes to the first condition that it fits
    first = lambda v: F.array_min(F.transform(F.filter("conditions", lambda c: _fits(c.operator, c.of, v)), lambda c: c.position))
    x = x.withColumn("elements", F.transform("elements", lambda v: F.struct(v.element.alias("element"), v.number.alias("number"), first(v).alias("first"))))
    x = x.select(*_FLOW, "elements", F.explode("conditions").alias("c")).select(*_FLOW, "elements", "c.*")
    bits = lambda v, fits: F.when(v.element.isNotNull(), F.when(fits, THERE | SOME).otherwise(THERE | NOT_EVERY)).otherwise(0).bitwiseOR(F.when(~fits, NOT_ALWAYS).when(v.first == F.col("position"), OWN).otherwise(0))
    seen = F.aggregate("elements", F.lit(0), lambda done, v: done.bitwiseOR(bound(_fits(F.col("operator"), F.col("of"), v), lambda fits: bits(v, fits))))
    x = x.select(*_FLOW, "position", F.when(F.col("operator").isNotNull() & F.col("flow").isNotNull() & F.col("position").isNotNull() & (F.size("elements") > 0), seen).alias("seen"))
    x = x.withColumn("seen", F.bit_or("seen").over(Window.partitionBy(*_FLOW, "position")))
    has = lambda bit: F.col("seen").bitwiseAND(bit) != 0
    x = x.withColumn("decided", F.min(F.when(~has(NOT_ALWAYS), F.col("position"))).over(Window.partitionBy(*_FLOW)))
    dead = F.coalesce(F.col("position") > F.col("decided"), F.lit(False)) | F.coalesce(~has(OWN), F.lit(False))
    problems = F.array_compact(F.array(F.when(has(THERE) & ~has(NOT_EVERY), "condition_always_true"), F.when(has(THERE) & ~has(SOME), "condition_always_false"), F.when(dead, "route_unreachable_entry")))
    return x.select(*_FLOW, "position", F.explode(problems).alias("problem"))


def case_problems(cases: DataFrame, values: DataFrame) -> DataFrame:
    """workflow, flow, key, problem: unmatched_case (the key is no value of the pointer), uncovered_value (a text without a case),
    and case_on_unknown_type (key NULL) where nothing is known of the pointer."""
    texts = values.select("workflow", "pointer", F.expr("try_variant_get(try_parse_json(value), '$', 'string')").alias("key"), F.col("value").startswith('"').alias("text")).where("text").drop("text").distinct()
    known = values.select("workflow", "pointer").distinct().withColumn("known", F.lit(True))
    c = cases.select(*_FLOW, "pointer", "key").distinct().join(known, ["workflow", "pointer"], "left")
    unknown = c.where("known IS NULL").select(*_FLOW, F.lit(None).cast("string").alias("key"), F.lit("case_on_unknown_type").alias("problem")).distinct()
    never = c.where("known").join(texts, ["workflow", "pointer", "key"], "left_anti").select(*_FLOW, "key", F.lit("unmatched_case").alias("problem"))
    without = c.where("known").select(*_FLOW, "pointer").distinct().join(texts, ["workflow", "pointer"]).join(c.drop("known"), [*_FLOW, "pointer", "key"], "left_anti")
    return unknown.unionByName(never).unionByName(without.select(*_FLOW, "key", F.lit("uncovered_value").alias("problem")))
