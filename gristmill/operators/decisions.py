"""Typed answers of decisions: which are well-formed, and what becomes of those that cannot be given."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import settled

ISSUES = ("no_supported_answer", "conflicting_information", "multiple_valid_options")


def answerability_problems(kind: str, status: Column, issues: Column, has_answer: Column, predicate_value: Column | None = None) -> Column:
    """Names of rules that an answer breaks, in order; an empty array if none."""
    open_, given = status.isin("not_answerable", "undetermined"), status.isin("answerable", "partially_answerable")
    rules = {"issues-required": (status != "answerable") & (F.size(issues) == 0)}
    if kind not in ("multiselect", "request_units"):
        rules["partial-not-supported"] = status == "partially_answerable"
    if kind == "predicate":
        unknown = F.coalesce(predicate_value == "unknown", F.lit(False))
        rules |= {"unknown-on-answerable": (status == "answerable") & unknown, "substantive-on-unanswerable": open_ & ~unknown}
    else:
        rules |= {"answer-required": given & ~has_answer, "answer-must-be-null": open_ & has_answer}
    rules["issues-unique"] = F.size(issues) != F.size(F.array_distinct(issues))
    return F.array_compact(F.array(*(F.when(broken, name) for name, broken in rules.items())))


def choice_problems(answers: Column, options: list[str], least: int = 0, most: int | None = None) -> Column:
    """unknown-option, duplicate-option, too-few and too-many of an array of chosen options."""
    rules = {
        "unknown-option": F.size(F.array_except(answers, F.array(*map(F.lit, options)))) > 0,
        "duplicate-option": F.size(answers) != F.size(F.array_distinct(answers)),
        "too-few": F.size(answers) < least,
        "too-many": F.size(answers) > (len(options) if most is None else most),
    }
    return F.array_compact(F.array(*(F.when(broken, name) for name, broken in rules.items())))


def question_problems(asked: list[str], answered: Column) -> Column:
    """Questions that are missing, unknown or answered twice in an array of question ids."""
    ids = F.array(*map(F.lit, asked))
    named = lambda what, of: F.transform(of, lambda q: F.concat(F.lit(f"{what}:"), q))
    twice = F.array_distinct(F.filter(answered, lambda q: F.size(F.filter(answered, lambda r: r == q)) > 1))
    return F.concat(named("missing", F.array_except(ids, answered)), named("unknown", F.array_except(answered, ids)), named("duplicate", twice))


def subject_found(subject: Column, sources: Column) -> Column:
    """Whether a text occurs in one of the allowed sources."""
    return F.coalesce(F.exists(sources, lambda s: s.contains(subject)), F.lit(False))


def with_fallback(answer: Column, status: Column, issues: Column, fallback: str, on: list[str]) -> tuple[Column, Column]:
    """(answer, origin): the fallback where no answer can be given for reasons that are all among ``on``; review remains."""
    falls = (status == "not_answerable") & (F.size(issues) > 0) & (F.size(F.array_except(issues, F.array(*map(F.lit, on)))) == 0)
    return F.when(falls, fallback).otherwise(answer), F.when(falls, "fallback").when(answer.isNotNull(), "answer")


def decided_status(status: Column) -> Column:
    """A run goes on with an answer; all else needs a review."""
    return F.when(status == "answerable", "completed").otherwise("needs_review")


def review_target(issues: Column, targets: dict[str, str], default: str) -> Column:
    """Where a review goes: the target on which all issues agree, else the default."""
    table = F.create_map(*(F.lit(x) for kv in targets.items() for x in kv))
    found = F.array_distinct(F.transform(issues, lambda i: F.coalesce(F.try_element_at(table, i), F.lit(default))))
    return F.when(F.size(found) == 1, F.try_element_at(found, F.lit(1))).otherwise(default)


def reach(edges: DataFrame, key: str) -> DataFrame:
    """key, source, target of all paths: paths are joined end to end until no new one is found, so their length doubles.

    The paths of a key are as many as its pairs of units, at most.
    """
    paths = settled(edges.select(key, "source", "target").distinct())
    while True:
        more = paths.select(key, F.col("source").alias("target"), F.col("target").alias("end"))
        longer = paths.join(more, [key, "target"]).select(key, "source", F.col("end").alias("target"))
        now = settled(paths.unionByName(longer).distinct())
        if now.count() == paths.count():
            return now
        paths = now


def _ordered(relations: DataFrame, key: str, *kinds: str) -> DataFrame:
    """What must come first, as source, and what comes after it: of ``requires``, the target comes first."""
    first = lambda a, b: F.when(F.col("kind") == "requires", F.col(b)).otherwise(F.col(a))
    return relations.where(F.col("kind").isin(*kinds)).select(key, first("source", "target").alias("source"), first("target", "source").alias("target"))


def relation_problems(relations: DataFrame, key: str = "run_id", units: DataFrame | None = None, predicates: DataFrame | None = None) -> DataFrame:
    """Rows of relations (key, source, target, kind) with their problems.

    units (key, unit): the requests that there are; predicates (key, predicate): the questions that conditions may name. With
    them, ``unknown_unit`` and ``unknown_predicate`` are problems too. A relation of kind ``if`` is a condition: its source is a
    request, its target a predicate, and its column value what that must be; ``conflict``: another condition of the same
    request and predicate wants another value.

    ``self``: a unit requires or precedes itself. ``duplicate``: the relation is there twice (``excludes`` has no direction).
    ``cycle``: the row lies on a cycle of ``requires`` and ``precedes``, however long. ``exclusive_dependency``: units that
    exclude each other of which one requires the other, directly or by others. Rows with a null end have none but ``duplicate``.
    """
    given = relations if "value" in relations.columns else relations.withColumn("value", F.lit(None).cast("string"))
    r = given.select(key, "source", "target", "kind", "value")
    free, condition = F.col("kind") == "excludes", F.col("kind") == "if"
    ends = [F.when(free, F.least("source", "target")).otherwise(F.col("source")), F.when(free, F.greatest("source", "target")).otherwise(F.col("target"))]
    r = r.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key, "kind", *ends, "value")))
    same = Window.partitionBy(key, "kind", "source", "target")
    r = r.withColumn("_values", F.when(condition, F.min("value").over(same) != F.max("value").over(same)))
    found: dict[str, Column] = {}
    for known, name, sides in ((units, "unit", (("source", F.lit(True)), ("target", ~condition))), (predicates, "predicate", (("target", condition),))):
        for end, concerned in sides if known is not None else ():
            mark = f"_{name}_{end}"
            r = r.join(known.select(key, F.col(name).alias(end), F.lit(True).alias(mark)).distinct(), [key, end], "left")
            found[mark] = concerned & F.col(mark).isNull()
    unknown = {n: reduce(or_, [c for m, c in found.items() if m.startswith(f"_{n[8:]}_")], F.lit(False)) for n in ("unknown_unit", "unknown_predicate")}
    ordered = reach(_ordered(r, key, "requires", "precedes"), key)
    back = ordered.join(ordered.select(key, F.col("source").alias("target"), F.col("target").alias("source")), [key, "source", "target"], "left_semi")
    needed = reach(_ordered(r, key, "requires"), key)
    needed = needed.unionByName(needed.select(key, F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    marks = back.withColumn("_cycle", F.lit(True)).join(needed.withColumn("_needed", F.lit(True)), [key, "source", "target"], "full")
    r = r.join(marks, [key, "source", "target"], "left")
    other = F.col("source") != F.col("target")
    rules = unknown | {"conflict": F.col("_values"), "self": ~other & ~free & ~condition, "duplicate": F.col("_n") > 1, "cycle": F.col("_cycle") & ~free & ~condition, "exclusive_dependency": F.col("_needed") & free & other}
    problems = F.array_compact(F.array(*(F.when(broken, name) for name, broken in rules.items())))
    return r.withColumn("problems", problems).drop("_n", "_cycle", "_needed", "_values", *found, *([] if "value" in relations.columns else ["value"]))


def requirement_cycles(relations: DataFrame, key: str = "run_id") -> DataFrame:
    """Keys whose ``requires`` and ``precedes`` relations hold a cycle of any length."""
    return reach(_ordered(relations, key, "requires", "precedes"), key).where("source = target").select(key).distinct()
