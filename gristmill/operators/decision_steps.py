"""Steps that ask questions: what goes to the one who answers, and what becomes of the answers.

Questions are known before any data is read; sources and answers are columns. Answers come as JSON text,
{"results": [{"question", "status", "issues", "answer"}]}, where an answer is an array of the ids of options; that to a
predicate holds one of true, false and unknown. The order of questions is the asker's, whatever the order of the answers.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.comparisons import canonical
from ..functions.values import bound, kind, text_of
from ..plans.workflow import Outcome
from .decisions import answerability_problems, choice_problems, question_problems, with_fallback

RESULTS = "struct<results: array<struct<question: string, status: string, issues: array<string>, answer: array<string>>>>"
# fixed values: what an answer may say of itself
STATUSES = ("answerable", "partially_answerable", "not_answerable", "undetermined")
VERDICTS = ("true", "false", "unknown")


@dataclass(frozen=True)
class Question:
    """``kind``: choice, multiselect, ordinal or predicate. Empty ids, prompts and sources are filled in by ``asked``."""

    kind: str = "choice"
    options: tuple[str, ...] = ()
    id: str = ""
    prompt: str = ""
    sources: tuple[str, ...] = ()
    least: int = 0
    most: int | None = None


def asked(step: str, instructions: str, sources: Sequence[str], questions: Question | Sequence[Question]) -> list[Question]:
    """The questions of a step. A question by itself takes the step's name and instructions, and may use all sources; of
    several, each has its own id, prompt and sources."""
    if isinstance(questions, Question):
        return [replace(questions, id=questions.id or step, prompt=questions.prompt or instructions, sources=questions.sources or tuple(sources))]
    if not questions or len({q.id for q in questions}) < len(questions):
        raise ValueError(f"{step}: no question, or two with the same id")
    for q in questions:
        if not (q.id and q.prompt and q.sources) or set(q.sources) - set(sources):
            raise ValueError(f"{step}: {q.id or 'a question'} lacks an id, a prompt or sources, or names a source that is not there")
    return list(questions)


def decision_input(questions: Sequence[Question], sources: Mapping[str, Column], as_json: Collection[str] = ()) -> Column:
    """Sources (variants) as texts, beside the questions; those ``as_json`` as canonical JSON. NULL where a source is
    missing or blank, or should be a text and is none."""

    def text(name: str, value: Column) -> Column:
        own = canonical(F.to_json(value)) if name in as_json else F.when(kind(value) == "string", text_of(value))
        return F.when(own.rlike(r"(?U)\S"), own)

    texts = {name: text(name, value) for name, value in sources.items()}
    documents = F.array(*(F.struct(F.lit(name).alias("id"), t.alias("text")) for name, t in texts.items()))
    options = lambda q: F.array(*map(F.lit, q.options)).cast("array<string>")
    listed = F.array(*(F.struct(F.lit(q.id).alias("id"), F.lit(q.kind).alias("type"), F.lit(q.prompt).alias("prompt"), options(q).alias("options"), F.array(*map(F.lit, q.sources)).alias("sources")) for q in questions))
    return F.when(reduce(and_, (t.isNotNull() for t in texts.values())), F.struct(documents.alias("sources"), listed.alias("questions")))


def _answer_to(q: Question, results: Column) -> Column:
    return F.try_element_at(F.filter(results, lambda r: r.question == q.id), F.lit(1))


def _broken(q: Question, item: Column) -> Column:
    """Rules that the answer to one question breaks, each after the question's id."""
    answer = F.coalesce(item.answer, F.array().cast("array<string>"))
    issues, first = F.coalesce(item.issues, F.array().cast("array<string>")), F.try_element_at(answer, F.lit(1))
    rules = answerability_problems(q.kind, item.status, issues, F.size(answer) > 0, first)
    if q.kind == "predicate":
        few = choice_problems(answer, list(VERDICTS), 1, 1)
    else:
        most = q.most if q.kind == "multiselect" else 1
        few = choice_problems(answer, list(q.options), q.least if q.kind == "multiselect" else 0, most)
        few = F.when(F.size(answer) > 0, few).otherwise(F.array().cast("array<string>"))
    known = F.coalesce(item.status.isin(*STATUSES), F.lit(False))
    found = F.when(known, F.concat(rules, few)).otherwise(F.array(F.lit("unknown-status")))
    return F.when(item.isNotNull(), F.transform(found, lambda p: F.concat(F.lit(f"{q.id}:"), p))).otherwise(F.array().cast("array<string>"))


def decision_result(output: Column, questions: Sequence[Question], single: bool = False, fallback: str | None = None, on: Collection[str] = ()) -> Column:
    """Of answers (JSON text): problems; results in the order of the questions; answerable, whether all are; answer_key, the
    answer to a single question; issues of the open questions, none where one is undetermined; selection and origin (model or
    fallback) of a single choice. All but problems are NULL where there are any."""
    if single and len(questions) != 1:
        raise ValueError("a single question is one question")
    # each text is parsed once, and each answer looked up once
    return bound(F.from_json(output, RESULTS).results, lambda results: bound(F.struct(results.alias("all"), *(_answer_to(q, results).alias(f"q{k}") for k, q in enumerate(questions))), lambda x: _judged(x, questions, single, fallback, on)))


def _judged(x: Column, questions: Sequence[Question], single: bool, fallback: str | None, on: Collection[str]) -> Column:
    results, items = x["all"], [x[f"q{k}"] for k in range(len(questions))]
    none = F.array().cast("array<string>")
    problems = F.concat(question_problems([q.id for q in questions], F.transform(results, lambda r: r.question)), *(_broken(q, i) for q, i in zip(questions, items, strict=True)))
    problems = F.when(results.isNull() | F.exists(results, lambda r: r.question.isNull()), F.array(F.lit("malformed"))).otherwise(problems)
    answerable = reduce(and_, (i.status == "answerable" for i in items))
    undetermined = ~reduce(and_, (i.status != "undetermined" for i in items))
    open_issues = F.array_distinct(F.concat(*(F.when(i.status != "answerable", F.coalesce(i.issues, none)).otherwise(none) for i in items)))
    issues = F.when(undetermined, none).otherwise(open_issues)
    key = F.when(answerable, F.try_element_at(items[0].answer, F.lit(1))) if single else F.lit(None).cast("string")

    def whole(y: Column) -> Column:
        selection, origin = y.key if single and questions[0].kind == "choice" else F.lit(None).cast("string"), F.lit(None).cast("string")
        if single and questions[0].kind == "choice":
            origin = F.when(y.answerable, "model")
            if fallback is not None:
                taken, how = with_fallback(y.key, items[0].status, y.issues, fallback, list(on))
                selection, origin = taken, F.when(how == "fallback", how).otherwise(origin)
        parts = {"results": F.array(*items), "answerable": y.answerable, "answer_key": y.key, "issues": y.issues, "selection": selection, "origin": origin}
        good = F.size(y.problems) == 0
        return F.struct(y.problems.alias("problems"), *(F.when(good, c).alias(n) for n, c in parts.items()))

    return bound(F.struct(problems.alias("problems"), answerable.alias("answerable"), key.alias("key"), issues.alias("issues")), whole)


def decided(decision: Column) -> Outcome:
    """What a step of a workflow makes of a decision_result: it goes on with answers, asks for a review without, and fails where
    there are problems."""
    good = F.size(decision.problems) == 0
    value = F.to_variant_object(F.struct(decision.results.alias("results"), decision.answer_key.alias("answer_key"), decision.selection.alias("selection")))
    issues = F.coalesce(decision.issues, F.array().cast("array<string>"))
    return Outcome(F.when(good, value), F.when(decision.answerable, "completed").otherwise("needs_review"), F.when(~good, "invalid_output"), issues, decision.origin)
