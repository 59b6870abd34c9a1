"""Decision workflows as DataFrame programs: a row is a run, and every flow is a few columns.

A workflow is an acyclic graph of flows; each routed flow runs at most once, so visiting flows in topological order needs
one pass over the rows and no iteration over data. Failures are data: a failed step ends its run, and the payload that
comes out is the one that went in. A review ends a flow early; it leads where ``on_review`` says, or ends the run.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settled
from ..functions.conditions import equal, holds
from ..functions.values import bind, given, kind, lookup, object_of, text_of, tokens
from ..operators.decisions import ISSUES, review_target

Binding = Mapping[str, Any]
#: What ends a run.
OUTCOMES = ("completed", "needs_review")


@dataclass(frozen=True)
class Outcome:
    """What a step makes of a row: a value, and a status or a code of failure where it has one.

    ``issues``: why it asks for a review; ``origin``: model or fallback, for a category that it selects. A row whose issues or
    origin do not fit its status fails.
    """

    result: Column
    status: Column | None = None
    error: Column | None = None
    issues: Column | None = None
    origin: Column | None = None


@dataclass(frozen=True)
class Step:
    """One step of a flow: ``run`` maps input columns to a value or an Outcome, inside the same program.

    ``provider`` is for what columns cannot express, such as calls to services: it gets the rows that need it, filtered
    (run_id and a column for each input), and returns run_id, result (JSON text), status and, if it likes, error (a code of
    failure), which are joined back. What a failed row returns is its partial result. Providers may be called again for the same row, so they only read.
    """

    name: str
    run: Callable[[dict[str, Column]], Column | Outcome] | None = None
    inputs: Mapping[str, Binding] = field(default_factory=dict)
    when: Mapping[str, Any] | None = None
    provider: Callable[[DataFrame], DataFrame] | None = None


@dataclass(frozen=True)
class Repeat:
    """Up to ``max_attempts`` runs of a flow, until a condition over /flows holds; ``next_input`` binds keys of the next input
    anew, beside those of the flow's own input.

    ``retry``: a flow that runs between two attempts, on ``retry_input``; its record is that of a flow of its name. Its failure
    ends the run, its review the repeat, and so does ``continue_when`` where it does not hold after it.
    """

    max_attempts: int
    until: Mapping[str, Any]
    next_input: Mapping[str, Binding] = field(default_factory=dict)
    retry: Flow | None = None
    retry_input: Mapping[str, Binding] = field(default_factory=dict)
    continue_when: Mapping[str, Any] | None = None


@dataclass(frozen=True)
class Cases:
    """Targets by the text that a pointer finds; null or unknown text leads to the default, other values fail the run."""

    pointer: str
    targets: Mapping[str, str]
    default: str


@dataclass(frozen=True)
class Flow:
    """``next``: a target, a list of (condition, target) with a last (None, target), or Cases. Targets: flows or outcomes.

    ``on_review``: a target, or targets by issue with a ``default``, where all issues of the review must agree on one; None for
    the workflow's own.
    """

    name: str
    steps: Sequence[Step]
    next: str | Sequence[tuple[Mapping | None, str]] | Cases = "completed"
    on_review: str | Mapping[str, str] | None = None
    input: Mapping[str, Binding] | None = None
    output: Binding | None = None
    repeat: Repeat | None = None


def targets(rule: str | Sequence | Cases) -> list[str]:
    if isinstance(rule, str):
        return [rule]
    return [*rule.targets.values(), rule.default] if isinstance(rule, Cases) else [t for _, t in rule]


def review_targets(flow: Flow) -> list[str]:
    return list(flow.on_review.values()) if isinstance(flow.on_review, Mapping) else [flow.on_review]


@dataclass(frozen=True)
class Workflow:
    flows: Sequence[Flow]
    start: str | Sequence[tuple[Mapping | None, str]] | Cases
    output: Binding | None = None
    max_steps: int = 128
    #: Where reviews of flows lead that do not say it themselves.
    on_review: str | Mapping[str, str] = "needs_review"

    def __post_init__(self) -> None:
        inherited = [replace(f, on_review=self.on_review) if f.on_review is None else f for f in self.flows]
        object.__setattr__(self, "flows", inherited)
        if any(isinstance(f.on_review, Mapping) and ("default" not in f.on_review or set(f.on_review) - {"default", *ISSUES}) for f in inherited):
            raise ValueError("reviews by issue have a default, and name issues that there are")

    def order(self) -> list[Flow]:
        """Flows in topological order; a cycle, an unknown target or a flow out of reach is an error."""
        by_name = {f.name: f for f in self.flows}
        if len(by_name) != len(self.flows):
            raise ValueError("two flows have the same name")
        done: list[str] = []

        def visit(name: str, path: tuple[str, ...]) -> None:
            if name in OUTCOMES:
                return
            if name not in by_name:
                raise ValueError(f"unknown target {name!r}")
            if name in path:
                raise ValueError(f"cycle: {' -> '.join([*path, name])}")
            if name not in done:
                f = by_name[name]
                if "completed" in review_targets(f):
                    raise ValueError(f"{name}: a review never completes a run")
                for t in [*targets(f.next), *review_targets(f)]:
                    visit(t, (*path, name))
                done.append(name)

        for rule in [self.start, *(f.next for f in self.flows)]:
            if isinstance(rule, (list, tuple)) and (not rule or rule[-1][0] is not None or any(c is None for c, _ in rule[:-1])):
                raise ValueError("the last entry of a route, and only that, has no condition")
        for t in targets(self.start):
            if t in OUTCOMES:
                raise ValueError("a run starts with a flow")
            visit(t, ())
        if lost := set(by_name) - set(done):
            raise ValueError(f"never reached: {sorted(lost)}")
        return [by_name[n] for n in reversed(done)]

    def unavailable(self) -> list[tuple[str, str]]:
        """(where, pointer) of bindings without a default that read a flow which does not run before on every path."""
        order, before = self.order(), {}
        into: dict[str, list[str]] = {}
        for source, target in self.edges():
            into.setdefault(target, []).append(source)
        for f in order:
            common = [before[p] if p != "start" else frozenset() for p in into[f.name]]
            before[f.name] = frozenset.intersection(*common) | {f.name}
        ends = [before[f.name] for f in order if any(t in OUTCOMES for t in [*targets(f.next), *review_targets(f)])]
        out = []
        for f in order:
            again = f.repeat
            helper = {again.retry.name} if again and again.retry else frozenset()
            sides = [(f.input or {}, before[f.name] - {f.name})]
            sides += [(again.next_input, before[f.name] | helper), (again.retry_input, before[f.name])] if again else []
            out += [(f.name, p) for bindings, known in sides for b in bindings.values() for p in _lacking(b, known)]
        return out + [("output", p) for p in _lacking(self.output or {"literal": None}, frozenset.intersection(*ends) if ends else frozenset())]

    def edges(self) -> list[tuple[str, str]]:
        return [("start", t) for t in targets(self.start)] + [(f.name, t) for f in self.order() for t in dict.fromkeys([*targets(f.next), *review_targets(f)])]

    def mermaid(self) -> str:
        return "\n".join(["flowchart TD", *(f"  {a} --> {b}" for a, b in self.edges())])

    def run(self, envelopes: DataFrame) -> DataFrame:
        """Runs of envelopes (run_id, payload and metadata as variants): status, payload, error, steps_used, transitions,
        and for each flow a struct of status, result, attempts, stopped_by and its steps."""
        order = self.order()
        if lacking := self.unavailable():
            raise ValueError(f"results that are not there on every path, and have no default: {lacking}")
        df = envelopes.select("run_id", "payload", "metadata")
        context = {"/payload": F.col("payload"), "/metadata": F.col("metadata")}
        first, wrong = _target(context, self.start)
        df = df.withColumns({"current": first, "status": F.when(wrong, "failed"), "error": F.when(wrong, "invalid_input"), "steps_used": F.lit(0)})
        df = df.withColumn("transitions", F.array(F.struct(F.lit("start").alias("source"), F.col("current").alias("target"))))
        for flow in order:
            df = self._visit(df, flow, dict(context))
            context |= _records(flow)
        failed = F.col("status") == "failed"
        out = bind(context, self.output) if self.output is not None else F.col("payload")
        lost = ~failed & out.isNull()
        df = df.withColumns({"_out": out, "error": F.when(lost, "missing_binding").otherwise(F.col("error")), "status": F.when(lost, "failed").otherwise(F.col("status"))})
        payload = F.when(F.col("status") == "failed", F.col("payload")).otherwise(F.col("_out")).alias("payload")
        return df.select("run_id", "status", payload, "metadata", "error", "steps_used", "transitions", *(n for f in order for n in _columns(f)))

    def _visit(self, df: DataFrame, flow: Flow, context: dict[str, Column]) -> DataFrame:
        here = F.col("status").isNull() & (F.col("current") == flow.name)
        own = F.col("payload") if flow.input is None else _object(context, flow.input)
        df = df.withColumns({"_here": here, "_input": own})
        lost = F.col("_here") & F.col("_input").isNull()
        df = df.withColumns({"_active": F.col("_here") & ~lost, "_status": F.when(lost, "failed").otherwise("skipped"), "_error": F.when(lost, "missing_binding")})
        df = df.withColumns({"_result": F.lit(None).cast("variant"), "_attempts": F.lit(0), "_stopped": F.lit(None).cast("string"), "_steps": F.lit(None).cast(_steps_type(flow))})
        if isinstance(flow.on_review, Mapping):
            df = df.withColumn("_issues", F.array().cast("array<string>"))
        df = self._rounds(df, flow, context) if flow.repeat else self._attempt(df, flow).withColumn("_failure", F.lit(None).cast("string"))
        record = [F.col(f"_{c}").alias(n) for c, n in (("status", "status"), ("result", "result"), ("error", "error"), ("attempts", "attempts"), ("stopped", "stopped_by"), ("steps", "steps"))]
        df = df.withColumn(flow.name, F.struct(*record, *([F.col("_history").alias("history")] if flow.repeat else [])))
        if flow.repeat and flow.repeat.retry:
            df = df.withColumn(flow.repeat.retry.name, F.struct(*(F.col(f"_q_{c}").alias(c) for c in ("status", "result", "error", "attempts", "steps"))))
        after, wrong = _target(context | _records(flow), flow.next)
        status = F.col(f"{flow.name}.status")
        review = F.lit(flow.on_review if isinstance(flow.on_review, str) else flow.on_review["default"])
        if isinstance(flow.on_review, Mapping) and len(flow.on_review) > 1:
            named = {k: t for k, t in flow.on_review.items() if k != "default"}
            review = review_target(F.col("_issues"), named, flow.on_review["default"])
        df = df.withColumns({"_target": F.when(status == "needs_review", review).otherwise(after), "_wrong": (status == "completed") & wrong})
        failed = F.col("_here") & ((status == "failed") | F.col("_wrong") | F.col("_failure").isNotNull())
        moved = F.col("_here") & ~failed
        ends = moved & F.col("_target").isin(*OUTCOMES)
        df = df.withColumns(
            {
                "error": F.when(failed, F.coalesce("_failure", "_error", F.lit("invalid_input"))).otherwise(F.col("error")),
                "status": F.when(failed, "failed").when(ends, F.col("_target")).otherwise(F.col("status")),
                "current": F.when(moved, F.col("_target")).otherwise(F.col("current")),
                "transitions": F.when(moved, F.concat("transitions", F.array(F.struct(F.lit(flow.name).alias("source"), F.col("_target").alias("target"))))).otherwise(F.col("transitions")),
            }
        )
        return df.drop(*(c for c in df.columns if c.startswith("_")))

    def _rounds(self, df: DataFrame, flow: Flow, context: dict[str, Column]) -> DataFrame:
        """Attempts of a repeated flow: each round works on the rows that go on, which are written down; the others are set aside."""
        none = F.lit(None).cast("string")
        fresh = {"_history": F.array().cast(HISTORY), "_failure": none}
        if flow.repeat.retry:
            fresh |= {"_q_status": none, "_q_result": none.cast("variant"), "_q_error": none, "_q_attempts": F.lit(0), "_q_steps": F.lit(None).cast(_steps_type(flow.repeat.retry))}
        df = settled(df.withColumns(fresh).repartition("run_id"))  # a source of few files would keep all rounds in few tasks
        parts, front = [df.where("NOT _active")], df.where("_active")
        for k in range(flow.repeat.max_attempts):
            front = self._attempt(front, flow)
            front = front.withColumn("_history", F.concat("_history", F.array(_entry("attempt", k + 1, "_status", "_result", "_error"))))
            front = settled(self._decide(front, flow, context, k + 1))
            parts.append(front.where("NOT _active"))
            front = front.where("_active")
            if front.isEmpty():
                break
        return settled(reduce(DataFrame.unionByName, parts))

    def _decide(self, df: DataFrame, flow: Flow, context: dict[str, Column], attempt: int) -> DataFrame:
        """Whether rows go on to another attempt, with which input. First a failure stops, then a review, until, the last
        attempt; then the retry flow runs, and may stop the repeat itself."""
        again = flow.repeat
        # all pointers into the attempts read one column, which is built once a row
        df = df.withColumn("_tries", _attempts(F.col("_history"), "attempt"))
        seen = context | _seen(flow.name, "_", F.col("_tries"))
        stop = F.when(F.col("_status") == "failed", "failure").when(F.col("_status") == "needs_review", "review").when(holds(seen, again.until), "until").when(F.lit(attempt >= again.max_attempts), "exhausted")
        df = df.withColumns({"_stopped": stop, "_failure": F.lit(None).cast("string")})
        if again.retry:
            df = self._retry(df, again, seen, attempt)
            seen = seen | _seen(again.retry.name, "_q_", _attempts(F.col("_history"), "retry"))
            if again.continue_when is not None:
                df = df.withColumn("_stopped", F.coalesce("_stopped", F.when(~holds(seen, again.continue_when), "continue_when")))
        bindings = {**(flow.input or {}), **again.next_input}
        df = df.withColumn("_next", _object(seen, bindings) if bindings else F.col("_input"))
        lost = F.col("_stopped").isNull() & F.col("_next").isNull()
        df = df.withColumns({"_stopped": F.when(lost, "failure").otherwise(F.col("_stopped")), "_failure": F.when(lost, "missing_binding").otherwise(F.col("_failure")), "_input": F.coalesce("_next", "_input")})
        return df.withColumn("_active", F.col("_stopped").isNull()).drop("_next", "_tries")

    def _retry(self, df: DataFrame, again: Repeat, seen: Mapping[str, Column], attempt: int) -> DataFrame:
        """Runs the retry flow on rows that have not stopped."""
        own = ("active", "input", "status", "result", "error", "attempts", "steps")
        none = F.lit(None).cast("string")
        df = df.withColumn("_go", F.col("_stopped").isNull()).withColumn("_asked", F.when(F.col("_go"), _object(seen, again.retry_input) if again.retry_input else F.col("payload")))
        df = df.withColumnsRenamed({"_go": "_m_go", **{f"_{c}": f"_m_{c}" for c in own}})
        lost = F.col("_m_go") & F.col("_asked").isNull()
        start = {"_active": F.col("_m_go") & ~lost, "_input": F.col("_asked"), "_status": F.when(lost, "failed"), "_result": none.cast("variant"), "_error": F.when(lost, "missing_binding"), "_attempts": F.col("_q_attempts"), "_steps": F.col("_q_steps")}
        df = self._attempt(df.withColumns(start), again.retry)
        ran = F.col("_m_go")
        df = df.withColumns({f"_q_{c}": F.when(ran, F.col(f"_{c}")).otherwise(F.col(f"_q_{c}")) for c in ("status", "result", "error", "attempts", "steps")})
        df = df.withColumn("_history", F.when(ran, F.concat("_history", F.array(_entry("retry", attempt, "_status", "_result", "_error")))).otherwise(F.col("_history")))
        df = df.drop(*(f"_{c}" for c in own), "_asked").withColumnsRenamed({f"_m_{c}": f"_{c}" for c in own})
        failed, review = F.col("_m_go") & (F.col("_q_status") == "failed"), F.col("_m_go") & (F.col("_q_status") == "needs_review")
        stop = F.when(failed, "failure").when(review, "review")
        return df.withColumns({"_stopped": F.coalesce("_stopped", stop), "_failure": F.when(failed, F.col("_q_error")), "_status": F.when(review, "needs_review").otherwise(F.col("_status"))}).drop("_m_go")

    def _attempt(self, df: DataFrame, flow: Flow) -> DataFrame:
        """Runs the flow's steps on active rows, one after the other, and keeps the record of the attempt."""
        inner = {"/payload": F.col("_input"), "/metadata": F.col("metadata")}
        df = df.withColumns({"_go": F.col("_active"), "_end": F.when(F.col("_active"), "completed"), "_why": F.lit(None).cast("string")})
        for step in flow.steps:
            s, r = f"_s_{step.name}", f"_r_{step.name}"
            wanted = F.col("_go") & (holds(inner, step.when) if step.when else F.lit(True))
            df = df.withColumns({"_do": wanted} | {f"_i_{k}": bind(inner, b) for k, b in step.inputs.items()})
            over = F.col("steps_used") >= self.max_steps
            lost = F.lit(False)
            for k in step.inputs:
                lost = lost | F.col(f"_i_{k}").isNull()
            bad = F.when(over, "step_limit").when(lost, "missing_binding")
            if step.provider is not None:
                df = df if df.isStreaming else settled(df)  # else rows and questions would each be computed anew from the source, at every such step
                asked = df.where(F.col("_do") & ~over & ~lost).select("run_id", *(F.to_json(F.col(f"_i_{k}")).alias(k) for k in step.inputs)).distinct()  # rows with one run_id are one question
                got = step.provider(asked)
                code = F.col("error") if "error" in got.columns else F.lit(None).cast("string")
                got = got.select("run_id", F.col("result").alias("_given"), F.col("status").alias("_said"), code.alias("_code"))
                df = df.join(got, "run_id", "left").withColumn("_value", F.try_parse_json("_given"))
                out = Outcome(F.col("_value"), F.coalesce("_said", F.lit("failed")), F.when(F.coalesce("_said", F.lit("failed")) == "failed", F.coalesce("_code", F.lit("dependency_failure"))))
            else:
                out = step.run({k: F.col(f"_i_{k}") for k in step.inputs})
                out = out if isinstance(out, Outcome) else Outcome(out)
                if out.issues is not None:  # all of it in one column: what its parts share is computed once
                    given = {n: c for n, c in vars(out).items() if c is not None}
                    df = df.withColumn("_whole", F.struct(*(c.alias(n) for n, c in given.items())))
                    out = Outcome(**{n: F.col(f"_whole.{n}") for n in given})
            codes = [c for c in (out.error, _unfit(out)) if c is not None]
            error = F.coalesce(bad, *codes) if codes else bad
            df = df.withColumn("_e", F.when(F.col("_do"), error))
            status = F.when(~F.col("_do"), "skipped").when(F.col("_e").isNotNull(), "failed").otherwise(out.status if out.status is not None else F.lit("completed"))
            df = df.withColumn(s, status)
            if isinstance(flow.on_review, Mapping) and out.issues is not None:
                df = df.withColumn("_issues", F.when(F.col("_do"), F.coalesce(out.issues, F.array().cast("array<string>"))).otherwise(F.col("_issues")))
            df = df.withColumns({r: F.when(F.col(s).isin(*OUTCOMES), out.result), f"_p_{step.name}": F.when(F.col(s) == "failed", out.result)})
            df = df.withColumns(
                {
                    "steps_used": F.col("steps_used") + (F.col("_do") & ~over).cast("int"),
                    "_end": F.when(F.col("_do") & (F.col(s) != "completed"), F.col(s)).otherwise(F.col("_end")),
                    "_go": F.col("_go") & (~F.col("_do") | (F.col(s) == "completed")),
                    "_why": F.coalesce("_why", "_e"),
                }
            ).drop("_do", "_e", "_given", "_said", "_code", "_value", "_whole", *(f"_i_{k}" for k in step.inputs))
            inner |= {f"/steps/{step.name}/status": _text(F.col(s)), f"/steps/{step.name}/result": F.col(r), f"/steps/{step.name}/error": _error(F.when(F.col(s) == "failed", F.col("_why"))), f"/steps/{step.name}/partial_result": F.col(f"_p_{step.name}")}
        result = bind(inner, flow.output) if flow.output is not None else F.col("_input")
        df = df.withColumn("_new", F.when(F.col("_end") != "failed", result))
        lost = F.col("_active") & (F.col("_end") == "completed") & F.col("_new").isNull()
        df = df.withColumns({"_why": F.when(lost, "missing_binding").otherwise(F.col("_why")), "_end": F.when(lost, "failed").otherwise(F.col("_end"))})
        keep = lambda new, old: F.when(F.col("_active"), F.col(new)).otherwise(F.col(old))
        steps = F.struct(*(F.struct(F.col(f"_s_{x.name}").alias("status"), F.col(f"_r_{x.name}").alias("result"), F.col(f"_p_{x.name}").alias("partial_result")).alias(x.name) for x in flow.steps))
        df = df.withColumns({"_status": keep("_end", "_status"), "_result": keep("_new", "_result"), "_error": keep("_why", "_error"), "_attempts": F.col("_attempts") + F.col("_active").cast("int"), "_steps": F.when(F.col("_active"), steps).otherwise(F.col("_steps"))})
        return df.drop("_go", "_end", "_why", "_new", *(f"_{c}_{x.name}" for x in flow.steps for c in "srp"))


def _unfit(out: Outcome) -> Column | None:
    """A code of failure where issues or origin do not fit the status that a step gives."""
    status = out.status if out.status is not None else F.lit("completed")
    reviews, wrong = status == "needs_review", []
    if out.issues is not None:
        wrong.append((F.size(F.array_except(out.issues, F.array(*map(F.lit, ISSUES)))) > 0) | (F.size(out.issues) != F.size(F.array_distinct(out.issues))) | ((F.size(out.issues) > 0) & ~reviews))
    if out.origin is not None:
        wrong.append(out.origin.isNotNull() & (~out.origin.isin("model", "fallback") | (reviews != (out.origin == "fallback"))))
    return F.when(reduce(or_, (F.coalesce(w, F.lit(False)) for w in wrong)), "invalid_output") if wrong else None


#: Attempts of a repeated flow and runs of its retry flow, in order.
HISTORY = "array<struct<role: string, attempt: int, status: string, result: variant, error: string>>"


def _entry(role: str, attempt: int, status: str, result: str, error: str) -> Column:
    return F.struct(F.lit(role).alias("role"), F.lit(attempt).alias("attempt"), F.col(status).alias("status"), F.col(result).alias("result"), F.col(error).alias("error"))


def _attempts(history: Column, role: str) -> Column:
    """The value of /flows/<name>/attempts."""

    def one(x: Column) -> Column:
        code = lambda: F.struct(x.error.alias("code")).alias("error")
        head = (x.attempt.alias("attempt"), x.status.alias("status"))
        good = F.to_variant_object(F.struct(*head, x.result.alias("result")))
        return F.when(x.result.isNotNull(), good).when(x.error.isNotNull(), F.to_variant_object(F.struct(*head, code()))).otherwise(F.to_variant_object(F.struct(*head)))

    return F.to_variant_object(F.transform(F.filter(history, lambda x: x.role == role), one))


def _error(code: Column) -> Column:
    return F.when(code.isNotNull(), F.to_variant_object(F.struct(code.alias("code"))))


def _seen(name: str, prefix: str, attempts: Column) -> dict[str, Column]:
    """What conditions and bindings see of a flow while it repeats."""
    root, at = f"/flows/{name}", lambda c: F.col(f"{prefix}{c}")
    return {f"{root}/status": _text(at("status")), f"{root}/result": at("result"), f"{root}/error": _error(at("error")), f"{root}/attempts": attempts}


def _lacking(binding: Binding, known: frozenset[str] | set[str]) -> list[str]:
    """Pointers that a binding cannot do without, to records of flows that are not known to have run."""
    if "default" in binding:
        return []
    if "fields" in binding:
        return [p for b in binding["fields"].values() for p in _lacking(b, known)]
    wanted = [binding["pointer"]] if "pointer" in binding else binding.get("first_of", [])

    def there(pointer: str) -> bool:
        parts = tokens(pointer)
        return len(parts) < 3 or parts[0] != "flows" or parts[1] in known or parts[2] == "status"

    return [] if any(map(there, wanted)) else list(wanted)


def _columns(flow: Flow) -> list[str]:
    return [flow.name, *([flow.repeat.retry.name] if flow.repeat and flow.repeat.retry else [])]


def _text(column: Column) -> Column:
    return F.parse_json(F.concat(F.lit('"'), column, F.lit('"')))


def _object(context: Mapping[str, Column], bindings: Mapping[str, Binding]) -> Column:
    parts = {k: bind(context, b) for k, b in bindings.items()}
    out = object_of(parts)
    for part in parts.values():
        out = F.when(part.isNotNull(), out)
    return out


def _records(flow: Flow) -> dict[str, Column]:
    """What later flows and the output see of a flow, and of its retry flow."""
    out = {}
    for name in _columns(flow):
        out |= {f"/flows/{name}/status": _text(F.col(f"{name}.status")), f"/flows/{name}/result": F.col(f"{name}.result"), f"/flows/{name}/error": _error(F.col(f"{name}.error"))}
        if flow.repeat:
            out[f"/flows/{name}/attempts"] = _attempts(F.col(f"{flow.name}.history"), "attempt" if name == flow.name else "retry")
    return out


def _steps_type(flow: Flow) -> str:
    return f"struct<{', '.join(f'`{s.name}`: struct<status: string, result: variant, partial_result: variant>' for s in flow.steps)}>"


def _target(context: Mapping[str, Column], rule: str | Sequence | Cases) -> tuple[Column, Column]:
    """(target, whether the row fails instead): the first condition that holds, or the case that equals the text."""
    if isinstance(rule, str):
        return F.lit(rule), F.lit(False)
    if isinstance(rule, Cases):
        value = lookup(context, rule.pointer)
        out = F.lit(rule.default)
        for k, t in rule.targets.items():
            out = F.when(equal(value, k), t).otherwise(out)
        return out, F.coalesce(kind(given(value)) != "string", F.lit(False))
    out = F.lit(rule[-1][1])
    for condition, t in reversed(rule[:-1]):
        out = F.when(holds(context, condition), t).otherwise(out)
    return out, F.lit(False)


def _named(workflow: Workflow, flow: str) -> Flow:
    for f in workflow.flows:
        if f.name == flow:
            return f
    raise ValueError(f"unknown flow {flow!r}")


def flow_input(workflow: Workflow, flow: str, payload: Column, metadata: Column, results: Mapping[str, Column] | None = None) -> Column:
    """The input that a workflow binds for a flow, given authored results of flows before it, as of completed ones; NULL where
    a binding without a default reads what is not given. Nothing runs."""
    f = _named(workflow, flow)
    context = {"/payload": payload, "/metadata": metadata}
    for name, value in (results or {}).items():
        context |= {f"/flows/{_named(workflow, name).name}/status": _text(F.lit("completed")), f"/flows/{name}/result": value}
    return payload if f.input is None else _object(context, f.input)


def run_flow(workflow: Workflow, flow: str, envelopes: DataFrame) -> DataFrame:
    """Runs of one flow on payloads as its input, with its attempts; what comes after it in the workflow does not run."""
    f = _named(workflow, flow)
    alone = replace(f, next="completed", on_review="needs_review", input=None)
    return Workflow([alone], flow, output={"pointer": f"/flows/{flow}/result"}, max_steps=workflow.max_steps).run(envelopes)


def run_step(workflow: Workflow, flow: str, step: str, envelopes: DataFrame) -> DataFrame:
    """Runs of one step on payloads as its flow's input, whatever its guard says; it must not read steps before it."""
    f = _named(workflow, flow)
    own = next((s for s in f.steps if s.name == step), None)
    if own is None:
        raise ValueError(f"unknown step {step!r}")
    if any(p.startswith("/steps/") for b in own.inputs.values() for p in [b.get("pointer", ""), *b.get("first_of", [])]):
        raise ValueError(f"{step!r} reads steps before it")
    alone = Flow(flow, [replace(own, when=None)], output={"pointer": f"/steps/{step}/result"})
    return Workflow([alone], flow, output={"pointer": f"/flows/{flow}/result"}, max_steps=workflow.max_steps).run(envelopes)


def identity_error(metadata: Column, tenant: Column, principal: Column) -> Column:
    """forbidden where the metadata names another tenant or principal than the caller's."""
    other = lambda name, own: F.coalesce(~text_of(lookup({"": metadata}, f"/{name}")).eqNullSafe(own), F.lit(False)) & lookup({"": metadata}, f"/{name}").isNotNull()
    return F.when(other("tenant_id", tenant) | other("principal_id", principal), "forbidden")
