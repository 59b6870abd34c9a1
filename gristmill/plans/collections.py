"""Batches of items, each run through a callable flow; a collection is a step, so flows of items may hold collections too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import settled
from ..functions.values import items_of, member, parse, text_of
from .workflow import Binding, Flow, Step, Workflow


def batch_error(items: Column, flows: list[str], most: int) -> Column:
    """invalid_input where a batch is no array of distinct ids with allowed flows and at most ``most`` items."""
    all_ = items_of(items)
    ids, named = F.transform(all_, lambda x: text_of(member(x, "id"))), F.transform(all_, lambda x: text_of(member(x, "flow")))
    good = (F.size(all_) <= most) & F.forall(ids, lambda i: F.coalesce(i.rlike(r"\A[a-z][a-z0-9_]*\z"), F.lit(False)))
    good = good & (F.size(ids) == F.size(F.array_distinct(ids))) & F.forall(named, lambda f: F.coalesce(f.isin(*flows), F.lit(False)))
    good = good & F.forall(all_, lambda x: member(x, "input").isNotNull())
    return F.when(~F.coalesce(good, F.lit(False)), "invalid_input")


def run_collection(batches: DataFrame, flows: list[Flow], most: int = 64) -> DataFrame:
    """run_id, pos, id, flow, status, result of each item of batches (run_id, items), and rows of status invalid_input
    (pos NULL) for batches that are rejected whole, before any item runs.

    Items after the first failure are skipped; a review does not stop a batch. Where a flow calls a service, items run one
    place after the other, so that nothing is called for items after a failure; flows that are columns alone need no such order.
    """
    checked = batches.withColumn("error", batch_error(F.col("items"), [f.name for f in flows], most))
    rejected = checked.where("error IS NOT NULL").select("run_id", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("flow"), F.col("error").alias("status"), F.lit(None).cast("variant").alias("result"))
    each = checked.where("error IS NULL").select("run_id", F.posexplode(items_of(F.col("items"))).alias("pos", "item"))
    each = each.select("run_id", "pos", text_of(member(F.col("item"), "id")).alias("id"), text_of(member(F.col("item"), "flow")).alias("flow"), member(F.col("item"), "input").alias("payload"))
    if not any(step.provider for f in flows for step in f.steps):
        return ledger(_run_items(each, flows)).unionByName(rejected)
    each = settled(each)
    last = each.agg(F.max("pos")).first()[0]
    parts, waiting = [], each
    for pos in range(-1 if last is None else last + 1):
        ran = settled(_run_items(waiting.where(F.col("pos") == pos), flows))
        parts.append(ran)
        waiting = waiting.where(F.col("pos") > pos).join(ran.where("status = 'failed'").select("run_id"), "run_id", "left_anti")
    ran = parts[0] if parts else _run_items(each, flows)
    for part in parts[1:]:
        ran = ran.unionByName(part)
    skipped = each.join(ran.select("run_id", "pos"), ["run_id", "pos"], "left_anti")
    skipped = skipped.select("run_id", "pos", "id", "flow", F.lit("skipped").alias("status"), F.lit(None).cast("variant").alias("result"))
    return ran.unionByName(skipped).unionByName(rejected)


def _run_items(each: DataFrame, flows: list[Flow]) -> DataFrame:
    out = None
    for flow in flows:
        alone = Workflow([Flow(flow.name, flow.steps, output=flow.output, repeat=flow.repeat)], flow.name)
        own = each.where(F.col("flow") == flow.name).withColumn("key", F.struct("run_id", "pos", "id"))
        runs = alone.run(own.select(F.col("key").alias("run_id"), "payload", F.lit(None).cast("variant").alias("metadata")))
        r = runs.select("run_id.*", F.lit(flow.name).alias("flow"), "status", F.col(f"{flow.name}.result").alias("result"))
        out = r if out is None else out.unionByName(r)
    return out


def collect(name: str, items: Binding, flows: list[Flow], most: int = 64, deepest: int = 4) -> Step:
    """A step that runs a collection: its result is the ledger {"items": [{"id", "flow", "status", "result"}]}.

    It needs review if an item does, and fails with the first item that fails, or with invalid_input; its ledger is then the
    partial result. Flows of items may have such steps themselves, ``deepest`` levels of them.
    """
    if _levels(flows) >= deepest:
        raise ValueError(f"collections nest {deepest} deep at most")

    def run(asked: DataFrame) -> DataFrame:
        batches = settled(asked.select("run_id", parse(F.col("items")).alias("items")))
        ran = run_collection(batches, flows, most)
        entry = F.to_json(F.struct("id", "flow", "status", "result"))
        each = ran.groupBy("run_id").agg(  # at most a batch's items
            F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", entry.alias("e"))))), lambda x: x.e), ",").alias("e"),
            F.bool_or(F.col("status") == "invalid_input").alias("bad"), F.bool_or(F.col("status") == "failed").alias("failed"), F.bool_or(F.col("status") == "needs_review").alias("review"),
        )
        all_ = batches.select("run_id").join(each, "run_id", "left")
        certain = lambda c: F.coalesce(F.col(c), F.lit(False))
        status = F.when(certain("bad") | certain("failed"), "failed").when(certain("review"), "needs_review").otherwise("completed")
        result = F.when(~certain("bad"), F.concat(F.lit('{"items":['), F.coalesce("e", F.lit("")), F.lit("]}")))
        return all_.select("run_id", result.alias("result"), status.alias("status"), F.when(certain("bad"), "invalid_input").when(certain("failed"), "item_failed").alias("error"))

    run.flows = flows
    return Step(name, inputs={"items": items}, provider=run)


def _levels(flows: list[Flow]) -> int:
    """How many levels of collections flows of items hold, their own counted."""
    return 1 + max((_levels(step.provider.flows) for f in flows for step in f.steps if hasattr(step.provider, "flows")), default=0)


def ledger(items: DataFrame) -> DataFrame:
    """Items with skipped as the status of those after the first failure of their run."""
    first = F.min(F.when(F.col("status") == "failed", F.col("pos"))).over(Window.partitionBy("run_id"))  # at most a batch's items
    d = items.withColumn("_first", first)
    after = F.coalesce(F.col("pos") > F.col("_first"), F.lit(False))
    d = d.withColumn("status", F.when(after, "skipped").otherwise(F.col("status")))
    return (d.withColumn("result", F.when(~after, F.col("result"))) if "result" in items.columns else d).drop("_first")
