"""Records inside records: which one owns a place in a run's result, and sums of usage by containment.

A result is a document of flows; a flow has steps, and a step that is a collection has items, each the record of a flow:
/flows/<flow>/steps/<step>/result/items/<n>/steps/... (partial_result where the collection failed).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import bound, kind, member, member_each, text_of, tokens_of

#: Fixed value: the kind of steps that are collections.
COLLECTION = "flow_collection"


def owner(document: Column, path: Column) -> Column:
    """struct(owner, status): the innermost record on the way down a document along a JSON pointer, NULL where there is none.

    A walk over the pointer's tokens; each row's own document and pointer, so no records are listed or joined.
    """
    none = F.lit(None).cast("string")
    start = F.struct(F.lit("root").alias("state"), document.alias("node"), F.lit("").alias("at"), none.alias("owner"), none.alias("status"))

    def step(w: Column, token: Column) -> Column:
        # below an end nothing counts; what is found, and what it is, are each computed once a token
        return bound(F.when(w.state != "end", member_each(w.node, token)), lambda below: bound(state(w, token, below), lambda after: moved(w, token, below, after)))

    def state(w: Column, token: Column, below: Column) -> Column:
        object_ = kind(below) == "object"
        item = token.rlike(r"\A(0|[1-9][0-9]{0,3})\z") & (kind(w.node) == "array")
        marked = token.isin("result", "partial_result") & (text_of(member(w.node, "kind")) == COLLECTION)
        return (
            F.when((w.state == "root") & (token == "flows"), "flows").when((w.state == "flows") & object_, "flow").when((w.state == "flow") & (token == "steps"), "steps")
            .when((w.state == "steps") & object_, "step").when((w.state == "step") & marked, "ledger").when((w.state == "ledger") & (token == "items"), "items")
            .when((w.state == "items") & item & object_, "flow").otherwise("end")
        )

    def moved(w: Column, token: Column, below: Column, after: Column) -> Column:
        at = F.concat(w.at, F.lit("/"), F.replace(F.replace(token, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
        record = after.isin("flow", "step")
        status = F.coalesce(text_of(member(below, "status")), none)
        return F.struct(after.alias("state"), below.alias("node"), at.alias("at"), F.when(record, at).otherwise(w.owner).alias("owner"), F.when(record, status).otherwise(w.status).alias("status"))

    return F.aggregate(tokens_of(path), start, step, lambda w: F.struct(w.owner.alias("owner"), w.status.alias("status")))


def owners_in(checks: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Checks (key, path, ...) with owner_path and owner_status from results (key, document)."""
    both = checks.join(results.select(key, F.col("document").alias("_document")), key, "left")
    both = both.withColumn("_owner", owner(F.col("_document"), F.col("path")))
    return both.select(*checks.columns, F.col("_owner.owner").alias("owner_path"), F.col("_owner.status").alias("owner_status"))


def roll_up(records: DataFrame, key: str, path: str, measures: Mapping[str, str], depth: int | None = None) -> DataFrame:
    """key, path and, for each measure (name: column), known (sum of what is known), unknown (records without it) and total
    (NULL if any is unknown) of each record with all that lies inside it.

    path: an array of ordinals, [] for the run itself; each record adds itself to each of its prefixes once, so a parent's own
    usage and that of its children are counted once each. depth: only totals of so many ordinals at most.
    """
    most = F.size(path) if depth is None else F.least(F.size(path), F.lit(depth))
    each = records.select(key, F.explode(F.transform(F.sequence(F.lit(0), most), lambda n: F.slice(F.col(path), F.lit(1), n))).alias(path), *(F.col(c).alias(f"_{m}") for m, c in measures.items()))
    sums = [c for m in measures for c in (F.coalesce(F.sum(f"_{m}"), F.lit(0)).alias(f"{m}_known"), F.count_if(F.col(f"_{m}").isNull()).alias(f"{m}_unknown"))]
    out = each.groupBy(key, path).agg(*sums)
    return out.withColumns({f"{m}_total": F.when(F.col(f"{m}_unknown") == 0, F.col(f"{m}_known")) for m in measures})
