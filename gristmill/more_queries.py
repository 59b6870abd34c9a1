"""Further queries by name, registered beside those of queries: schemas of any depth, static analysis, rounds, nested items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import dealt, shared_path
from .functions import comparisons as cmp
from .functions.usage import request_cost
from .functions.values import items_of, member, number_of, parse, text_of
from .operators import decision_steps as ds
from .operators import records as rc
from .operators import route_checks as rk
from .operators import static_checks as sc
from .operators import suites as st
from .operators import summaries as sm
from .operators.nested_schemas import validate
from .plans.collections import collect
from .plans.workflow import Cases, Flow, Outcome, Repeat, Step, Workflow, flow_input, run_flow
from .queries import _COST_SQL, _PRICES, query, table
from .sources import reports as rp
from .sources.journal import read_lines

# schemas of any depth

_FOUND = {"anyOf": [{"properties": {"role": {"const": "assistant"}, "n": {"exclusiveMinimum": 900}}}, {"properties": {"replies": {"contains": {"$ref": "#/$defs/found"}}}, "required": ["replies"]}]}
_TURN = {
    "type": "object", "required": ["role", "n"], "additionalProperties": False,
    "properties": {"role": {"enum": ["user", "assistant"]}, "n": {"$ref": "sizes.json#/$defs/size"}, "replies": {"type": "array", "maxItems": 2, "items": {"$ref": "#"}}},
    "if": {"properties": {"role": {"const": "user"}}}, "then": {"properties": {"n": {"maximum": 300}}}, "allOf": [{"if": {"properties": {"n": {"minimum": 1800}}}, "then": False}],
    "$defs": {"found": _FOUND},
}
#: The root must hold a long answer somewhere; all turns below it follow the same rules.
NESTED = {"$ref": "turn.json", "properties": {"n": True}, "anyOf": [{"$ref": "turn.json#/$defs/found"}]}
REGISTRY = {"turn.json": _TURN, "sizes.json": {"$defs": {"size": {"type": "integer", "minimum": 40}}}}


def threads(spark, sf_dir) -> DataFrame:
    """conv_id and value: each conversation as a tree in which turn t answers turn (t - 1) / 2."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").cast("int").alias("turn"), "role", F.length("text").alias("n")))).alias("turns"))
    none = F.create_map().cast("map<int,string>")

    def put(done, t):
        below = F.array_compact(F.array(F.get(F.map_values(F.map_filter(done, lambda k, _: k == 2 * t.turn + 1)), 0), F.get(F.map_values(F.map_filter(done, lambda k, _: k == 2 * t.turn + 2)), 0)))
        text = F.concat(F.lit('{"role":"'), t.role, F.lit('","n":'), t.n.cast("string"), F.when(F.size(below) > 0, F.concat(F.lit(',"replies":['), F.array_join(below, ","), F.lit("]"))).otherwise(""), F.lit("}"))
        return F.map_concat(done, F.create_map(t.turn, text))

    tree = F.aggregate(F.reverse("turns"), none, put, lambda done: done[0])
    return c.select("conv_id", parse(tree).alias("value"))


@query(
    """WITH RECURSIVE c AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations),
    tree AS (SELECT conv_id, turn, role, n, '' AS place FROM c WHERE turn = 0
      UNION ALL SELECT c.conv_id, c.turn, c.role, c.n, tree.place || '/replies/' || (c.turn - 1) % 2 FROM tree JOIN c ON c.conv_id = tree.conv_id AND (c.turn - 1) // 2 = tree.turn AND c.turn > 0),
    broken AS (SELECT conv_id, place || '/role enum' AS what FROM tree WHERE role NOT IN ('user', 'assistant')
      UNION ALL SELECT conv_id, place || '/n minimum' FROM tree WHERE n < 40
      UNION ALL SELECT conv_id, ltrim(place || ' if') FROM tree WHERE role = 'user' AND n > 300
      UNION ALL SELECT conv_id, ltrim(place || ' if') FROM tree WHERE n >= 1800
      UNION ALL SELECT conv_id, 'anyOf' FROM tree GROUP BY conv_id HAVING NOT bool_or(role = 'assistant' AND n > 900))
    SELECT t.conv_id, count(b.what) = 0 AS valid, coalesce(string_agg(DISTINCT b.what, ';' ORDER BY b.what), '') AS broken FROM (SELECT DISTINCT conv_id FROM tree) t LEFT JOIN broken b USING (conv_id) GROUP BY t.conv_id"""
)
def nested_schema(spark, sf_dir):
    """Trees of turns against a schema that refers to itself and to another document."""
    verdicts, broken = validate(threads(spark, sf_dir), "conv_id", "value", NESTED, REGISTRY)
    what = F.array_join(F.array_sort(F.collect_set(F.ltrim(F.concat_ws(" ", "place", "keyword")))), ";").alias("broken")
    return verdicts.join(broken.groupBy("conv_id").agg(what), "conv_id", "left").select("conv_id", "valid", F.coalesce("broken", F.lit("")).alias("broken"))


# static checks of many workflows

_GRAPH_SQL = """f AS (SELECT *, (rn - 1) // 8 AS part, CAST((rn - 1) % 8 AS BIGINT) AS i FROM (SELECT o_custkey, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)),
 w AS (SELECT o_custkey || '-' || part AS workflow, 'f' || i AS flow, i, k, max(i) OVER (PARTITION BY o_custkey, part) AS last FROM f),
 edges AS (SELECT workflow, '' AS source, 'f0' AS target FROM w WHERE i = 0
  UNION ALL SELECT workflow, '', 'f1' FROM w WHERE i = 1 AND k % 4 = 1
  UNION ALL SELECT workflow, flow, 'f' || (i + 1) FROM w WHERE i < last AND (k % 3 > 0 OR i + 2 > last)
  UNION ALL SELECT workflow, flow, 'f' || (i + 2) FROM w WHERE i + 2 <= last AND k % 3 < 2
  UNION ALL SELECT workflow, flow, '/end' FROM w WHERE i = last OR k % 5 = 0)"""


def _graphs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Flows (one for each order) and edges of workflows: up to eight orders of a customer."""
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    f = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("k"), rn.alias("rn"))
    f = f.select("o_custkey", F.concat_ws("-", "o_custkey", F.floor(F.col("rn") / 8)).alias("workflow"), F.concat(F.lit("f"), F.col("rn") % 8).alias("flow"), (F.col("rn") % 8).cast("long").alias("i"), "k")
    f = f.withColumn("last", F.max("i").over(Window.partitionBy("o_custkey", "workflow"))).drop("o_custkey")  # dealt by customer already
    i, k, last = F.col("i"), F.col("k"), F.col("last")
    name = lambda n: F.concat(F.lit("f"), n)
    ends = lambda source, target, when: F.when(when, F.struct(source.alias("source"), target.alias("target")))
    each = F.array_compact(
        F.array(
            ends(F.lit(sc.START), name(i), (i == 0) | (i == 1) & (k % 4 == 1)), ends(F.col("flow"), name(i + 1), (i < last) & ((k % 3 > 0) | (i + 2 > last))),
            ends(F.col("flow"), name(i + 2), (i + 2 <= last) & (k % 3 < 2)), ends(F.col("flow"), F.lit(sc.END), (i == last) | (k % 5 == 0)),
        )
    )
    return f, f.select("workflow", F.explode(each).alias("e")).select("workflow", "e.*")


@query(
    f"""WITH RECURSIVE {_GRAPH_SQL}, live AS (SELECT workflow, target AS flow FROM edges WHERE source = '' UNION SELECT e.workflow, e.target FROM live JOIN edges e ON e.workflow = live.workflow AND e.source = live.flow),
    around AS (SELECT w.workflow, w.flow AS gone, e.target AS flow FROM w JOIN edges e USING (workflow) WHERE e.source = '' AND e.target <> w.flow
      UNION SELECT a.workflow, a.gone, e.target FROM around a JOIN edges e ON e.workflow = a.workflow AND e.source = a.flow AND e.target <> a.gone)
    SELECT l.workflow, l.flow, w.flow AS dominator FROM live l JOIN w USING (workflow) WHERE l.flow <> w.flow AND (w.workflow, w.flow) IN (SELECT workflow, flow FROM live)
     AND NOT EXISTS (SELECT 1 FROM around a WHERE a.workflow = l.workflow AND a.gone = w.flow AND a.flow = l.flow)"""
)
def flow_dominators(spark, sf_dir):
    """Flows without which another is not reached; in SQL: what is not reached around them."""
    reached = sc.reachable(_graphs(spark, sf_dir)[1])
    return sc.dominators(reached).where((F.col("flow") != F.col("dominator")) & (F.col("dominator") != sc.START))


@query(
    f"""WITH RECURSIVE {_GRAPH_SQL}, live AS (SELECT workflow, target AS flow FROM edges WHERE source = '' UNION SELECT e.workflow, e.target FROM live JOIN edges e ON e.workflow = live.workflow AND e.source = live.flow),
    r AS (SELECT workflow, flow, '/flows/f' || (i * 5 + k) % 9 || '/result' AS pointer, 'f' || (i * 5 + k) % 9 AS needed, k % 6 = 0 AS by_default FROM w UNION ALL SELECT workflow, '/end', '/flows/f' || k % 3 || '/result', 'f' || k % 3, false FROM w WHERE i = 0),
    lost AS (SELECT DISTINCT r.workflow, r.flow AS reader, r.needed FROM r),
    around AS (SELECT l.workflow, l.needed AS gone, e.target AS flow FROM (SELECT DISTINCT workflow, needed FROM lost) l JOIN edges e USING (workflow) WHERE e.source = '' AND e.target <> l.needed
      UNION SELECT a.workflow, a.gone, e.target FROM around a JOIN edges e ON e.workflow = a.workflow AND e.source = a.flow AND e.target <> a.gone),
    p AS (SELECT r.workflow, r.flow, r.pointer, CASE WHEN (r.workflow, r.needed) NOT IN (SELECT workflow, flow FROM live) THEN 'invalid_flow_reference'
      WHEN NOT r.by_default AND (r.needed = r.flow OR (r.workflow, r.needed, r.flow) IN (SELECT workflow, gone, flow FROM around)) THEN 'unavailable_flow_reference' END AS problem
      FROM r WHERE (r.workflow, r.flow) IN (SELECT workflow, flow FROM live))
    SELECT * FROM p WHERE problem IS NOT NULL"""
)
def flow_availability(spark, sf_dir):
    """Reads of results that may not be there, by flows and by the workflow's output."""
    flows, edges = _graphs(spark, sf_dir)
    edges = sc.reachable(edges)
    target = lambda n: F.concat(F.lit("/flows/f"), n, F.lit("/result")).alias("pointer")
    reads = flows.select("workflow", "flow", target((F.col("i") * 5 + F.col("k")) % 9), (F.col("k") % 6 == 0).alias("by_default"))
    outputs = flows.where("i = 0").select("workflow", F.lit(sc.END).alias("flow"), target(F.col("k") % 3), F.lit(False).alias("by_default"))
    return sc.availability(edges, reads.unionByName(outputs), live_only=True)


@query(
    f"""WITH RECURSIVE {_GRAPH_SQL}, items AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
    worst AS (SELECT workflow, flow, (1 + k % 4) * (1 + k % 3 + coalesce(n, 0) * CASE WHEN k % 2 = 0 THEN 2 * (1 + 3 * 4) ELSE greatest(2 * (1 + 3 * 4), 5) END) + (k % 4) * CASE WHEN k % 7 < 3 THEN 5 ELSE 0 END AS worst FROM w LEFT JOIN items USING (k)),
    path AS (SELECT e.workflow, e.target AS flow, [e.target] AS path, worst.worst AS total, CASE WHEN worst.worst > 1500 THEN e.target END AS crossing FROM edges e JOIN worst ON worst.workflow = e.workflow AND worst.flow = e.target WHERE e.source = ''
      UNION ALL SELECT p.workflow, e.target, list_append(p.path, e.target), p.total + x.worst, coalesce(p.crossing, CASE WHEN p.total + x.worst > 1500 THEN e.target END)
      FROM path p JOIN edges e ON e.workflow = p.workflow AND e.source = p.flow JOIN worst x ON x.workflow = e.workflow AND x.flow = e.target)
    SELECT workflow, total, array_to_string(path, '>') AS path, crossing FROM path QUALIFY row_number() OVER (PARTITION BY workflow ORDER BY total DESC, path) = 1"""
)
def flow_budgets(spark, sf_dir):
    """Worst cases of runs with attempts, retries and collections inside collections; in SQL: all paths."""
    flows, edges = _graphs(spark, sf_dir)
    k = F.col("k")
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    f = flows.join(items, "k", "left").fillna(0, ["n"])
    own = f.select("workflow", "flow", (1 + k % 3).alias("steps"), (1 + k % 4).alias("attempts"))
    each_workflow = flows.where("i = 0").select("workflow")
    helpers = each_workflow.select("workflow", F.explode(F.array(*(F.struct(F.lit(n).alias("flow"), F.lit(s).alias("steps"), F.lit(a).alias("attempts")) for n, s, a in (("outer", 1, 2), ("inner", 4, 1), ("again", 5, 1))))).alias("h"))
    own = own.unionByName(helpers.select("workflow", "h.*"))
    call = lambda callee, kind, step, times: F.struct(F.lit(callee).alias("callee"), F.lit(kind).alias("kind"), F.lit(step).alias("step"), times.cast("long").alias("times"))
    one = F.lit(1)
    each = F.array_compact(F.array(call("outer", "item", "s", F.col("n")), F.when(k % 2 == 1, call("again", "item", "s", F.col("n"))), F.when(k % 7 < 3, call("again", "retry", "r", one))))
    calls = f.select("workflow", "flow", F.explode(each).alias("c")).select("workflow", "flow", "c.*")
    calls = calls.unionByName(each_workflow.select("workflow", F.lit("outer").alias("flow"), call("inner", "item", "s", F.lit(3)).alias("c")).select("workflow", "flow", "c.*"))
    found = sc.step_budgets(sc.reachable(edges), sc.worst_steps(own, calls), 1500)
    return found.withColumn("path", F.array_join("path", ">"))


# records inside records


@query(
    """WITH c AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations)
    SELECT conv_id, turn, '/flows/f/steps/each/result/items/' || turn || '/steps/s/partial_result/items/' || turn % 3 || '/result/x' AS path,
    '/flows/f/steps/each/result/items/' || turn || CASE WHEN role = 'user' THEN '/steps/s' || CASE WHEN turn % 3 < 2 THEN '/partial_result/items/' || turn % 3 ELSE '' END ELSE '' END AS owner_path,
    CASE WHEN role <> 'user' THEN 'completed' WHEN turn % 3 < 2 THEN CASE WHEN n > 150 THEN 'failed' ELSE 'skipped' END ELSE 'failed' END AS owner_status FROM c"""
)
def nested_owners(spark, sf_dir):
    """Checks inside collections inside collections find the record that they are about, or the last that is there."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), "role", F.length("text").alias("n"))
    inner = F.concat(F.lit('{"flow":"h","status":"'), F.when(F.col("n") > 150, "failed").otherwise("skipped"), F.lit('","result":{"x":1}}'))
    steps = F.when(F.col("role") == "user", F.concat(F.lit(',"steps":{"s":{"status":"failed","kind":"flow_collection","partial_result":{"items":['), inner, F.lit(","), inner, F.lit("]}}}"))).otherwise("")
    item = F.concat(F.lit('{"flow":"g","status":"completed"'), steps, F.lit("}"))
    docs = c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", item.alias("item")))), lambda x: x.item), ",").alias("items"))
    text = F.concat(F.lit('{"flows":{"f":{"status":"completed","steps":{"each":{"status":"completed","kind":"flow_collection","result":{"items":['), "items", F.lit("]}}}}}}"))
    path = F.concat(F.lit("/flows/f/steps/each/result/items/"), "turn", F.lit("/steps/s/partial_result/items/"), F.col("turn") % 3, F.lit("/result/x"))
    return rc.owners_in(c.select("conv_id", F.col("turn").cast("long").alias("turn"), path.alias("path")), docs.select("conv_id", parse(text).alias("document")), "conv_id")


@query(
    """WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
    l AS (SELECT o.o_custkey, o.i, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS j, l_suppkey AS t FROM o JOIN lineitem ON l_orderkey = o_orderkey),
    r AS (SELECT c_custkey AS run_id, NULL AS i, NULL AS j, c_nationkey AS t FROM customer UNION ALL SELECT o_custkey, i, NULL, CASE WHEN o_orderkey % 50 > 0 THEN o_orderkey % 97 END FROM o UNION ALL SELECT o_custkey, i, j, t FROM l),
    p AS (SELECT run_id, '' AS path, t FROM r UNION ALL SELECT run_id, '' || i, t FROM r WHERE i IS NOT NULL UNION ALL SELECT run_id, i || '/' || j, t FROM r WHERE j IS NOT NULL)
    SELECT run_id, path, CAST(coalesce(sum(t), 0) AS BIGINT) AS tokens_known, count(*) FILTER (t IS NULL) AS tokens_unknown, CASE WHEN count(*) = count(t) THEN CAST(sum(t) AS BIGINT) END AS tokens_total FROM p GROUP BY ALL"""
)
def nested_usage(spark, sf_dir):
    """Tokens of runs, of their items and of the items of these, each with all that lies inside."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("i"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    # a task keeps lines three times: sorted for the join, sorted by order, and summed by place
    lines = dealt(items, "l_orderkey").join(dealt(o, "o_orderkey", of=items), F.col("l_orderkey") == F.col("o_orderkey"))
    j = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    records = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.array().cast("array<int>").alias("path"), F.col("c_nationkey").cast("long").alias("t"))
    records = records.unionByName(o.select(F.col("o_custkey").alias("run_id"), F.array("i").alias("path"), F.when(F.col("o_orderkey") % 50 > 0, F.col("o_orderkey") % 97).cast("long").alias("t")))
    records = records.unionByName(lines.select(F.col("o_custkey").alias("run_id"), F.array("i", j).alias("path"), F.col("l_suppkey").cast("long").alias("t")))
    return rc.roll_up(records, "run_id", "path", {"tokens": "t"}).withColumn("path", F.array_join("path", "/"))


@query(
    """WITH c AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations),
    t AS (SELECT conv_id, turn, role, n, CASE WHEN n % 5 = 0 THEN 'needs_review' WHEN n > 1200 THEN 'failed' ELSE 'completed' END AS inner_status FROM c),
    u AS (SELECT *, CASE WHEN role = 'system' THEN CASE WHEN n > 150 THEN 'failed' ELSE 'completed' END ELSE inner_status END AS status FROM t),
    f AS (SELECT *, min(CASE WHEN status = 'failed' THEN turn END) OVER (PARTITION BY conv_id) AS bad FROM u)
    SELECT conv_id AS run_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'needs_review') THEN 'needs_review' ELSE 'completed' END AS status,
    string_agg(CASE WHEN turn > bad THEN 'skipped' ELSE status END, ',' ORDER BY turn) AS items, CASE WHEN bool_or(status = 'failed') THEN 'item_failed' END AS error FROM f GROUP BY conv_id"""
)
def nested_collections(spark, sf_dir):
    """Turns as items of a collection, each of which (but those of the system) is a collection of one item itself."""
    size = lambda name, most, review: Step(name, lambda i: Outcome(i["n"], F.when(review(number_of(i["n"])), "needs_review").otherwise("completed"), F.when(~review(number_of(i["n"])) & (number_of(i["n"]) > most), "invalid_output")), {"n": {"pointer": "/payload/n"}})
    leaf = Flow("leaf", [size("size", 1200, lambda n: n % 5 == 0)])
    inside = Flow("talk", [collect("inner", {"pointer": "/payload/parts"}, [leaf])])
    plain = Flow("plain", [size("size", 150, lambda n: F.lit(False))])
    batch = Flow("batch", [collect("each", {"pointer": "/payload/items"}, [inside, plain])], output={"pointer": "/steps/each/result"})
    n = F.struct(F.length("text").alias("n"))
    part = F.to_variant_object(F.struct(F.array(F.struct(F.lit("p").alias("id"), F.lit("leaf").alias("flow"), n.alias("input"))).alias("parts")))
    item = F.struct(F.concat(F.lit("t"), "turn").alias("id"), F.when(F.col("role") == "system", "plain").otherwise("talk").alias("flow"), F.when(F.col("role") == "system", F.to_variant_object(n)).otherwise(part).alias("input"))
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("run_id")).agg(F.sort_array(F.collect_list(F.struct("turn", F.to_json(item).alias("item")))).alias("all"))
    payload = parse(F.concat(F.lit('{"items":['), F.array_join(F.transform("all", lambda x: x.item), ","), F.lit("]}")))
    runs = Workflow([batch], "batch").run(c.select("run_id", payload.alias("payload"), F.lit(None).cast("variant").alias("metadata")))
    each = F.coalesce(F.col("batch.steps.each.result"), F.col("batch.steps.each.partial_result"))
    statuses = F.array_join(F.transform(items_of(member(each, "items")), lambda x: text_of(member(x, "status"))), ",")
    return runs.select("run_id", "status", statuses.alias("items"), "error")


@query(
    """WITH RECURSIVE e AS (SELECT event_id, coalesce(value, user_id) AS v, user_id % 7 AS step, event_type FROM events),
    r AS (SELECT event_id, v, step, event_type, 1 AS n, v AS seen, CASE WHEN v < 0 THEN 'failure' WHEN v >= 150 THEN 'until' END AS stopped, false AS retried FROM e
     UNION ALL SELECT event_id, v, step, event_type, n + 1, seen, CASE WHEN seen >= 150 THEN 'until' WHEN n + 1 >= 6 THEN 'exhausted' END, true FROM (
       SELECT event_id, v, step, event_type, n, seen + step * n AS seen, retried,
        CASE WHEN stopped IS NOT NULL THEN 'x' END AS x FROM r WHERE stopped IS NULL) q WHERE x IS NULL AND NOT (event_type = 'error' AND n = 3) AND NOT (step = 0) AND NOT (step = 6 AND n = 2)),
    last AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC) AS k FROM r)
    SELECT event_id AS run_id, CAST(n AS INTEGER) AS attempts, seen AS result, coalesce(stopped, CASE WHEN n >= 6 THEN 'exhausted' WHEN event_type = 'error' AND n = 3 THEN 'failure' WHEN step = 6 AND n = 2 THEN 'review' WHEN step = 0 THEN 'continue_when' END) AS stopped_by,
     CASE WHEN stopped IS NULL AND event_type = 'error' AND n = 3 THEN 'failed' WHEN stopped IS NULL AND step = 6 AND n = 2 THEN 'needs_review' ELSE 'completed' END AS status,
     CASE WHEN stopped IS NULL AND event_type = 'error' AND n = 3 THEN 'dependency_failure' END AS error,
     CAST(n - 1 + (stopped IS NULL)::INTEGER AS INTEGER) AS retries FROM last WHERE k = 1"""
)
def repeat_retry(spark, sf_dir):
    """Attempts with a retry flow between them, which can fail, ask for review, or leave nothing to continue with."""
    as_value = lambda c: F.try_variant_get(F.to_variant_object(F.struct(c.alias("x"))), "$.x", "variant")
    n = lambda i, k: number_of(i[k])
    show = Step("show", lambda i: i["v"], {"v": {"pointer": "/payload/v"}})
    more = Step(
        "more", lambda i: Outcome(as_value(n(i, "step") * n(i, "attempt")), F.when((n(i, "step") == 6) & (n(i, "attempt") == 2), "needs_review").otherwise("completed"), F.when((text_of(i["type"]) == "error") & (n(i, "attempt") == 3), "dependency_failure")),
        {"step": {"pointer": "/payload/step"}, "attempt": {"pointer": "/payload/attempt"}, "type": {"pointer": "/payload/type"}},
    )
    add = Step("add", lambda i: as_value(n(i, "a") + n(i, "b")), {"a": {"pointer": "/payload/seen"}, "b": {"pointer": "/steps/more/result"}})
    retry = Flow("again", [more, add], output={"fields": {"sum": {"pointer": "/steps/add/result"}, "step": {"pointer": "/payload/step"}, "n": {"pointer": "/payload/attempt"}}})
    last = [f"/flows/grow/attempts/{k}/attempt" for k in range(5, -1, -1)]
    rounds = Repeat(
        6, {"pointer": "/flows/grow/result", "gte": 150}, {"v": {"pointer": "/flows/again/result/sum"}}, retry,
        {"seen": {"pointer": "/flows/grow/result"}, "step": {"pointer": "/payload/step"}, "type": {"pointer": "/payload/type"}, "attempt": {"first_of": last}}, {"pointer": "/flows/again/result/step", "gt": 0},
    )
    grow = Flow("grow", [show], input={"v": {"pointer": "/payload/v"}}, output={"pointer": "/steps/show/result"}, repeat=rounds)
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.to_variant_object(F.struct(F.coalesce("value", "user_id").alias("v"), (F.col("user_id") % 7).alias("step"), F.col("event_type").alias("type"))).alias("payload"), F.lit(None).cast("variant").alias("metadata"))
    runs = Workflow([grow], "grow").run(e)
    return runs.select("run_id", F.col("grow.attempts").alias("attempts"), number_of(F.col("grow.result")).alias("result"), F.col("grow.stopped_by").alias("stopped_by"), "status", "error", F.size(F.filter("grow.history", lambda x: x.role == "retry")).alias("retries"))


# evaluations that run


def sized_suite(spark, sf_dir, limit: int = 500) -> tuple[DataFrame, DataFrame, Workflow]:
    """Cases of documents, four expectations of each, and a workflow that fails, asks for review, or goes on to a second flow."""
    label = lambda c: F.try_variant_get(F.to_variant_object(F.struct(c.alias("x"))), "$.x", "variant")
    n = lambda i: number_of(i["n"])
    bound = {"n": {"pointer": "/payload/n"}}
    rule = Step("rule", lambda i: Outcome(label(F.when(n(i) >= limit, "long").otherwise("short")), F.when(n(i) < 100, "needs_review").otherwise("completed"), F.when(n(i) % 50 == 7, "invalid_output")), bound)
    mark = Step("mark", lambda i: F.to_variant_object(F.struct(F.when(n(i) % 2 == 0, "even").otherwise("odd").alias("kind"), F.array(F.struct((n(i) % 3).cast("int").alias("r")), F.struct((n(i) % 5).cast("int").alias("r"))).alias("parts"))), bound)
    flows = [Flow("size", [rule], Cases("/flows/size/result", {"long": "detail"}, "completed"), output={"pointer": "/steps/rule/result"}), Flow("detail", [mark], output={"pointer": "/steps/mark/result"})]
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select(F.col("doc_id").alias("case_id"), "lang", F.coalesce("n_chars", F.lit(0)).alias("n"), "quality")
    cases = d.select("case_id", "lang", F.to_json(F.struct(F.struct("n").alias("payload"))).alias("input"))
    quoted = F.when(F.coalesce("quality", F.lit(0)) == 1, '"long"').otherwise('"short"')
    gold = [("/flows/size/result", quoted, "exact", False, None), ("/flows/detail/result/kind", F.lit('"even"'), "exact", False, None), ("/flows/detail/steps/mark/result/none", F.lit("null"), "exact", True, None), ("/flows/detail/result/parts", F.lit("[0,0]"), "sum_below_3", False, "/r")]
    each = F.array(*(F.struct(F.lit(k).alias("check_ordinal"), F.lit(p).alias("path"), e.alias("expected"), F.lit(c).alias("comparison"), F.lit(a).alias("absent_as_null"), F.lit(x).cast("string").alias("each")) for k, (p, e, c, a, x) in enumerate(gold)))
    return cases, d.select("case_id", F.explode(each).alias("e")).select("case_id", "e.*"), Workflow(flows, "size")


def below_3(actual, expected):
    return F.aggregate(F.from_json(actual, "array<int>"), F.lit(0), lambda a, x: a + x) < 3


def _suite_sql(limit: int = 500, name: str = "") -> str:
    return f"""d{name} AS (SELECT doc_id AS case_id, lang, coalesce(n_chars, 0) AS n, coalesce(quality, 0) AS quality FROM documents LEFT JOIN labels USING (doc_id)),
 r{name} AS (SELECT *, CASE WHEN n % 50 = 7 THEN 'failed' WHEN n < 100 THEN 'needs_review' ELSE 'completed' END AS status, n % 50 <> 7 AND n >= {limit} AS detail FROM d{name}),
 c{name} AS (SELECT r{name}.*, k, CASE k WHEN 0 THEN CASE WHEN status = 'failed' THEN 'error' WHEN (n >= {limit}) = (quality = 1) THEN 'passed' ELSE 'failed' END
   WHEN 1 THEN CASE WHEN NOT detail THEN 'missing' WHEN n % 2 = 0 THEN 'passed' ELSE 'failed' END WHEN 2 THEN CASE WHEN detail THEN 'passed' ELSE 'missing' END
   ELSE CASE WHEN NOT detail THEN 'missing' WHEN n % 3 + n % 5 < 3 THEN 'passed' ELSE 'failed' END END AS outcome FROM r{name} CROSS JOIN range(4) t(k))"""


_SUITE_SQL = _suite_sql()


@query(
    f"""WITH {_SUITE_SQL}, a AS (SELECT lang, case_id, bool_and(outcome = 'passed') AS ok FROM c GROUP BY ALL), p AS (SELECT lang, count(*) FILTER (ok) / count(*) AS case_pass_rate FROM a GROUP BY lang),
    x AS (SELECT lang, 2 * count(*) AS total, {', '.join(f"2 * count(*) FILTER (outcome = '{o}') AS {o}" for o in ("passed", "failed", "missing", "error"))}, count(*) FILTER (outcome = 'passed') / count(*) AS pass_rate FROM c GROUP BY lang),
    y AS (SELECT lang, 2 * count(*) AS runs, 2 * count(*) FILTER (status = 'needs_review') AS needs_review, count(*) FILTER (status = 'failed') / count(*) AS failure_rate, count(*) AS source_cases FROM r GROUP BY lang)
    SELECT x.*, p.case_pass_rate, y.runs, y.needs_review, y.failure_rate, y.source_cases FROM x JOIN p ON p.lang IS NOT DISTINCT FROM x.lang JOIN y ON y.lang IS NOT DISTINCT FROM x.lang"""
)
def suite_report(spark, sf_dir):
    """A report of a suite that ran twice for each case, by language."""
    cases, gold, workflow = sized_suite(spark, sf_dir)
    r = st.run_suite(cases, gold, workflow, 2, scorers={"sum_below_3": below_3}).report("lang")
    return r.select("lang", "total", "passed", "failed", "missing", "error", "pass_rate", "case_pass_rate", "runs", "needs_review", "failure_rate", "source_cases")


@query(f"WITH {_SUITE_SQL} SELECT case_id, CAST(k AS INTEGER) AS check_ordinal, outcome, CASE WHEN k = 0 THEN '/flows/size' WHEN detail THEN CASE WHEN k = 2 THEN '/flows/detail/steps/mark' ELSE '/flows/detail' END END AS owner_path FROM c")
def suite_checks(spark, sf_dir):
    """Every check of a suite that ran, with the record that it is about."""
    cases, gold, workflow = sized_suite(spark, sf_dir)
    return st.run_suite(cases, gold, workflow, scorers={"sum_below_3": below_3}).checks.select("case_id", "check_ordinal", "outcome", "owner_path")


# journals


@query(
    """WITH e AS (SELECT 'c' || user_id % 200 AS case_id, 1 + CAST(event_id % 2 AS INTEGER) AS repetition, event_id, value FROM events WHERE event_type <> 'click')
    SELECT case_id, repetition, event_id AS seconds, '{"value":' || CAST(event_id % 1000 AS VARCHAR) || '}' AS result FROM e QUALIFY row_number() OVER (PARTITION BY case_id, repetition ORDER BY event_id DESC) = 1"""
)
def journal_lines(spark, sf_dir):
    """A journal of JSON lines in many files, two suites in it: of each case and repetition, the line that comes last."""
    e = table(spark, sf_dir, "events")
    suite = F.when(F.col("event_type") == "click", "other").otherwise("own")
    head = F.concat(F.lit('{"kind":"attempt","identity":{"suite":"'), suite, F.lit('","n":1},"case_id":"c'), F.col("user_id") % 200, F.lit('","repetition":'), 1 + F.col("event_id") % 2)
    text = F.concat(head, F.lit(',"input":"ä","seconds":'), "event_id", F.lit(',"result":{"value":'), F.col("event_id") % 1000, F.lit("}}"))
    path = shared_path(spark, "journal")
    e.select(text.alias("value"), "event_id").repartitionByRange(6, "event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    return read_lines(spark, path, "own", '{"n": 1, "suite": "own"}').select("case_id", "repetition", F.col("seconds").cast("long").alias("seconds"), "result")


# routes of many workflows

_ROUTES_SQL = """o AS (SELECT o_custkey, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
 e AS (SELECT 'w' || o_custkey AS workflow, 'f' || rn // 6 AS flow, CAST(rn % 6 AS INTEGER) AS position, o_custkey AS c, k,
  CASE WHEN rn % 6 = 5 OR rn = n - 1 THEN NULL WHEN k % 3 = 0 THEN ['equals', 'in', 'not_equals', 'not_in'][1 + (k // 3) % 4] ELSE ['gt', 'gte', 'lt', 'lte', 'equals'][1 + (k // 3) % 5] END AS operator,
  CASE WHEN k % 3 = 0 THEN '/payload/kind' ELSE '/payload/n' END AS pointer, k // 7 % 6 AS a, k // 11 % 6 AS b FROM o)"""


def _routes(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries of routes (six orders of a customer each), on a pointer with some texts and on one with numbers from 1 to 4."""
    by = Window.partitionBy("o_custkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("k"), (F.row_number().over(by.orderBy("o_orderkey")) - 1).alias("rn"), F.count(F.lit(1)).over(by).alias("n"))
    k, third = F.col("k"), F.floor(F.col("k") / 3).cast("int")
    pick = lambda names, at: F.get(F.array(*map(F.lit, names)), at.cast("int"))
    operator = F.when((F.col("rn") % 6 == 5) | (F.col("rn") == F.col("n") - 1), None).when(k % 3 == 0, pick(["equals", "in", "not_equals", "not_in"], third % 4)).otherwise(pick([*rk.ORDER, "equals"], third % 5))
    a, b = (F.floor(k / d) % 6 for d in (7, 11))
    one, two = (F.when(k % 3 == 0, F.concat(F.lit('"t'), x, F.lit('"'))).otherwise(x.cast("string")) for x in (a, b))
    entries = o.select(F.concat(F.lit("w"), "o_custkey").alias("workflow"), F.concat(F.lit("f"), F.floor(F.col("rn") / 6)).alias("flow"), (F.col("rn") % 6).cast("int").alias("position"), F.when(k % 3 == 0, "/payload/kind").otherwise("/payload/n").alias("pointer"), operator.alias("operator"), F.when(operator.isin("in", "not_in"), F.array(one, two)).otherwise(F.array(one)).alias("operands"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("w"), "c_custkey").alias("workflow"), "c_custkey")
    values = c.where("c_custkey % 5 > 0").select("workflow", F.lit("/payload/kind").alias("pointer"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("c_custkey") % 5)).alias("v")).select("workflow", "pointer", F.concat(F.lit('"t'), "v", F.lit('"')).alias("value"))
    ranges = c.where("c_custkey % 4 > 0").select("workflow", F.lit("/payload/n").alias("pointer"), F.lit(1).alias("low"), F.lit(4).alias("high"))
    return entries, values, ranges


@query(
    f"""WITH {_ROUTES_SQL},
    dom AS (SELECT e.workflow, flow, position, operator, pointer, a, b, CASE WHEN x = -1 THEN NULL ELSE x / 2 END AS v FROM e CROSS JOIN range(-1, 9) t(x)
      WHERE operator IS NOT NULL AND CASE WHEN pointer = '/payload/kind' THEN c % 5 > 0 AND (x = -1 OR x % 2 = 0 AND x / 2 <= c % 5) ELSE c % 4 > 0 AND (x = -1 OR x BETWEEN 2 AND 8) END),
    m AS (SELECT *, CASE operator WHEN 'equals' THEN coalesce(v = a, false) WHEN 'in' THEN coalesce(v IN (a, b), false) WHEN 'not_equals' THEN coalesce(v <> a, true) WHEN 'not_in' THEN coalesce(v NOT IN (a, b), true)
      WHEN 'gt' THEN coalesce(v > a, false) WHEN 'gte' THEN coalesce(v >= a, false) WHEN 'lt' THEN coalesce(v < a, false) ELSE coalesce(v <= a, false) END AS fits FROM dom),
    f AS (SELECT *, min(CASE WHEN fits THEN position END) OVER (PARTITION BY workflow, flow, pointer, v) AS first FROM m),
    g AS (SELECT workflow, flow, position, bool_and(fits) FILTER (v IS NOT NULL) AS every, bool_or(fits) FILTER (v IS NOT NULL) AS one, bool_and(fits) AS always, count(*) FILTER (fits AND first = position) AS own FROM f GROUP BY ALL),
    h AS (SELECT e.workflow, e.flow, e.position, every, one, own, min(CASE WHEN always THEN e.position END) OVER (PARTITION BY e.workflow, e.flow) AS decided FROM e LEFT JOIN g ON g.workflow = e.workflow AND g.flow = e.flow AND g.position = e.position)
    SELECT workflow, flow, position, 'condition_always_true' AS problem FROM h WHERE every UNION ALL SELECT workflow, flow, position, 'condition_always_false' FROM h WHERE NOT one
    UNION ALL SELECT workflow, flow, position, 'route_unreachable_entry' FROM h WHERE coalesce(position > decided, false) OR coalesce(own = 0, false)"""
)
def route_problems(spark, sf_dir):
    """Conditions and entries of routes that no value reaches; in SQL: all halves of the numbers, one by one."""
    return rk.route_problems(*_routes(spark, sf_dir))


@query(
    """WITH c AS (SELECT DISTINCT 'w' || o_custkey AS workflow, o_custkey AS k, 't' || o_orderkey % 6 AS key FROM orders), v AS (SELECT 'w' || c_custkey AS workflow, 't' || x AS key FROM customer CROSS JOIN range(5) t(x) WHERE c_custkey % 5 > 0 AND x <= c_custkey % 5)
    SELECT workflow, 'f' AS flow, key, 'unmatched_case' AS problem FROM c WHERE k % 5 > 0 AND (workflow, key) NOT IN (SELECT workflow, key FROM v)
    UNION ALL SELECT workflow, 'f', key, 'uncovered_value' FROM v WHERE workflow IN (SELECT workflow FROM c) AND (workflow, key) NOT IN (SELECT workflow, key FROM c)
    UNION ALL SELECT DISTINCT workflow, 'f', NULL, 'case_on_unknown_type' FROM c WHERE k % 5 = 0"""
)
def case_problems(spark, sf_dir):
    """Cases that cannot match, and values without a case."""
    cases = table(spark, sf_dir, "orders").select(F.concat(F.lit("w"), "o_custkey").alias("workflow"), F.lit("f").alias("flow"), F.lit("/payload/kind").alias("pointer"), F.concat(F.lit("t"), F.col("o_orderkey") % 6).alias("key"))
    return rk.case_problems(cases, _routes(spark, sf_dir)[1])


@query(
    f"""WITH {_suite_sql()}, {_suite_sql(900, "2")}, rank(name, k) AS (VALUES ('error', 0), ('missing', 0), ('skipped', 0), ('failed', 1), ('passed', 2), ('needs_review', 1), ('completed', 2)),
    m AS (SELECT a.case_id, max(y.k - x.k) AS up, min(y.k - x.k) AS down, count(*) FILTER (a.outcome = 'passed') AS before, count(*) FILTER (b.outcome = 'passed') AS after FROM c a JOIN c2 b ON a.case_id = b.case_id AND a.k = b.k JOIN rank x ON x.name = a.outcome JOIN rank y ON y.name = b.outcome GROUP BY 1),
    t AS (SELECT CASE WHEN up > 0 AND down < 0 THEN 'mixed' WHEN up > 0 THEN 'improved' WHEN down < 0 THEN 'regressed' ELSE 'unchanged' END AS change, before, after FROM m)
    SELECT {', '.join(f"2 * count(*) FILTER (change = '{x}') AS {x}" for x in ("improved", "regressed", "mixed", "unchanged"))}, sum(before) / (4 * count(*)) AS before_pass_rate, sum(after) / (4 * count(*)) AS after_pass_rate,
    (SELECT count(*) FILTER (status = 'failed') / count(*) FROM r) AS before_failure_rate, (SELECT count(*) FILTER (status = 'needs_review') / count(*) FROM r2) AS after_review_rate FROM t"""
)
def saved_comparison(spark, sf_dir):
    """Two evaluations of a suite with different workflows, saved and compared from their files."""
    paths = []
    for limit in (500, 900):
        cases, gold, workflow = sized_suite(spark, sf_dir, limit)
        paths.append(shared_path(spark, "evaluation"))
        rp.save(st.run_suite(cases, gold, workflow, 2, scorers={"sum_below_3": below_3}), paths[-1], 2)
    totals = rp.compare_saved(spark, *paths)[1]
    return totals.select("improved", "regressed", "mixed", "unchanged", "before_pass_rate", "after_pass_rate", "before_failure_rate", "after_review_rate")


@query(
    """WITH d AS (SELECT doc_id, coalesce(n_chars, 0) AS n FROM documents) SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN '{"label":"' || CASE WHEN n >= 500 THEN 'long' ELSE 'short' END || '","n":' || n || '}' END AS input,
    CASE WHEN n % 50 = 7 THEN 'failed' WHEN n < 100 THEN 'needs_review' ELSE 'completed' END AS status, CASE WHEN n % 50 <> 7 THEN CASE WHEN n >= 500 THEN 'long' ELSE 'short' END END AS result FROM d"""
)
def flow_alone(spark, sf_dir):
    """The input that a later flow would get, given authored results for some rows, and runs of one flow by itself."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n"))
    _, _, workflow = sized_suite(spark, sf_dir)
    later = Flow("later", [], input={"n": {"pointer": "/payload/n"}, "label": {"pointer": "/flows/size/result"}})
    whole = Workflow([Flow("size", workflow.flows[0].steps, "later", output=workflow.flows[0].output), later], "size")
    authored = F.when(F.col("doc_id") % 3 > 0, parse(F.when(F.col("n") >= 500, '"long"').otherwise('"short"')))
    e = d.select(F.col("doc_id").alias("run_id"), F.to_variant_object(F.struct("n")).alias("payload"), F.lit(None).cast("variant").alias("metadata"))
    runs = run_flow(whole, "size", e).select(F.col("run_id").alias("doc_id"), "status", F.when(F.col("status") != "failed", text_of(F.col("payload"))).alias("result"))
    given = d.select("doc_id", F.to_json(flow_input(whole, "later", F.to_variant_object(F.struct("n")), F.lit(None).cast("variant"), {"size": authored})).alias("input"))
    return given.join(runs, "doc_id")


# oracles of amounts and spans


@query(
    f"""WITH r AS (SELECT l_returnflag, l_suppkey % 10 <> 0 OR l_returnflag = 'R' AS whole, l_linenumber % 4 = 0 AS none, {_COST_SQL} AS micro FROM lineitem)
    SELECT l_returnflag, whole, count(*) FILTER (none OR micro IS NOT NULL) AS known, count(*) FILTER (NOT none AND micro IS NULL) AS unknown,
    CASE WHEN count(*) = count(*) FILTER (none OR micro IS NOT NULL) THEN CAST(round_even(CAST(sum(CASE WHEN none THEN 0 ELSE micro END) AS DOUBLE), 0) AS BIGINT) END AS amount_micro FROM r GROUP BY ALL"""
)
def cost_totals(spark, sf_dir):
    """Amounts of groups in which all requests have a price, or cost nothing, and of groups in which some have none."""
    x = table(spark, sf_dir, "lineitem")
    known = F.col("l_suppkey") % 10 != 0
    x = x.withColumns({"amount": request_cost(_PRICES, F.col("l_partkey") * 100, F.col("l_suppkey"), F.when(known, F.col("l_partkey")), F.lit(None)), "currency": F.lit("USD"), "requests": F.when(F.col("l_linenumber") % 4 == 0, 0).otherwise(1), "whole": known | (F.col("l_returnflag") == "R")})
    return sm.cost_summary(x, "l_returnflag", "whole").select("l_returnflag", "whole", "known", "unknown", (F.col("amount") * 1_000_000).cast("long").alias("amount_micro"))


@query(
    """WITH d AS (SELECT doc_id, text, length(text) // 2 AS p, length(text) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id,
    instr(substr(text, greatest(p - 1, 0) + 1, p + 2 - greatest(p - 1, 0)), 'th') > 0 AS covers, instr(substr(text, greatest(p - 1, p) + 1, p + 2 - p), 'th') > 0 AS allowed FROM d"""
)
def spans_required(spark, sf_dir):
    """Texts in whose middle a candidate stands: over the required character, and not before the allowed range."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").withColumn("p", F.floor(F.length("text") / 2).cast("int"))
    p, n = F.col("p"), F.length("text")
    return d.select("doc_id", cmp.in_span(F.lit("th"), F.col("text"), (p, p + 1), (F.lit(0), n)).alias("covers"), cmp.in_span(F.lit("th"), F.col("text"), (p, p + 1), (p, n)).alias("allowed"))


# decision steps

_LANE_SQL = """WITH o AS (SELECT o_orderkey, o_totalprice > 150000 AS urgent, CASE WHEN o_orderkey % 5 = 0 THEN 'not_answerable' WHEN o_orderkey % 7 = 0 THEN 'undetermined' ELSE 'answerable' END AS status,
    o_orderkey % 11 = 0 AS odd, o_orderkey % 13 = 0 AS silent, o_orderkey % 17 = 0 AS torn, CASE WHEN o_orderkey % 11 = 0 THEN 'none' WHEN o_orderstatus = 'F' THEN 'fast' ELSE 'slow' END AS lane FROM orders)"""


def _answers(spark, sf_dir, both: bool) -> DataFrame:
    """Answers to one question on orders, or to two, of which the second comes first; some are torn, wrong or missing."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    status = F.when(k % 5 == 0, "not_answerable").when(k % 7 == 0, "undetermined").otherwise("answerable")
    issue = F.when(status == "not_answerable", F.array(F.lit("no_supported_answer"))).when(status == "undetermined", F.array(F.lit("conflicting_information"))).otherwise(F.array().cast("array<string>"))
    pick = F.when(k % 11 == 0, "none").when(F.col("o_orderstatus") == "F", "fast").otherwise("slow")
    item = lambda q, s, i, a: F.struct(F.lit(q).alias("question"), s.alias("status"), i.alias("issues"), a.alias("answer"))
    lane = item("lane", status, issue, F.when(status == "answerable", F.array(pick)).otherwise(F.array().cast("array<string>")))
    urgent = item("urgent", F.lit("answerable"), F.array().cast("array<string>"), F.array((F.col("o_totalprice") > 150000).cast("string")))
    listed = F.array(lane, F.when(k % 13 != 0, urgent)) if both else F.array(lane)
    return o.select("o_orderkey", F.when(k % 17 == 0, "{").otherwise(F.to_json(F.struct(F.array_compact(listed).alias("results")))).alias("output"))


@query(
    f"""{_LANE_SQL}, p AS (SELECT *, CASE WHEN torn THEN 'malformed' ELSE concat_ws(',', CASE WHEN silent THEN 'missing:urgent' END, CASE WHEN status = 'answerable' AND odd THEN 'lane:unknown-option' END) END AS problems FROM o)
    SELECT o_orderkey, problems, CASE WHEN problems = '' THEN 'urgent,lane' END AS answered, CASE WHEN problems = '' THEN CAST(urgent AS VARCHAR) END AS urgent,
    CASE WHEN problems = '' THEN status = 'answerable' END AS answerable, CASE WHEN problems = '' THEN CASE status WHEN 'not_answerable' THEN 'no_supported_answer' ELSE '' END END AS issues FROM p"""
)
def decision_results(spark, sf_dir):
    """Answers to two questions, in the order in which they were asked, or what is wrong with them."""
    questions = ds.asked("triage", "", ["note"], [ds.Question("predicate", id="urgent", prompt="Is it urgent?", sources=("note",)), ds.Question("choice", ("fast", "slow"), "lane", "Which lane?", ("note",))])
    x = _answers(spark, sf_dir, True).withColumn("d", ds.decision_result(F.col("output"), questions))
    return x.select("o_orderkey", F.array_join("d.problems", ",").alias("problems"), F.array_join("d.results.question", ",").alias("answered"), F.col("d.results")[0].answer[0].alias("urgent"), F.col("d.answerable").alias("answerable"), F.array_join("d.issues", ",").alias("issues"))


@query(
    f"""{_LANE_SQL}, p AS (SELECT *, torn OR status = 'answerable' AND odd AS bad, o_orderkey % 3 = 0 AS asks FROM o), q AS (SELECT *, NOT bad AND status = 'not_answerable' AS desk FROM p)
    SELECT o_orderkey, CASE WHEN bad THEN 'failed' WHEN status = 'answerable' OR desk AND NOT asks THEN 'completed' ELSE 'needs_review' END AS status, CASE WHEN bad THEN 'invalid_output' END AS error,
    CASE WHEN desk THEN 3 WHEN bad THEN 1 ELSE 2 END AS transitions, CASE WHEN NOT bad THEN CASE status WHEN 'answerable' THEN lane WHEN 'not_answerable' THEN 'slow' END END AS selection,
    CASE WHEN desk AND NOT asks THEN 'seen' END AS desk FROM q"""
)
def decision_workflow(spark, sf_dir):
    """A workflow whose reviews lead where their issues say, as flows inherit it; a desk that may ask a person goes on without a result."""
    (lane,) = ds.asked("lane", "Which lane?", ["note"], ds.Question("choice", ("fast", "slow")))
    ask = Step("lane", lambda i: ds.decided(ds.decision_result(text_of(i["output"]), [lane], True, "slow", ["no_supported_answer"])), {"output": {"pointer": "/payload/output"}})
    desk = Step("look", lambda i: Outcome(F.when(number_of(i["k"]) % 3 != 0, parse(F.lit('"seen"'))), F.when(number_of(i["k"]) % 3 == 0, "needs_review").otherwise("completed")), {"k": {"pointer": "/payload/o_orderkey"}})
    flows = [Flow("triage", [ask], output={"pointer": "/steps/lane/result"}), Flow("desk", [desk], on_review="needs_review", output={"pointer": "/steps/look/result"})]
    whole = Workflow(flows, "triage", on_review={"no_supported_answer": "desk", "default": "needs_review"})
    x = _answers(spark, sf_dir, False)
    runs = whole.run(x.select(F.col("o_orderkey").alias("run_id"), F.to_variant_object(F.struct("o_orderkey", "output")).alias("payload"), F.lit(None).cast("variant").alias("metadata")))
    return runs.select(F.col("run_id").alias("o_orderkey"), "status", "error", F.size("transitions").alias("transitions"), F.try_variant_get("triage.result", "$.selection", "string").alias("selection"), F.try_variant_get("desk.result", "$", "string").alias("desk"))


@query(
    r"""SELECT doc_id, CASE WHEN regexp_matches(text, '\S') THEN text END AS text, CASE WHEN regexp_matches(text, '\S') THEN '{"lang":' || coalesce('"' || lang || '"', 'null') || ',"n":' || coalesce(n_chars, 0) || '}' END AS facts,
    CASE WHEN regexp_matches(text, '\S') THEN 'tone: Is it kind? (text,facts)' END AS asked FROM documents"""
)
def decision_inputs(spark, sf_dir):
    """What a question on a text and on a JSON value takes along; texts that are blank or missing are no input."""
    d = table(spark, sf_dir, "documents").withColumn("text", F.to_variant_object(F.struct("text")))
    facts = F.to_variant_object(F.struct(F.coalesce("n_chars", F.lit(0)).alias("n"), "lang"))
    questions = ds.asked("tone", "Is it kind?", ["text", "facts"], ds.Question("predicate"))
    x = d.select("doc_id", ds.decision_input(questions, {"text": member(F.col("text"), "text"), "facts": facts}, {"facts"}).alias("i"))
    q = F.col("i.questions")[0]
    return x.select("doc_id", F.col("i.sources")[0].text.alias("text"), F.col("i.sources")[1].text.alias("facts"), F.when(F.col("i").isNotNull(), F.concat(q.id, F.lit(": "), q.prompt, F.lit(" ("), F.array_join(q.sources, ","), F.lit(")"))).alias("asked"))
