"""Queries by name, over whole tables, and the SQL that they are compared with."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import comparisons as cmp
from .functions.conditions import holds, trace
from .functions.schemas import valid, violations
from .functions.usage import Price, Pricing, failure_code, reported, request_cost, retryable
from .functions.values import bind, bind_all, literal, number_of, parse, project, render, text_of
from .operators import checks as ck
from .operators import compare as cp
from .operators import decisions as dc
from .operators import evaluate as ev
from .operators import metrics as mt
from .operators import summaries as sm
from .plans.collections import ledger, run_collection
from .plans.workflow import Cases, Flow, Outcome, Repeat, Step, Workflow
from .sources.envelopes import decode
from .sources.journal import latest, recorded_cases, replay, to_run

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# values and bindings


@query(
    """SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS found, CAST(NULL AS BIGINT) AS absent, CAST(7 AS BIGINT) AS by_default,
    CAST(props->>'$.k' AS BIGINT) AS first, '{"a":' || (props->>'$.k') || ',"b":"x"}' AS fields FROM events"""
)
def bindings(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("doc", parse(F.col("props")))
    c = {"/payload": F.col("doc")}
    k = {"pointer": "/payload/k"}
    long_ = lambda b: number_of(bind(c, b)).cast("long")
    return e.select(
        "event_id", long_(k).alias("found"), long_({"pointer": "/payload/none"}).alias("absent"), long_({"pointer": "/payload/none", "default": 7}).alias("by_default"),
        long_({"first_of": ["/payload/none", "/payload/k"]}).alias("first"), F.to_json(bind(c, {"fields": {"a": k, "b": {"literal": "x"}}})).alias("fields"),
    )


def _labelled(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.withColumn("doc", F.to_variant_object(F.struct("lang", "source", "n_chars", "quality", F.array("lang", "source").alias("tags"))))


_CONDITIONS = {
    "present": ({"pointer": "/d/quality", "present": True}, "quality IS NOT NULL"),
    "is_empty": ({"pointer": "/d/quality", "empty": True}, "quality IS NULL"),
    "equals_null": ({"pointer": "/d/quality", "equals": None}, "quality IS NULL"),
    "equals_one": ({"pointer": "/d/quality", "equals": 1.0}, "coalesce(quality = 1, false)"),
    "not_equals": ({"pointer": "/d/quality", "not_equals": 1}, "coalesce(quality <> 1, true)"),
    "one_in": ({"pointer": "/d/quality", "in": [0, None]}, "quality IS NULL OR quality = 0"),
    "not_in": ({"pointer": "/d/lang", "not_in": ["en", "de"]}, "coalesce(lang NOT IN ('en', 'de'), true)"),
    "gt": ({"pointer": "/d/n_chars", "gt": 500}, "coalesce(n_chars > 500, false)"),
    "gte": ({"pointer": "/d/n_chars", "gte": 500}, "coalesce(n_chars >= 500, false)"),
    "lt": ({"pointer": "/d/n_chars", "lt": 500}, "coalesce(n_chars < 500, false)"),
    "lte_text": ({"pointer": "/d/lang", "lte": 5}, "false"),
    "not_gt_absent": ({"not": {"pointer": "/d/quality", "gt": 0}}, "NOT coalesce(quality > 0, false)"),
    "matches": ({"pointer": "/d/source", "matches": "src[0-9]"}, "coalesce(regexp_full_match(source, 'src[0-9]'), false)"),
    "length_items": ({"pointer": "/d/tags", "length": {"equals": 2}}, "true"),
    "length_text": ({"pointer": "/d/source", "length": {"gt": 4, "lte": 5}}, "coalesce(length(source) = 5, false)"),
    "every": ({"all": [{"pointer": "/d/quality", "equals": 1}, {"pointer": "/d/lang", "equals": "en"}]}, "coalesce(quality = 1 AND lang = 'en', false)"),
    "either": ({"any": [{"pointer": "/d/quality", "equals": 0}, {"first_of": ["/d/none", "/d/lang"], "in": ["fr"]}]}, "coalesce(quality = 0, false) OR coalesce(lang = 'fr', false)"),
    "deep": ({"pointer": "/d/tags", "equals": ["en", "src1"]}, "coalesce(lang = 'en' AND source = 'src1', false)"),
}


@query(f"SELECT doc_id, {', '.join(f'{sql} AS {name}' for name, (_, sql) in _CONDITIONS.items())} FROM documents LEFT JOIN labels USING (doc_id)")
def conditions(spark, sf_dir):
    return _labelled(spark, sf_dir).select("doc_id", *(holds({"/d": F.col("doc")}, c).alias(name) for name, (c, _) in _CONDITIONS.items()))


@query(
    """WITH l AS (SELECT doc_id, coalesce(quality = 1, false) AS good, quality IS NOT NULL AS rated, length(text) > 1024 AS long FROM documents LEFT JOIN labels USING (doc_id))
    SELECT doc_id, concat_ws(';', CASE WHEN good THEN '/any/0/all/1 gt incompatible_type' END, CASE WHEN rated THEN '/any/1/all/0/not matches incompatible_type' END,
    CASE WHEN rated THEN '/any/2/all/0 length incompatible_type' END, CASE WHEN long THEN '/any/3 matches value_too_long' END) AS notes FROM l"""
)
def condition_trace(spark, sf_dir):
    """Notes of leaves in nested conditions; what a decided condition does not reach leaves none."""
    both = _labelled(spark, sf_dir).withColumn("whole", F.to_variant_object(F.struct("text")))
    ordered = {"all": [{"pointer": "/d/quality", "equals": 1}, {"pointer": "/d/lang", "gt": 3}]}
    unlike = {"not": {"first_of": ["/d/quality", "/d/none"], "matches": "[01]"}}
    sized = {"all": [{"pointer": "/d/quality", "length": {"gt": 0}}, {"pointer": "/d/lang", "lt": 3}]}
    c = {"any": [ordered, {"all": [unlike, {"pointer": "/d/none", "present": True}]}, sized, {"pointer": "/t/text", "matches": ".*"}]}
    notes = trace({"/d": F.col("doc"), "/t": F.col("whole")}, c)
    return both.select("doc_id", F.array_join(F.transform(notes, lambda n: F.concat_ws(" ", n.location, n.operator, n.reason)), ";").alias("notes"))


@query(
    """SELECT c_custkey, 'Dear "' || c_name || '", {{' || c_custkey || '}} of ' || '"' || c_mktsegment || '"' AS prompt,
    sha256('{"key":' || c_custkey || ',"segment":"' || c_mktsegment || '"}') AS fingerprint,
    trim(regexp_replace(lower(c_name || ' / ' || c_mktsegment), '[^a-z0-9]+', '_', 'g'), '_') AS category FROM customer"""
)
def prompts(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    v = {k: F.to_variant_object(F.struct(F.col(col).alias("x"))) for k, col in (("name", "c_name"), ("key", "c_custkey"), ("segment", "c_mktsegment"))}
    inputs = {k: F.try_variant_get(x, "$.x", "variant") for k, x in v.items()}
    text = F.concat(F.lit('{"segment": "'), F.col("c_mktsegment"), F.lit('", "key": '), F.col("c_custkey"), F.lit("}"))
    category = cmp.category_key(F.concat("c_name", F.lit(" / "), "c_mktsegment"))
    return c.select("c_custkey", render("Dear {{ name }}, {{{{{{ key }}}}}} of {{segment}}", inputs).alias("prompt"), cmp.fingerprint(text).alias("fingerprint"), category.alias("category"))


# comparisons and checks


@query(
    """SELECT d.doc_id, lower(d.lang) = lower(d.source) OR doc_id % 3 = 0 AS same_text, contains(lower(d.text), 'the') AS contains_text,
    CAST(n_chars AS VARCHAR) = CAST(length(text) AS VARCHAR) AS exact, doc_id % 4 < 2 AS same_set, d.lang IN ('en', 'fr') AS one_of,
    instr(substr(d.text, 2 + d.n_chars // 2), 'the') > 0 AS in_span FROM documents d"""
)
def comparisons(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    zero = F.lit(0)
    quoted = F.to_json(F.struct(F.col("lang").alias("x")))
    quoted = F.substring(quoted, F.lit(6), F.length(quoted) - 6)
    return d.select(
        "doc_id", cmp.same_text(F.col("lang"), F.when(F.col("doc_id") % 3 == 0, F.upper("lang")).otherwise(F.col("source"))).alias("same_text"), cmp.contains_text(F.col("text"), F.lit("THE")).alias("contains_text"),
        cmp.exact(F.col("n_chars").cast("string"), F.length("text").cast("string")).alias("exact"),
        cmp.same_set(F.concat(F.lit("[1, "), quoted, F.lit("]")), F.concat(F.lit("["), quoted, F.when(F.col("doc_id") % 4 < 2, ",1,1]").otherwise(",2,1]"))).alias("same_set"),
        cmp.one_of(quoted, F.lit('["en", "fr"]')).alias("one_of"),
        cmp.in_span(F.lit("the"), F.col("text"), (F.lit(1 << 30), zero), (F.floor(F.col("n_chars") / 2).cast("int") + 1, F.length("text"))).alias("in_span"),
    )


@query(
    """WITH RECURSIVE r AS (SELECT c_custkey // 24 AS run_id, c_custkey % 12 AS source, (c_custkey * 7 + c_custkey // 24) % 12 AS target,
    CASE WHEN c_custkey % 7 < 2 THEN 'requires' WHEN c_custkey % 7 = 2 THEN 'precedes' ELSE 'excludes' END AS kind FROM customer),
    e AS (SELECT DISTINCT run_id, kind, CASE kind WHEN 'requires' THEN target ELSE source END AS a, CASE kind WHEN 'requires' THEN source ELSE target END AS b FROM r WHERE kind <> 'excludes'),
    o AS (SELECT run_id, a, b FROM e UNION SELECT o.run_id, o.a, e.b FROM o JOIN e ON e.run_id = o.run_id AND e.a = o.b),
    q AS (SELECT run_id, a, b FROM e WHERE kind = 'requires' UNION SELECT q.run_id, q.a, e.b FROM q JOIN e ON e.run_id = q.run_id AND e.a = q.b AND e.kind = 'requires')
    SELECT run_id, source, target, kind,
    concat_ws(',', CASE WHEN source = target AND kind <> 'excludes' THEN 'self' END,
      CASE WHEN count(*) OVER (PARTITION BY run_id, kind, CASE kind WHEN 'excludes' THEN least(source, target) ELSE source END, CASE kind WHEN 'excludes' THEN greatest(source, target) ELSE target END) > 1 THEN 'duplicate' END,
      CASE WHEN kind <> 'excludes' AND EXISTS (SELECT 1 FROM o WHERE o.run_id = r.run_id AND a = source AND b = target) AND EXISTS (SELECT 1 FROM o WHERE o.run_id = r.run_id AND a = target AND b = source) THEN 'cycle' END,
      CASE WHEN kind = 'excludes' AND source <> target AND EXISTS (SELECT 1 FROM q WHERE q.run_id = r.run_id AND (a = source AND b = target OR a = target AND b = source)) THEN 'exclusive_dependency' END) AS problems FROM r"""
)
def relation_problems(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    kind = F.when(k % 7 < 2, "requires").when(k % 7 == 2, "precedes").otherwise("excludes")
    run = F.floor(k / 24)
    r = c.select(run.alias("run_id"), (k % 12).alias("source"), ((k * 7 + run) % 12).alias("target"), kind.alias("kind"))
    return dc.relation_problems(r).withColumn("problems", F.array_join("problems", ","))


_CHECKS_SQL = """SELECT doc_id AS case_id, 1 AS repetition, 0 AS check_ordinal, source, lang,
 CASE WHEN quality IS NULL THEN (CASE WHEN lang = 'en' THEN 'skipped' WHEN lang = 'de' THEN 'error' ELSE 'missing' END)
      WHEN (n_chars >= {limit}) = (quality = 1) THEN 'passed' ELSE 'failed' END AS outcome
 FROM documents LEFT JOIN labels USING (doc_id)"""


def _checks(spark, sf_dir, limit: int = 500) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    owner = F.when(F.col("lang") == "en", "skipped").when(F.col("lang") == "de", "failed").otherwise("completed")
    matched = (F.col("n_chars") >= limit) == (F.col("quality") == 1)
    found = ck.outcome(F.col("quality").isNotNull(), matched, owner, F.lit(False), F.lit(False))
    return d.select(F.col("doc_id").alias("case_id"), F.lit(1).alias("repetition"), F.lit(0).alias("check_ordinal"), "source", "lang", found.alias("outcome"))


@query(
    f"""WITH c AS ({_CHECKS_SQL.format(limit=500)}) SELECT lang, count(*) AS total,
    {', '.join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in ("passed", "failed", "missing", "skipped", "error"))},
    count(*) FILTER (outcome = 'passed') / count(*) AS pass_rate, count(*) FILTER (outcome IN ('passed', 'failed')) / count(*) AS coverage FROM c GROUP BY lang"""
)
def check_summary(spark, sf_dir):
    return ck.check_summary(_checks(spark, sf_dir), "lang")


@query(
    f"""WITH c AS ({_CHECKS_SQL.format(limit=500)}), a AS (SELECT lang, source, bool_and(outcome = 'passed') AS ok FROM c GROUP BY lang, source)
    SELECT lang, count(*) AS attempts, count(*) FILTER (ok) / count(*) AS case_pass_rate FROM a GROUP BY lang"""
)
def case_pass_rate(spark, sf_dir):
    return ck.case_pass_rate(_checks(spark, sf_dir), ["source"], "lang")


@query(
    """SELECT event_id, '/flows/' || event_type || '/steps/a/result/x' AS path,
    CASE WHEN event_id % 2 = 0 THEN '/flows/' || event_type || '/steps/a' ELSE '/flows/' || event_type END AS owner_path,
    CASE WHEN event_id % 2 = 0 THEN 'skipped' ELSE 'completed' END AS owner_status FROM events"""
)
def check_owners(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("/flows/"), "event_type").alias("flow"))
    records = e.select("event_id", F.col("flow").alias("path"), F.lit("completed").alias("status"))
    near = e.where("event_id % 2 = 0").select("event_id", F.concat("flow", F.lit("/steps/a")).alias("path"), F.lit("skipped").alias("status"))
    far = e.select("event_id", F.concat("flow", F.lit("/steps/ab")).alias("path"), F.lit("failed").alias("status"))
    return ck.owners(e.select("event_id", F.concat("flow", F.lit("/steps/a/result/x")).alias("path")), records.unionByName(near).unionByName(far), "event_id")


# summaries

_CODE_SQL = "CASE WHEN event_type = 'error' THEN CASE WHEN value < 20 THEN 'rate_limited' WHEN value < 60 THEN 'request_timeout' ELSE 'forbidden' END END"


@query(
    f"""WITH n AS (SELECT {_CODE_SQL} AS code, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1)
    SELECT code, n, CAST(row_number() OVER (ORDER BY n DESC, code) AS INTEGER) AS place FROM n WHERE code IS NOT NULL"""
)
def failures_by_code(spark, sf_dir):
    code = F.when(F.col("value") < 20, failure_code(F.lit(429))).when(F.col("value") < 60, failure_code(F.lit(504))).otherwise(failure_code(F.lit(403)))
    runs = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), code.alias("code"))
    return sm.failures_by_code(runs)


_SECONDS = "CASE WHEN user_id % 7 <> 0 THEN value END"
_LATENCY = "count({s}) AS count, count(*) FILTER ({s} IS NULL) AS unavailable, min({s}) AS min, median({s}) AS median, quantile_disc({s}, 0.95) AS p95, max({s}) AS max"


@query(f"WITH e AS (SELECT event_type, {_SECONDS} AS s FROM events) SELECT event_type, {_LATENCY.format(s='s')} FROM e GROUP BY event_type")
def latency_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("s", F.expr(_SECONDS))
    return sm.latency_summary(e, "s", "event_type")


@query(
    """WITH e AS (SELECT event_type, CASE WHEN event_id % 1000 <> 0 THEN user_id END AS tokens FROM events)
    SELECT event_type, count(tokens) AS tokens_observed, count(*) FILTER (tokens IS NULL) AS tokens_unknown, CAST(sum(tokens) AS BIGINT) AS tokens_known_total,
    CASE WHEN count(*) = count(tokens) THEN CAST(sum(tokens) AS BIGINT) END AS tokens_total FROM e GROUP BY event_type"""
)
def usage_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("tokens", F.when(F.col("event_id") % 1000 != 0, F.col("user_id")))
    return sm.usage_summary(e, ["tokens"], "event_type")


_PRICES = Pricing(Price(Decimal("3"), Decimal("15"), Decimal("0.3")), Price(Decimal("6"), Decimal("22.5"), Decimal("0.6")), 100_000)
_COST_SQL = """CASE WHEN l_suppkey % 10 <> 0 THEN CASE WHEN l_partkey * 100 > 100000
  THEN CAST(l_partkey * 99 * 6 + l_partkey * 0.6 + l_suppkey * 22.5 AS DECIMAL(38, 6)) ELSE CAST(l_partkey * 99 * 3 + l_partkey * 0.3 + l_suppkey * 15 AS DECIMAL(38, 6)) END END"""


@query(
    f"""WITH r AS (SELECT l_returnflag, {_COST_SQL} AS micro FROM lineitem)
    SELECT l_returnflag, count(micro) AS known, count(*) FILTER (micro IS NULL) AS unknown, CAST(NULL AS BIGINT) AS amount_micro, CAST(round(sum(micro)) AS BIGINT) AS known_micro, 'USD' AS currency FROM r GROUP BY l_returnflag"""
)
def cost_summary(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    cached = F.when(F.col("l_suppkey") % 10 != 0, F.col("l_partkey"))
    x = x.withColumns({"amount": request_cost(_PRICES, F.col("l_partkey") * 100, F.col("l_suppkey"), cached, F.lit(None)), "currency": F.lit("USD"), "requests": F.lit(1)})
    whole = sm.cost_summary(x, "l_returnflag")
    known = x.groupBy("l_returnflag").agg(F.round(F.sum("amount") * 1_000_000).cast("long").alias("known_micro"))
    return whole.join(known, "l_returnflag").select("l_returnflag", "known", "unknown", (F.col("amount") * 1_000_000).cast("long").alias("amount_micro"), "known_micro", "currency")


@query(
    f"""WITH a AS (SELECT DISTINCT user_id AS run_id FROM events), r AS (SELECT user_id AS run_id, event_type AS step, min(value) AS seconds FROM events GROUP BY ALL),
    w AS (SELECT run_id, step, r.seconds, r.run_id IS NOT NULL AS there FROM a CROSS JOIN (VALUES ('click'), ('error'), ('view')) s(step) LEFT JOIN r USING (run_id, step)),
    x AS (SELECT *, CASE WHEN NOT coalesce(seconds IS NOT NULL, false) THEN NULL WHEN step = 'error' THEN 'failed' WHEN seconds < 5 THEN 'needs_review' ELSE 'completed' END AS status FROM w)
    SELECT 'f' AS flow, step, count(status) AS invocations, count(*) FILTER (status IS NULL) AS no_record, count(*) FILTER (status = 'completed') AS completed,
    count(*) FILTER (status = 'needs_review') AS needs_review, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped,
    CASE WHEN count(status) > 0 THEN count(*) FILTER (status = 'needs_review') / count(status) END AS fallback_rate, {_LATENCY.format(s='seconds')} FROM x GROUP BY step"""
)
def step_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    r = e.groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("step")).agg(F.min("value").alias("seconds"))
    status = F.when(F.col("step") == "error", "failed").when(F.col("seconds") < 5, "needs_review").otherwise("completed")
    r = r.withColumns({"flow": F.lit("f"), "status": status, "origin": F.when(status == "needs_review", "fallback")})
    return sm.step_summary(e.select(F.col("user_id").alias("run_id")).distinct(), r, [("f", "click"), ("f", "error"), ("f", "view")])


@query("SELECT event_type, CAST(CASE WHEN value <= 1 THEN 1 WHEN value <= 10 THEN 2 WHEN value <= 50 THEN 3 WHEN value > 50 THEN 4 END AS INTEGER) AS bucket, count(*) AS n FROM events GROUP BY ALL")
def duration_histogram(spark, sf_dir):
    return sm.duration_histogram(table(spark, sf_dir, "events"), "value", [1.0, 10.0, 50.0], "event_type")


@query("SELECT true AS present, false AS member, props->>'$.k' AS key, count(*) AS n, min(event_id) AS group_ordinal FROM events GROUP BY ALL")
def group_scalar(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("v", bind({"": parse(F.col("props"))}, {"pointer": "/k"}))
    g = sm.grouped(e, F.col("v"), F.to_json("v"), "event_id")
    return sm.group_report(g, "event_id", F.count(F.lit(1)).alias("n"))


@query(
    """WITH c AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL)
    SELECT true AS present, true AS member, '"' || role || '"' AS key, count(*) AS n, min(conv_id) AS group_ordinal FROM c WHERE role IS NOT NULL GROUP BY role"""
)
def group_member(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.collect_list("role")).alias("roles"))
    g = sm.grouped(c, parse(F.col("roles")), F.col("roles"), "conv_id")
    return sm.group_report(g, "conv_id", F.count(F.lit(1)).alias("n"))


# metrics

_LABELS = ["good", "bad"]
_OBSERVED_SQL = """SELECT CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END AS gold, lang,
 CASE WHEN n_chars >= 900 THEN 'good' WHEN n_chars >= 100 THEN 'bad' WHEN n_chars >= 50 THEN 'other' END AS pred,
 CASE WHEN quality IS NULL THEN 'excluded' WHEN lang = 'es' THEN 'skipped' WHEN lang = 'fr' AND n_chars < 300 THEN 'error' WHEN n_chars IS NULL OR n_chars < 20 THEN 'missing'
  WHEN n_chars < 50 THEN 'abstained' WHEN n_chars < 100 THEN 'invalid' ELSE 'observed' END AS state FROM documents LEFT JOIN labels USING (doc_id)"""


def _observations(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n = F.col("n_chars")
    d = d.withColumns({"gold": F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad"), "pred": F.when(n >= 900, "good").when(n >= 100, "bad").when(n >= 50, "other")})
    owner = F.when(F.col("lang") == "es", "skipped").when((F.col("lang") == "fr") & (n < 300), "failed").otherwise("completed")
    return d.select("gold", "lang", "pred", mt.observed_state(F.col("gold"), F.col("pred"), n >= 20, owner, _LABELS).alias("state"))


@query(
    f"""WITH o AS ({_OBSERVED_SQL}), l AS (SELECT * FROM (VALUES (0, 'good'), (1, 'bad')) t(no, label))
    SELECT CAST(g.no AS INTEGER) AS gold_no, g.label AS gold, CAST(p.no AS INTEGER) AS pred_no, p.label AS pred, count(o.gold) AS n
    FROM l g CROSS JOIN l p LEFT JOIN o ON o.gold = g.label AND o.pred = p.label AND o.state = 'observed' GROUP BY ALL"""
)
def confusion_matrix(spark, sf_dir):
    return mt.confusion_matrix(_observations(spark, sf_dir), _LABELS)


@query(
    f"""WITH o AS ({_OBSERVED_SQL}) SELECT lang, count(*) FILTER (state <> 'excluded') AS support, {', '.join(f"count(*) FILTER (state = '{s}') AS {s}" for s in mt.STATES)},
    count(*) FILTER (state = 'observed' AND gold = pred) AS correct, count(*) FILTER (state = 'observed' AND gold = pred) / nullif(count(*) FILTER (state <> 'excluded'), 0) AS accuracy,
    count(*) FILTER (state = 'observed') / nullif(count(*) FILTER (state <> 'excluded'), 0) AS coverage FROM o GROUP BY lang"""
)
def metric_summary(spark, sf_dir):
    return mt.metric_summary(_observations(spark, sf_dir), "lang")


_COUNTS_SQL = f"""o AS ({_OBSERVED_SQL}), c AS (SELECT CAST(no AS INTEGER) AS label_no, label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (gold <> label AND pred = label) AS fp,
 count(*) FILTER (gold = label AND pred <> label) AS fn, count(*) FILTER (gold <> label AND pred <> label) AS tn
 FROM (SELECT * FROM o WHERE state = 'observed') o CROSS JOIN (VALUES (0, 'good'), (1, 'bad')) t(no, label) GROUP BY no, label)"""
_RATES_SQL = "tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1"


@query(f"WITH {_COUNTS_SQL} SELECT *, {_RATES_SQL} FROM c")
def label_rates(spark, sf_dir):
    return mt.rates(mt.label_counts(_observations(spark, sf_dir), _LABELS))


_MEANS_SQL = ", ".join(f"CASE WHEN count(*) = count({c}) THEN sum({c}) / count({c}) END" for c in ("precision", "recall", "f1"))


@query(
    f"""WITH {_COUNTS_SQL}, p AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c), r AS (SELECT {_RATES_SQL} FROM c)
    SELECT 'micro' AS average, {_RATES_SQL} FROM p UNION ALL SELECT 'macro', {_MEANS_SQL} FROM r"""
)
def micro_macro(spark, sf_dir):
    return mt.micro_macro(mt.label_counts(_observations(spark, sf_dir), _LABELS))


@query(
    """WITH c AS (SELECT conv_id, list(role) AS gold, list(role) FILTER (turn < 3) AS pred FROM conversations GROUP BY conv_id),
    x AS (SELECT label, no, list_contains(gold, label) AS g, coalesce(list_contains(pred, label), false) AS p FROM c CROSS JOIN (VALUES (0, 'user'), (1, 'assistant'), (2, 'system')) t(no, label))
    SELECT CAST(no AS INTEGER) AS label_no, label, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (NOT g AND NOT p) AS tn FROM x GROUP BY ALL"""
)
def multilabel_counts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("gold"), F.collect_set(F.when(F.col("turn") < 3, F.col("role"))).alias("pred"))
    return mt.label_counts(c.withColumn("state", F.lit("observed")), ["user", "assistant", "system"])


_FIELDS_SQL = """SELECT 'quality' AS field, CASE WHEN lang = 'es' THEN 'unavailable' WHEN quality IS NULL THEN (CASE WHEN n_chars < 300 THEN 'correct_null' ELSE 'hallucinated' END)
 WHEN n_chars < 300 THEN 'missed' WHEN (n_chars >= 900) = (quality = 1) THEN 'correct_value' ELSE 'wrong_value' END AS outcome FROM documents LEFT JOIN labels USING (doc_id)
 UNION ALL SELECT 'toxic', CASE WHEN lang = 'es' THEN 'unavailable' WHEN toxic IS NULL THEN 'hallucinated' WHEN toxic = 0 THEN 'correct_value' ELSE 'wrong_value' END FROM documents LEFT JOIN labels USING (doc_id)"""


def _fields(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    there, actual = F.col("lang") != "es", F.when(F.col("n_chars") >= 300, (F.col("n_chars") >= 900).cast("int"))
    q = mt.field_outcome(there, F.col("quality"), actual, actual == F.col("quality"))
    t = mt.field_outcome(there, F.col("toxic"), F.lit(0), F.col("toxic") == 0)
    return d.select(F.explode(F.array(F.struct(F.lit("quality").alias("field"), q.alias("outcome")), F.struct(F.lit("toxic").alias("field"), t.alias("outcome")))).alias("f")).select("f.*")


@query(
    f"""WITH f AS ({_FIELDS_SQL}) SELECT field, {', '.join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in mt.FIELD_OUTCOMES)}, count(*) AS support,
    count(*) FILTER (outcome IN ('correct_value', 'correct_null')) / count(*) AS accuracy FROM f GROUP BY ROLLUP (field)"""
)
def field_outcomes(spark, sf_dir):
    return mt.field_summary(_fields(spark, sf_dir))


@query(f"WITH f AS ({_FIELDS_SQL}), a AS (SELECT field, count(*) FILTER (outcome IN ('correct_value', 'correct_null')) / count(*) AS r FROM f GROUP BY field) SELECT sum(r) / count(r) AS macro_accuracy FROM a")
def macro_field_accuracy(spark, sf_dir):
    return mt.macro_field_accuracy(_fields(spark, sf_dir))


# comparison of evaluations

_RANK_SQL = "CASE outcome WHEN 'passed' THEN 2 WHEN 'failed' THEN 1 ELSE 0 END"
_CASES_SQL = f"""b AS ({_CHECKS_SQL.format(limit=500)}), c AS ({_CHECKS_SQL.format(limit=900)}),
 p AS (SELECT b.case_id, b.outcome AS bo, c.outcome AS co, c.r - b.r AS step FROM (SELECT *, {_RANK_SQL} AS r FROM b) b JOIN (SELECT *, {_RANK_SQL} AS r FROM c) c USING (case_id))"""


@query(
    f"""WITH {_CASES_SQL} SELECT count(*) FILTER (step > 0) AS improved, count(*) FILTER (step < 0) AS regressed, CAST(0 AS BIGINT) AS mixed, count(*) FILTER (step = 0) AS unchanged,
    count(*) FILTER (bo = 'passed') / count(*) AS before_pass_rate, count(*) FILTER (bo IN ('passed', 'failed')) / count(*) AS before_coverage,
    count(*) FILTER (co = 'passed') / count(*) AS after_pass_rate, count(*) FILTER (co IN ('passed', 'failed')) / count(*) AS after_coverage,
    count(*) FILTER (co = 'passed') / count(*) - count(*) FILTER (bo = 'passed') / count(*) AS pass_rate_delta,
    count(*) FILTER (co IN ('passed', 'failed')) / count(*) - count(*) FILTER (bo IN ('passed', 'failed')) / count(*) AS coverage_delta FROM p"""
)
def variant_compare(spark, sf_dir):
    return cp.compare_totals(cp.compare_cases(_checks(spark, sf_dir), _checks(spark, sf_dir, 900)))


@query(None)
def bootstrap_intervals(spark, sf_dir):
    a, b = (cp.case_samples(_checks(spark, sf_dir, n)) for n in (500, 900))
    rows = [("baseline", *cp.ratio_interval(a)), ("candidate", *cp.ratio_interval(b)), ("difference", *cp.paired_difference_interval(a, b))]
    return spark.createDataFrame(rows, "rate string, low double, high double")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def checkpoint_latest(spark, sf_dir):
    return latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


# decisions


@query(
    """WITH d AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'answerable' WHEN 'O' THEN 'not_answerable' ELSE 'partially_answerable' END AS status,
    CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS issues, o_custkey % 2 = 0 AS has FROM orders)
    SELECT o_orderkey, concat_ws(',', CASE WHEN status <> 'answerable' AND issues = 0 THEN 'issues-required' END, CASE WHEN status = 'partially_answerable' THEN 'partial-not-supported' END,
    CASE WHEN status <> 'not_answerable' AND NOT has THEN 'answer-required' END, CASE WHEN status = 'not_answerable' AND has THEN 'answer-must-be-null' END) AS problems,
    CASE WHEN status = 'not_answerable' AND issues > 0 THEN 'other' WHEN has THEN 'yes' END AS answer,
    CASE WHEN status = 'not_answerable' AND issues > 0 THEN 'fallback' WHEN has THEN 'answer' END AS origin,
    CASE WHEN status = 'answerable' THEN 'completed' ELSE 'needs_review' END AS decided, CASE WHEN issues = 1 THEN 'ask' ELSE 'desk' END AS target FROM d"""
)
def decisions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "answerable").when(F.col("o_orderstatus") == "O", "not_answerable").otherwise("partially_answerable")
    issues = F.when(F.col("o_orderkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("no_supported_answer")))
    has = F.col("o_custkey") % 2 == 0
    answer, origin = dc.with_fallback(F.when(has, "yes"), F.col("status"), F.col("issues"), "other", ["no_supported_answer"])
    o = o.withColumns({"status": status, "issues": issues})
    problems = dc.answerability_problems("choice", F.col("status"), F.col("issues"), has)
    target = dc.review_target(F.col("issues"), {"no_supported_answer": "ask"}, "desk")
    return o.select("o_orderkey", F.array_join(problems, ",").alias("problems"), answer.alias("answer"), origin.alias("origin"), dc.decided_status(F.col("status")).alias("decided"), target.alias("target"))


@query(
    """SELECT s AS status, CASE WHEN s < 400 THEN NULL WHEN s = 401 THEN 'unauthenticated' WHEN s = 403 THEN 'forbidden' WHEN s IN (408, 504) THEN 'request_timeout' WHEN s = 429 THEN 'rate_limited'
    WHEN s IN (503, 529) THEN 'dependency_overloaded' WHEN s < 500 AND s <> 404 THEN 'request_rejected' ELSE 'dependency_failure' END AS code,
    s IN (408, 429, 500, 502, 503, 504, 529) AS again, count(*) AS n FROM (SELECT 380 + o_orderkey % 200 AS s FROM orders) GROUP BY s"""
)
def failure_codes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((380 + F.col("o_orderkey") % 200).alias("status"))
    return o.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select("status", failure_code(F.col("status")).alias("code"), retryable(F.col("status")).alias("again"), "n")


# workflows


def _order_workflow() -> Workflow:
    urgent = {"pointer": "/payload/priority", "in": ["1-URGENT", "2-HIGH"]}
    check = Step("check", lambda i: (lambda t: Outcome(i["total"], F.when(t > 300_000, "needs_review").otherwise("completed"), F.when(t < 2_000, "invalid_output")))(number_of(i["total"])), {"total": {"pointer": "/payload/total"}})
    mark = Step("mark", lambda i: literal("rush"), when={"pointer": "/payload/total", "gt": 150_000})
    fast = Flow("fast", [check, mark], [({"pointer": "/flows/fast/result/mark", "equals": "rush"}, "ship"), (None, "completed")], "desk", output={"fields": {"mark": {"first_of": ["/steps/mark/result"], "default": "none"}}})
    slow = Flow("slow", [check], Cases("/payload/status", {"F": "ship", "O": "desk"}, "completed"))
    ship = Flow("ship", [Step("label", lambda i: literal("box"))], output={"pointer": "/steps/label/result"})
    desk = Flow("desk", [Step("note", lambda i: Outcome(literal("seen"), F.lit("needs_review")))], output={"pointer": "/steps/note/result"})
    return Workflow([fast, slow, ship, desk], [(urgent, "fast"), (None, "slow")], {"first_of": ["/flows/ship/result", "/flows/desk/result"], "default": "plain"})


@query(
    """WITH o AS (SELECT o_orderkey AS run_id, o_totalprice AS t, o_orderstatus AS s, o_orderpriority IN ('1-URGENT', '2-HIGH') AS u FROM orders),
    a AS (SELECT *, CASE WHEN t < 2000 THEN 'failed' WHEN t > 300000 THEN 'needs_review' ELSE 'completed' END AS c FROM o),
    b AS (SELECT *, CASE WHEN c = 'failed' THEN NULL WHEN u THEN CASE WHEN c = 'needs_review' THEN 'desk' WHEN t > 150000 THEN 'ship' ELSE 'completed' END
      ELSE CASE WHEN c = 'needs_review' THEN 'needs_review' WHEN s = 'F' THEN 'ship' WHEN s = 'O' THEN 'desk' ELSE 'completed' END END AS nxt FROM a)
    SELECT run_id, CASE WHEN c = 'failed' THEN 'failed' WHEN nxt IN ('desk', 'needs_review') THEN 'needs_review' ELSE 'completed' END AS status,
    CASE WHEN c = 'failed' THEN 'invalid_output' END AS error, CASE WHEN c = 'failed' THEN NULL WHEN nxt = 'ship' THEN 'box' WHEN nxt = 'desk' THEN 'seen' ELSE 'plain' END AS result,
    CAST(CASE WHEN c = 'failed' THEN 1 ELSE 1 + (u AND c = 'completed' AND t > 150000)::INT + (nxt IN ('ship', 'desk'))::INT END AS INTEGER) AS steps_used,
    'start>' || CASE WHEN u THEN 'fast' ELSE 'slow' END || CASE WHEN c = 'failed' THEN '' ELSE ' ' || CASE WHEN u THEN 'fast' ELSE 'slow' END || '>' || nxt
      || CASE nxt WHEN 'ship' THEN ' ship>completed' WHEN 'desk' THEN ' desk>needs_review' ELSE '' END END AS path,
    CASE WHEN u AND c = 'completed' AND t > 150000 THEN 'completed' WHEN u THEN 'skipped' END AS mark FROM b"""
)
def workflow_runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    payload = F.to_variant_object(F.struct(F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")))
    runs = _order_workflow().run(o.select(F.col("o_orderkey").alias("run_id"), payload.alias("payload"), F.lit(None).cast("variant").alias("metadata")))
    path = F.array_join(F.transform("transitions", lambda t: F.concat_ws(">", t.source, t.target)), " ")
    return runs.select("run_id", "status", "error", F.when(F.col("status") != "failed", text_of(F.col("payload"))).alias("result"), "steps_used", path.alias("path"), F.col("fast.steps.mark.status").alias("mark"))


@query(
    """WITH RECURSIVE r AS (SELECT event_id, coalesce(value, user_id) AS v, 0 AS n FROM events UNION ALL SELECT event_id, v * 2, n + 1 FROM r WHERE n = 0 OR (n < 4 AND v < 100))
    SELECT event_id AS run_id, CAST(n AS INTEGER) AS attempts, v AS result, CASE WHEN v >= 100 THEN 'until' ELSE 'exhausted' END AS stopped_by FROM r QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY n DESC) = 1"""
)
def repeat_until(spark, sf_dir):
    double = Step("double", lambda i: F.try_variant_get(F.to_variant_object(F.struct((number_of(i["v"]) * 2).alias("x"))), "$.x", "variant"), {"v": {"pointer": "/payload/v"}})
    again = Repeat(4, {"pointer": "/flows/grow/result", "gte": 100}, {"v": {"pointer": "/flows/grow/result"}})
    flow = Flow("grow", [double], output={"pointer": "/steps/double/result"}, repeat=again)
    e = table(spark, sf_dir, "events").withColumn("v", F.coalesce("value", "user_id"))
    runs = Workflow([flow], "grow").run(e.select(F.col("event_id").alias("run_id"), F.to_variant_object(F.struct("v")).alias("payload"), F.lit(None).cast("variant").alias("metadata")))
    return runs.select("run_id", F.col("grow.attempts").alias("attempts"), number_of(F.col("grow.result")).alias("result"), F.col("grow.stopped_by").alias("stopped_by"))


@query(
    """WITH s AS (SELECT conv_id AS run_id, turn AS pos, CASE WHEN length(text) > 400 THEN 'failed' WHEN role = 'system' THEN 'needs_review' ELSE 'completed' END AS status FROM conversations)
    SELECT run_id, pos, CASE WHEN pos > min(CASE WHEN status = 'failed' THEN pos END) OVER (PARTITION BY run_id) THEN 'skipped' ELSE status END AS status FROM s"""
)
def collection_ledger(spark, sf_dir):
    status = F.when(F.length("text") > 400, "failed").when(F.col("role") == "system", "needs_review").otherwise("completed")
    return ledger(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("pos"), status.alias("status")))


@query(
    """WITH c AS (SELECT conv_id AS run_id, turn, role, length(text) AS n, count(*) OVER (PARTITION BY conv_id) AS size, bool_and(role IN ('user', 'assistant')) OVER (PARTITION BY conv_id) AS known,
      count(DISTINCT turn) OVER (PARTITION BY conv_id) AS ids, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations),
    s AS (SELECT run_id, pos, 't' || turn AS id, role AS flow, CASE WHEN n > 400 THEN 'failed' WHEN role = 'assistant' THEN 'completed' ELSE 'needs_review' END AS status FROM c WHERE known AND size <= 64 AND ids = size)
    SELECT run_id, CAST(pos AS INTEGER) AS pos, id, flow, CASE WHEN pos > min(CASE WHEN status = 'failed' THEN pos END) OVER (PARTITION BY run_id) THEN 'skipped' ELSE status END AS status FROM s
    UNION ALL SELECT DISTINCT run_id, CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 'invalid_input' FROM c WHERE NOT (known AND size <= 64 AND ids = size)"""
)
def collections(spark, sf_dir):
    item = F.struct("turn", F.struct(F.concat(F.lit("t"), "turn").alias("id"), F.col("role").alias("flow"), F.struct(F.length("text").alias("n")).alias("input")).alias("item"))
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("run_id")).agg(F.sort_array(F.collect_list(item)).alias("all"))
    c = c.select("run_id", F.to_variant_object(F.transform("all", lambda x: x.item)).alias("items"))

    def size(status: str) -> Step:
        return Step("size", lambda i: Outcome(i["n"], F.lit(status), F.when(number_of(i["n"]) > 400, "invalid_output")), {"n": {"pointer": "/payload/n"}})

    return run_collection(c, [Flow("user", [size("needs_review")]), Flow("assistant", [size("completed")])]).select("run_id", "pos", "id", "flow", "status")


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'invalid_input' END AS error, CASE WHEN event_id % 3 <> 0 THEN CAST(props->>'$.k' AS BIGINT) END AS k FROM events"""
)
def envelopes(spark, sf_dir):
    body = F.concat(F.lit('{"payload": '), "props", F.when(F.col("event_id") % 3 == 0, ', "extra": 1}').otherwise(', "metadata": {}}'))
    d = decode(table(spark, sf_dir, "events").withColumn("value", body))
    return d.select("event_id", "error", number_of(bind({"/payload": F.col("payload")}, {"pointer": "/payload/k"})).cast("long").alias("k"))


# schemas, and evaluation from end to end

_SCHEMA = {
    "type": "object",
    "required": ["lang", "n_chars"],
    "properties": {
        "lang": {"enum": ["en", "de", "fr"], "minLength": 2},
        "n_chars": {"$ref": "#/$defs/length", "exclusiveMaximum": 900},
        "source": {"anyOf": [{"pattern": "[0-4]$"}, {"const": "src7"}]},
        "quality": {"type": ["integer", "null"], "not": {"const": 0}},
        "tags": {"items": {"type": "string", "pattern": "^(e|src)"}, "maxItems": 2, "uniqueItems": True, "contains": {"const": "en"}},
    },
    "additionalProperties": False,
    "if": {"properties": {"lang": {"const": "en"}}},
    "then": {"properties": {"quality": {"type": "integer"}}},
    "$defs": {"length": {"type": "integer", "minimum": 100}},
}
_BROKEN_SQL = """nullif(concat_ws(';', CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN '/lang enum' END, CASE WHEN n_chars < 100 THEN '/n_chars minimum' END,
 CASE WHEN n_chars >= 900 THEN '/n_chars exclusiveMaximum' END, CASE WHEN NOT (regexp_matches(source, '[0-4]$') OR source = 'src7') THEN '/source anyOf' END,
 CASE WHEN quality = 0 THEN '/quality not' END, CASE WHEN lang[1] <> 'e' THEN '/tags items' END, CASE WHEN lang <> 'en' THEN '/tags contains' END,
 CASE WHEN lang = 'en' AND quality IS NULL THEN 'if' END), '')"""


@query(f"SELECT doc_id, {_BROKEN_SQL} IS NULL AS fits, coalesce({_BROKEN_SQL}, '') AS broken FROM documents LEFT JOIN labels USING (doc_id)")
def schema_validation(spark, sf_dir):
    d = _labelled(spark, sf_dir)
    return d.select("doc_id", valid(F.col("doc"), _SCHEMA).alias("fits"), F.array_join(violations(F.col("doc"), _SCHEMA), ";").alias("broken"))


@query("SELECT o_orderkey, o_orderkey % 3 > 0 AS gt, o_orderkey % 3 >= 1 AS gte, o_orderkey % 3 < 1 AS lt, o_orderkey % 3 = 0 AS lte FROM orders")
def wide_order(spark, sf_dir):
    """Whole numbers beyond the doubles' precision are ordered exactly."""
    big = 9_007_199_254_740_992
    o = table(spark, sf_dir, "orders").withColumn("v", parse((F.col("o_orderkey") % 3 + big).cast("string")))
    tests = {"gt": big, "gte": big + 1, "lt": big + 1, "lte": big}
    return o.select("o_orderkey", *(holds({"": F.col("v")}, {"pointer": "", name: n}).alias(name) for name, n in tests.items()))


_EVALUATED_SQL = """SELECT d.*, q.quality, n.no AS check_ordinal, CASE WHEN lang = 'de' THEN 'failed' WHEN n_chars < 100 THEN 'needs_review' ELSE 'completed' END AS status,
 CASE WHEN doc_id % 10 = 9 THEN 'missing'
  WHEN no = 0 THEN CASE WHEN lang = 'de' THEN 'error' WHEN (n_chars >= 500) = (coalesce(quality, 0) = 1) THEN 'passed' ELSE 'failed' END
  WHEN no = 1 THEN CASE WHEN lang = 'de' THEN 'error' WHEN coalesce(source, '') = 'src1' OR lang = 'en' THEN 'passed' ELSE 'failed' END
  WHEN no = 2 THEN CASE WHEN lang = 'de' THEN 'error' WHEN n_chars >= 100 THEN CASE WHEN contains(lower(source), 'c2') THEN 'passed' ELSE 'failed' END WHEN quality IS NULL THEN 'passed' ELSE 'failed' END
  ELSE CASE WHEN lang = 'de' THEN 'error' WHEN n_chars >= 100 THEN CASE WHEN n_chars % 2 = 0 THEN 'passed' ELSE 'failed' END ELSE 'missing' END END AS outcome
 FROM documents d LEFT JOIN labels q USING (doc_id) CROSS JOIN (VALUES (0), (1), (2), (3)) n(no)"""


def _evaluated(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Checks and runs of a rule on documents: four expectations of each, a tenth of the cases without a run, failed and reviewed runs."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("case_id", F.col("doc_id"))
    q, n = F.col("quality"), F.col("n_chars")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    long_enough = F.when(n < 100, q.isNull())
    wanted = [
        ("/result/label", F.when(q == 1, '"good"').otherwise('"bad"'), "exact", False),
        ("/result/tags", F.concat(F.lit("["), text(F.when(F.col("lang") == "en", F.col("source")).otherwise(F.lit("src1"))), F.lit(","), text(F.col("lang")), F.lit("]")), "set", False),
        ("/result/origin~1name", F.when(n < 100, F.when(long_enough, "[null]").otherwise("[1]")).otherwise(F.when(F.lower("source").contains("c2"), F.concat(F.lit("["), text(F.col("source")), F.lit("]"))).otherwise("[1]")), "one_of", True),
        ("/result/parts/1", F.when(n % 2 == 0, '"B  x"').otherwise('"c x"'), "text", False),
    ]
    checks = F.explode(F.array(*(F.struct(F.lit(k).alias("check_ordinal"), F.lit(p).alias("path"), e.alias("expected"), F.lit(c).alias("comparison"), F.lit(a).alias("absent_as_null")) for k, (p, e, c, a) in enumerate(wanted))))
    gold = d.select("case_id", "lang", checks.alias("c")).select("case_id", "lang", "c.*")
    own = d.where("doc_id % 10 <> 9").withColumn("run_id", F.concat(F.lit("r"), "doc_id"))
    own = own.withColumn("status", F.when(F.col("lang") == "de", "failed").when(n < 100, "needs_review").otherwise("completed"))
    label = F.when(n >= 500, '"good"').otherwise('"bad"')
    extra = F.when(n >= 100, F.concat(F.lit(',"origin/name":'), text(F.col("source")), F.lit(',"parts":["a","b X"]'))).otherwise("")
    document = F.concat(F.lit('{"result":{"label":'), label, F.lit(',"tags":['), text(F.col("lang")), F.lit(","), text(F.col("source")), F.lit("]"), extra, F.lit("}}"))
    runs = own.select("run_id", "case_id", "lang", "status", parse(F.when(F.col("lang") != "de", document).otherwise("{}")).alias("document"))
    return ev.evaluate(gold, runs, runs.select("run_id", F.lit("/result").alias("path"), "status")), runs


@query(f"WITH x AS ({_EVALUATED_SQL}) SELECT doc_id AS case_id, check_ordinal, outcome FROM x")
def evaluation_checks(spark, sf_dir):
    return _evaluated(spark, sf_dir)[0].select("case_id", "check_ordinal", "outcome")


@query(
    f"""WITH x AS ({_EVALUATED_SQL}), r AS (SELECT doc_id, lang, any_value(status) AS status, bool_and(outcome = 'passed') AS ok FROM x WHERE doc_id % 10 <> 9 GROUP BY ALL),
    c AS (SELECT lang, count(*) AS total, {', '.join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in ("passed", "failed", "missing", "skipped", "error"))},
    count(*) FILTER (outcome = 'passed') / count(*) AS pass_rate, count(*) FILTER (outcome IN ('passed', 'failed')) / count(*) AS coverage FROM x GROUP BY lang)
    SELECT c.*, count(r.doc_id) AS runs, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'needs_review') AS needs_review, count(*) FILTER (status = 'failed') AS stopped,
    count(*) FILTER (status = 'failed') / count(r.doc_id) AS failure_rate, count(*) FILTER (status = 'needs_review') / count(r.doc_id) AS review_rate, count(*) FILTER (ok) / count(r.doc_id) AS case_pass_rate
    FROM c LEFT JOIN r USING (lang) GROUP BY ALL"""
)
def evaluation_report(spark, sf_dir):
    return ev.report(*_evaluated(spark, sf_dir), "lang")


# what decisions return, journals, usage by model


@query(
    """SELECT doc_id, concat_ws(',', CASE WHEN source NOT IN ('src1', 'src2') OR lang NOT IN ('en', 'src1', 'src2') THEN 'unknown-option' END, CASE WHEN doc_id % 4 = 0 THEN 'duplicate-option' END,
    CASE WHEN doc_id % 4 = 1 THEN 'too-few' END, CASE WHEN doc_id % 4 = 0 THEN 'too-many' END) AS choice,
    concat_ws(',', CASE WHEN lang <> 'en' THEN 'missing:en' END, CASE WHEN source <> 'src1' THEN 'missing:src1' END, CASE WHEN lang <> 'en' THEN 'unknown:' || lang END, CASE WHEN source <> 'src1' THEN 'unknown:' || source END,
    CASE WHEN doc_id % 3 = 0 THEN 'duplicate:' || lang END) AS questions,
    contains(text, 'the ') OR contains(source, 'the ') AS subject FROM documents"""
)
def decision_outputs(spark, sf_dir):
    d, no = table(spark, sf_dir, "documents"), F.col("doc_id") % 4
    chosen = F.when(no == 0, F.array("source", "lang", "source")).when(no == 1, F.array("source")).otherwise(F.array("source", "lang"))
    chosen = F.when(no == 1, F.when(F.col("lang").isin("en", "src1", "src2"), chosen).otherwise(F.array("lang"))).otherwise(chosen)
    asked = F.when(F.col("doc_id") % 3 == 0, F.array("lang", "source", "lang")).otherwise(F.array("lang", "source"))
    join = lambda c: F.array_join(c, ",")
    return d.select("doc_id", join(dc.choice_problems(chosen, ["en", "src1", "src2"], 2, 2)).alias("choice"), join(dc.question_problems(["en", "src1"], asked)).alias("questions"), dc.subject_found(F.lit("the "), F.array("text", "source")).alias("subject"))


@query(
    """SELECT c_custkey % 3 <> 0 AS recorded, count(*) AS n, CAST(sum(CASE WHEN c_custkey % 3 = 0 OR c_custkey % 6 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS to_run FROM customer GROUP BY ALL"""
)
def journal_cases(spark, sf_dir):
    """Cases to run: those never recorded, and those recorded with another input (white space and order of keys apart)."""
    k = F.col("c_custkey")
    gold = table(spark, sf_dir, "customer").select(k.alias("case_id"), F.lit(1).alias("repetition"), F.concat(F.lit('{"a": '), k, F.lit(', "b": 1}')).alias("input"))
    journal = gold.where("case_id % 3 <> 0").withColumn("input", F.concat(F.lit('{"b":1,"a":'), F.when(F.col("case_id") % 6 == 1, -F.col("case_id")).otherwise(F.col("case_id")), F.lit("}")))
    known, left = recorded_cases(journal).withColumn("known", F.lit(1)), to_run(gold, journal).select("case_id", F.lit(1).alias("open"))
    both = gold.join(known, "case_id", "left").join(left, "case_id", "left")
    return both.groupBy(F.col("known").isNotNull().alias("recorded")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("open", F.lit(0))).cast("long").alias("to_run"))


@query(
    """SELECT event_type, 'm' || user_id % 3 AS model, count(*) AS requests, CASE WHEN bool_and(event_type <> 'error') THEN CAST(sum(user_id) AS BIGINT) END AS input_tokens, CAST(sum(event_id) AS BIGINT) AS output_tokens FROM events GROUP BY ALL"""
)
def usage_by_model(spark, sf_dir):
    e, user = table(spark, sf_dir, "events"), F.col("user_id")
    zero = F.when(F.col("event_type") == "error", 0).otherwise(1)  # a zero among the details alone is unknown
    tokens = reported(F.when(zero == 1, user), user * zero)
    r = e.select("event_type", F.concat(F.lit("m"), user % 3).alias("model"), F.lit(1).alias("requests"), tokens.alias("input_tokens"), F.col("event_id").alias("output_tokens"))
    return sm.usage_by_model(r, "event_type")


@query("SELECT CAST(sum(user_id) AS DOUBLE) / count(*) AS before_mean, CAST(sum(event_id) AS DOUBLE) / count(*) AS after_mean, CAST(sum(event_id) AS DOUBLE) / count(*) - CAST(sum(user_id) AS DOUBLE) / count(*) AS delta FROM events")
def latency_comparison(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return cp.latency_comparison(e.select(F.col("user_id").cast("double").alias("seconds")), e.select(F.col("event_id").cast("double").alias("seconds")))


@query("SELECT conv_id, CASE WHEN bool_and(role IS NOT NULL) THEN string_agg(role, ',' ORDER BY turn) END AS roles, 'n=' || count(*) AS said FROM conversations GROUP BY conv_id")
def projections(spark, sf_dir):
    """One field of every item of an array, and several bindings at once."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(turns.alias("turns"), F.count(F.lit(1)).alias("n"))).alias("t")).withColumn("doc", parse(F.col("t")))
    found = bind_all({"": F.col("doc")}, {"turns": {"pointer": "/turns"}, "n": {"first_of": ["/none", "/n"]}})
    roles = F.array_join(F.transform(project(found["turns"], "/role"), text_of), ",")
    return c.select("conv_id", roles.alias("roles"), render("n={{ n }}", found).alias("said"))


# fields' gold, sets of labels, changes of statuses

_FIELD_PATHS = {"lang": "/result/lang", "a/b": "/result/a~1b", "c~d": "/result/c~0d", "none": "/result/none"}


@query(
    """SELECT doc_id AS case_id, CAST(0 AS INTEGER) AS field_no, 'lang' AS field, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END AS gold FROM documents
    UNION ALL SELECT doc_id, 1, 'a/b', source FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 2, 'c~d', NULL FROM documents WHERE doc_id % 5 = 0"""
)
def field_gold(spark, sf_dir):
    d, no = table(spark, sf_dir, "documents"), F.col("doc_id")
    check = lambda path, ordinal, gold: F.struct(F.lit(path).alias("path"), F.lit(ordinal).alias("check_ordinal"), gold.alias("gold"))
    checks = [
        check(_FIELD_PATHS["lang"], 5, F.col("lang")), check("/result", 1, F.col("text")), check("/result/lang/x", 0, F.col("text")),
        F.when(no % 3 == 0, check(_FIELD_PATHS["lang"], 4, F.col("source"))), F.when(no % 2 == 0, check(_FIELD_PATHS["a/b"], 2, F.col("source"))),
        F.when(no % 5 == 0, check(_FIELD_PATHS["c~d"], 3, F.lit(None).cast("string"))), F.when(no % 5 == 0, check(_FIELD_PATHS["c~d"], 6, F.col("lang"))),
    ]
    asked = d.select(no.alias("case_id"), F.explode(F.array(*checks)).alias("c")).where("c IS NOT NULL").select("case_id", "c.*")
    return mt.field_gold(asked, "/result", list(_FIELD_PATHS))


_SETS_STATE_SQL = "CASE conv_id % 7 WHEN 0 THEN 'excluded' WHEN 1 THEN 'missing' ELSE 'observed' END"


@query(
    f"""WITH c AS (SELECT {_SETS_STATE_SQL} AS state, list_sort(list(DISTINCT role)) AS gold, list_sort(list(DISTINCT role) FILTER (turn < 3)) AS pred FROM conversations GROUP BY conv_id)
    SELECT count(*) FILTER (state <> 'excluded') AS support, {', '.join(f"count(*) FILTER (state = '{s}') AS {s}" for s in mt.STATES)}, count(*) FILTER (state = 'observed' AND gold = pred) AS correct,
    count(*) FILTER (state = 'observed' AND gold = pred) / count(*) FILTER (state <> 'excluded') AS accuracy, count(*) FILTER (state = 'observed') / count(*) FILTER (state <> 'excluded') AS coverage FROM c"""
)
def multilabel_summary(spark, sf_dir):
    c, role = table(spark, sf_dir, "conversations"), F.col("role")
    state = F.when(F.col("conv_id") % 7 == 0, "excluded").when(F.col("conv_id") % 7 == 1, "missing").otherwise("observed")
    return mt.metric_summary(c.groupBy("conv_id").agg(F.collect_list(role).alias("gold"), F.collect_list(F.when(F.col("turn") < 3, role)).alias("pred")).withColumn("state", state))


def _outcomes(spark, sf_dir, first, second) -> DataFrame:
    no = F.col("doc_id")
    one = lambda ordinal, outcome: F.struct(F.lit(ordinal).alias("check_ordinal"), outcome.alias("outcome"))
    checks = F.array(one(0, F.when(no % first == 0, "passed").otherwise("failed")), one(1, F.when(no % second == 0, "passed").otherwise("missing")))
    return table(spark, sf_dir, "documents").select(no.alias("case_id"), F.lit(0).alias("repetition"), F.explode(checks).alias("c")).select("case_id", "repetition", "c.*")


def _statuses(spark, sf_dir, every, worst) -> DataFrame:
    no = F.col("doc_id") % every
    status = F.when(no == 0, worst).when(no == 1, "needs_review").otherwise("completed")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.lit(0).alias("repetition"), status.alias("status"))


_STATUS_SQL = "CASE doc_id % {0} WHEN 0 THEN '{1}' WHEN 1 THEN 'needs_review' ELSE 'completed' END"
_BOTH_SQL = f"s AS (SELECT doc_id, {_STATUS_SQL.format(7, 'failed')} AS b, {_STATUS_SQL.format(4, 'error')} AS c FROM documents)"
_STATUS_RANK_SQL = "CASE {0} WHEN 'completed' THEN 2 WHEN 'needs_review' THEN 1 ELSE 0 END"


@query(
    f"""WITH {_BOTH_SQL}, x AS (SELECT {_STATUS_RANK_SQL.format('c')} - {_STATUS_RANK_SQL.format('b')} AS m, CAST(doc_id % 3 = 0 AS INTEGER) - CAST(doc_id % 2 = 0 AS INTEGER) AS p,
    2 * CAST(doc_id % 2 = 0 AS INTEGER) - 2 * CAST(doc_id % 5 = 0 AS INTEGER) AS q FROM s)
    SELECT CASE WHEN greatest(m, p, q) > 0 AND least(m, p, q) < 0 THEN 'mixed' WHEN greatest(m, p, q) > 0 THEN 'improved' WHEN least(m, p, q) < 0 THEN 'regressed' ELSE 'unchanged' END AS change, count(*) AS n FROM x GROUP BY 1"""
)
def variant_changes(spark, sf_dir):
    sides = _outcomes(spark, sf_dir, 2, 5), _outcomes(spark, sf_dir, 3, 2)
    statuses = _statuses(spark, sf_dir, 7, "failed"), _statuses(spark, sf_dir, 4, "error")
    return cp.compare_cases(*sides, statuses).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_BOTH_SQL}, k AS (SELECT unnest([{', '.join(f"'{s}'" for s in ck.STATUS_RANK)}]) AS status)
    SELECT status, (SELECT count(*) FROM s WHERE b = status) AS before, (SELECT count(*) FROM s WHERE c = status) AS after,
    (SELECT count(*) FROM s WHERE c = status) - (SELECT count(*) FROM s WHERE b = status) AS delta FROM k"""
)
def variant_statuses(spark, sf_dir):
    return cp.compare_statuses(_statuses(spark, sf_dir, 7, "failed"), _statuses(spark, sf_dir, 4, "error"))


@query(
    f"""WITH {_BOTH_SQL}, r AS (SELECT count(*) FILTER (b = 'failed') / count(*) AS before_failure_rate, count(*) FILTER (b = 'needs_review') / count(*) AS before_review_rate,
    count(*) FILTER (c = 'error') / count(*) AS after_failure_rate, count(*) FILTER (c = 'needs_review') / count(*) AS after_review_rate FROM s)
    SELECT *, after_failure_rate - before_failure_rate AS failure_rate_delta, after_review_rate - before_review_rate AS review_rate_delta FROM r"""
)
def variant_status_rates(spark, sf_dir):
    return cp.compare_status_rates(_statuses(spark, sf_dir, 7, "failed"), _statuses(spark, sf_dir, 4, "error"))


@query(
    f"""WITH a AS (SELECT DISTINCT user_id AS run_id FROM events), r AS (SELECT user_id AS run_id, event_type AS flow, min(value) AS seconds FROM events GROUP BY ALL),
    w AS (SELECT run_id, flow, r.seconds FROM a CROSS JOIN (VALUES ('click'), ('error'), ('none')) s(flow) LEFT JOIN r USING (run_id, flow)),
    x AS (SELECT *, CASE WHEN seconds IS NULL THEN NULL WHEN flow = 'error' THEN 'skipped' WHEN seconds < 5 THEN 'needs_review' ELSE 'completed' END AS status FROM w)
    SELECT flow, count(status) AS invocations, count(*) FILTER (status IS NULL) AS no_record, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'needs_review') AS needs_review,
    count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, {_LATENCY.format(s='seconds')} FROM x GROUP BY flow"""
)
def flow_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    r = e.groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("flow")).agg(F.min("value").alias("seconds"))
    r = r.withColumn("status", F.when(F.col("flow") == "error", "skipped").when(F.col("seconds") < 5, "needs_review").otherwise("completed"))
    return sm.flow_summary(e.select(F.col("user_id").alias("run_id")).distinct(), r, ["click", "error", "none"])


@query("SELECT doc_id AS case_id, doc_id % 2 AS repetition, lang AS gold, source AS result FROM documents")
def replayed(spark, sf_dir):
    """Saved results beside gold whose input has the same content, with other spaces and its keys in another order."""
    d = table(spark, sf_dir, "documents")
    key = [F.col("doc_id").alias("case_id"), (F.col("doc_id") % 2).alias("repetition")]
    n = F.col("n_chars").cast("string")
    gold = d.select(*key, F.concat(F.lit('{"n": '), n, F.lit(', "a": [1, null]}')).alias("input"), F.col("lang").alias("gold"))
    saved = d.select(*key, F.concat(F.lit('{"a":[1,null],"n":'), n, F.lit("}")).alias("input"), F.col("source").alias("result"))
    return replay(gold, saved).select("case_id", "repetition", "gold", "result")


from . import more_queries  # noqa: E402, F401 - registers its queries
