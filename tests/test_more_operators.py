"""Comparisons that do not fit, relations of unknown units, and intervals against their serial rendering."""

import math
import random

import pytest
from gristmill.operators import compare as cp
from gristmill.operators import decisions as dc
from gristmill.sources import journal


def serial(samples, resamples, level, seed):
    """The statistics' percentiles, drawn case by case from one generator."""
    rng, out = random.Random(seed), []
    for _ in range(resamples):
        picks = [rng.randrange(len(samples)) for _ in samples]
        d = [sum(samples[k][c] for k in picks) for c in range(1, len(samples[0]))]
        rates = [d[k] / d[k + 1] if d[k + 1] else None for k in range(0, len(d), 2)]
        if None not in rates:
            out.append(rates[0] if len(rates) == 1 else rates[1] - rates[0])
    out.sort()

    def at(q):
        p = q * (len(out) - 1)
        low = math.floor(p)
        return out[low] + (out[min(low + 1, len(out) - 1)] - out[low]) * (p - low)

    return at((1 - level) / 2), at(1 - (1 - level) / 2)


@pytest.mark.parametrize("cases,parts,picks", [(2, 3, 1 << 18), (33, 64, 7), (64, 1, 1 << 18)])
def test_intervals(spark, monkeypatch, cases, parts, picks):
    monkeypatch.setattr(cp, "PICKS", picks)
    r = random.Random(cases)
    a, b = ([(k, r.randint(0, n), n) for k, n in enumerate(r.choices([1, 2, 5], k=cases))] for _ in "ab")
    da, db = (spark.createDataFrame(x, "case_id long, num long, den long").repartition(3) for x in (a, b))
    assert cp.ratio_interval(da, 50, 0.9, 4) == pytest.approx(serial(a, 50, 0.9, 4), abs=1e-12)
    both = [(k, n, d, *b[k][1:]) for k, n, d in a]
    assert cp.paired_difference_interval(da, db, 50, 0.9, 4) == pytest.approx(serial(both, 50, 0.9, 4), abs=1e-12)
    cases_, sums = cp.resample_sums(da, ["num", "den"], ["case_id"], 20, 1, parts)
    assert cases_ == cases and sums.count() == 20
    with pytest.raises(ValueError):
        cp.paired_difference_interval(da, db.where("case_id > 0"))


def test_counts_in_blocks(spark, monkeypatch):
    """Draws reach the samples as a byte for each case, in blocks, not as a row for each case of each resample."""
    monkeypatch.setattr(cp, "BLOCK", 8)
    a = [(k, k % 3, 1 + k % 2) for k in range(50)]
    da = spark.createDataFrame(a, "case_id long, num long, den long")
    assert cp.ratio_interval(da, 40, 0.9, 7) == pytest.approx(serial(a, 40, 0.9, 7), abs=1e-12)
    rng = random.Random(7)
    picks = [[rng.randrange(50) for _ in range(50)] for _ in range(40)]
    counts = [c.tolist() for _, n, state in cp._streams(50, 40, 7, 6) for c in cp._counts(state, 50, n)]
    assert counts == [[p.count(k) for k in range(50)] for p in picks]


def test_draws_of_one_case_above_a_byte(spark, monkeypatch):
    monkeypatch.setattr(cp, "_counts", lambda state, cases, n: iter([cp.np.array([300, 2], cp.np.uint32)] * n))
    _, sums = cp.resample_sums(spark.createDataFrame([(0, 1, 10), (1, 5, None)], "case_id long, num long, den long"), ["num", "den"], ["case_id"], 3, 1)
    assert {tuple(r) for r in sums.select("num", "den").collect()} == {(310.0, 3000.0)}


def test_sides_that_do_not_fit(spark):
    schema = "case_id string, repetition int, check_ordinal int, outcome string"
    three = spark.createDataFrame([("a", 1, k, "passed") for k in range(3)], schema)
    one = three.where("check_ordinal = 0")
    for before, after in ((three, one), (one, three), (three.unionByName(one), three)):
        with pytest.raises(ValueError):
            cp.compare_cases(before, after)
    assert cp.compare_cases(three, three).count() == 1
    runs = spark.createDataFrame([("a", 1, "completed")], "case_id string, repetition int, status string")
    with pytest.raises(ValueError):
        cp.compare_cases(three, three, (runs, runs.where("false")))


def test_relations_of_unknown_units(spark):
    rows = [("r", "1", "2", "requires", None), ("r", "1", "9", "requires", None), ("r", "8", "2", "excludes", None), ("r", "1", "p", "if", "yes"), ("r", "1", "p", "if", "no"), ("r", "2", "p", "if", "yes"), ("r", "2", "p", "if", "yes"), ("r", "7", "q", "if", "yes"), ("r", "p", "p", "if", "yes")]
    r = spark.createDataFrame(rows, "run_id string, source string, target string, kind string, value string")
    units, predicates = spark.createDataFrame([("r", u) for u in "12"], "run_id string, unit string"), spark.createDataFrame([("r", "p")], "run_id string, predicate string")
    got = sorted(map(str, [(x["source"], x["target"], x["value"], x["problems"]) for x in dc.relation_problems(r, "run_id", units, predicates).collect()]))
    assert got == sorted(map(str, [
        ("1", "2", None, []), ("1", "9", None, ["unknown_unit"]), ("8", "2", None, ["unknown_unit"]), ("1", "p", "yes", ["conflict"]), ("1", "p", "no", ["conflict"]),
        ("2", "p", "yes", ["duplicate"]), ("2", "p", "yes", ["duplicate"]), ("7", "q", "yes", ["unknown_unit", "unknown_predicate"]), ("p", "p", "yes", ["unknown_unit"]),
    ]))
    assert "value" not in dc.relation_problems(r.drop("value")).columns


def test_latest_of_equal_times(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 1, "z"), ("a", 1, "y")], "k string, t int, v string")
    assert journal.latest(rows, ["k"], ["t"]).first()["v"] == "z"


def test_amounts_are_exact_where_doubles_are_not(spark):
    """A sum of 3,305,330,912,271,254.7 millionths is 255 at its end; as a double it is 254.5, and 254 half to even."""
    from decimal import Decimal

    from pyspark.sql import functions as F

    from gristmill.operators import summaries as sm

    x = spark.sql("SELECT CAST('3305330912.271254' AS DECIMAL(38, 12)) AS amount, 'USD' AS currency, 1 AS requests UNION ALL SELECT CAST('0.0000007' AS DECIMAL(38, 12)), 'USD', 1")
    r = sm.cost_summary(x).select("amount", (F.col("amount") * 1_000_000).cast("long").alias("micro")).first()
    assert r["amount"] == Decimal("3305330912.271255") and r["micro"] == 3305330912271255
