"""Two evaluations of the same cases, and intervals of rates."""

from __future__ import annotations

import pickle
import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import settled
from .checks import OUTCOME_RANK, STATUS_RANK, ratio

RESAMPLES, LEVEL, SEED = 2000, 0.95, 0


def _rank(column: str, ranks: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for name, k in reversed(ranks.items()):
        out = F.when(F.col(column) == name, k).otherwise(out)
    return out


def unmatched(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys that only one side has, and keys that a side has more than once; empty where the sides fit."""
    n = lambda df, c: df.groupBy(*key).agg(F.count(F.lit(1)).alias(c))
    both = n(left, "left_n").join(n(right, "right_n"), key, "full_outer").fillna(0, ["left_n", "right_n"])
    return both.where("left_n <> 1 OR right_n <> 1")


def compare_cases(baseline: DataFrame, candidate: DataFrame, statuses: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """change of each attempt (case_id, repetition): improved, regressed, mixed or unchanged, and its counts of checks.

    Checks pair by (case_id, repetition, check_ordinal); a change of the run's status counts like that of a check. Sides that
    do not fit, in their checks or their runs, are an error.
    """
    key = ["case_id", "repetition", "check_ordinal"]
    for before, after, own in [(baseline, candidate, key), *([(*statuses, key[:2])] if statuses else [])]:
        if not unmatched(before, after, own).isEmpty():
            raise ValueError(f"the sides have other {own} than each other, or have some twice")
    sides = [df.select(*key, _rank("outcome", OUTCOME_RANK).alias(side), F.col("outcome").alias(f"{side}_outcome")) for df, side in ((baseline, "before"), (candidate, "after"))]
    pairs = sides[0].join(sides[1], key).withColumn("step", F.col("after") - F.col("before"))
    passed = lambda side: F.count_if(F.col(f"{side}_outcome") == "passed").alias(f"{side}_passed")
    covered = lambda side: F.count_if(F.col(f"{side}_outcome").isin("passed", "failed")).alias(f"{side}_covered")
    out = pairs.groupBy("case_id", "repetition").agg(F.max("step").alias("up"), F.min("step").alias("down"), F.count(F.lit(1)).alias("checks"), passed("before"), passed("after"), covered("before"), covered("after"))
    if statuses:
        b, c = (df.select("case_id", "repetition", _rank("status", STATUS_RANK).alias(side)) for df, side in zip(statuses, ("b", "c"), strict=True))
        moved = b.join(c, ["case_id", "repetition"]).select("case_id", "repetition", (F.col("c") - F.col("b")).alias("moved"))
        out = out.join(moved, ["case_id", "repetition"]).withColumns({"up": F.greatest("up", "moved"), "down": F.least("down", "moved")}).drop("moved")
    up, down = F.col("up") > 0, F.col("down") < 0
    change = F.when(up & down, "mixed").when(up, "improved").when(down, "regressed").otherwise("unchanged")
    return out.withColumn("change", change).drop("up", "down")


def compare_totals(cases: DataFrame) -> DataFrame:
    """Totals by change, pass rates and coverages of both sides, and their differences."""
    n = [F.count_if(F.col("change") == c).alias(c) for c in ("improved", "regressed", "mixed", "unchanged")]
    rate = {f"{side}_{what}": ratio(F.sum(f"{side}_{part}"), F.sum("checks")) for side in ("before", "after") for what, part in (("pass_rate", "passed"), ("coverage", "covered"))}
    out = cases.agg(*n, *(c.alias(k) for k, c in rate.items()))
    return out.withColumns({f"{what}_delta": F.col(f"after_{what}") - F.col(f"before_{what}") for what in ("pass_rate", "coverage")})


def _status_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """status, before, after: how many attempts of each side ended so; statuses that neither side has are left out."""
    both = before.select("status", F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select("status", F.lit(0).alias("b"), F.lit(1).alias("a")))
    return both.groupBy("status").agg(F.sum("b").alias("before"), F.sum("a").alias("after"))


def compare_statuses(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts by status of two evaluations' attempts, and the difference: one row for each known status, zeros included."""
    known = before.sparkSession.createDataFrame([(s,) for s in STATUS_RANK], "status string")
    n = known.join(_status_counts(before, after), "status", "left").fillna(0, ["before", "after"])
    return n.withColumn("delta", F.col("after") - F.col("before"))


def compare_status_rates(before: DataFrame, after: DataFrame) -> DataFrame:
    """Failure and review rates of both sides, and their differences: one row."""
    n = _status_counts(before, after)
    rate = lambda side, which: ratio(F.coalesce(F.sum(F.when(which, F.col(side))), F.lit(0)), F.sum(side))
    parts = {"failure": F.col("status").isin("failed", "cancelled", "error"), "review": F.col("status") == "needs_review"}
    out = n.agg(*(rate(side, which).alias(f"{side}_{name}_rate") for side in ("before", "after") for name, which in parts.items()))
    return out.withColumns({f"{name}_rate_delta": F.col(f"after_{name}_rate") - F.col(f"before_{name}_rate") for name in parts})


def case_samples(checks: DataFrame, side: str = "") -> DataFrame:
    """One sample for each source case, its repetitions pooled: passed checks and all checks."""
    return checks.groupBy("case_id").agg(F.count_if(F.col("outcome") == "passed").alias(f"{side}num"), F.count(F.lit(1)).alias(f"{side}den"))


#: Picks that are handed out together, and cases whose counts and samples meet in one group.
PICKS, BLOCK = 1 << 18, 1 << 12


def _words(state: tuple) -> np.random.MT19937:
    """numpy's generator at a state of Python's: both make the same 32-bit words, and getrandbits takes the high bits of one."""
    words = np.random.MT19937()
    words.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[1][:-1], np.uint32), "pos": state[1][-1]}}
    return words


def _next(words: np.random.MT19937, cases: int, left: int) -> np.ndarray:
    """The picks that the next words give: of at most ``left``, and of PICKS; words that name no case give none."""
    found = words.random_raw(min(left, PICKS)) >> np.uint64(32 - cases.bit_length())
    return found[found < cases]


@lru_cache(8)
def _streams(cases: int, resamples: int, seed: int, parts: int) -> list[tuple[int, int, bytes]]:
    """(first resample, how many, state of the generator there) for each part of the resamples.

    The picks of all resamples are one stream of one generator, and each pick takes as many of its words as it needs. The
    driver runs through the stream once and keeps a state for each part: numbers are drawn, but none are kept.
    """
    words, out, at = _words(random.Random(seed).getstate()), [], 0
    for k in range(parts):
        n = resamples * (k + 1) // parts - at
        if n:
            out.append((at, n, pickle.dumps(words.state)))
            left = n * cases
            if k + 1 < parts:
                while left:
                    left -= len(_next(words, cases, left))
        at += n
    return out


def _counts(state: bytes, cases: int, resamples: int) -> Iterator[np.ndarray]:
    """For each resample how often it draws each case."""
    words = np.random.MT19937()
    words.state = pickle.loads(state)
    for _ in range(resamples):
        left, counts = cases, np.zeros(cases, np.uint32)
        while left:
            picks = _next(words, cases, left)
            np.add.at(counts, picks, np.uint32(1))
            left -= len(picks)
        yield counts


def resample_sums(samples: DataFrame, columns: list[str], order: list[str], resamples: int, seed: int, parts: int = 64) -> tuple[int, DataFrame]:
    """The number of cases, and resample with the sums of columns over the cases that it draws with replacement.

    Cases are numbered in ``order``. The draws are those of one seeded generator, resample after resample; each task makes its
    own resamples' draws from the generator's state there, and counts how often each case is drawn. The counts of BLOCK cases
    are one row, a byte a case, and meet the samples by the block's number.
    """
    spark = samples.sparkSession
    ids = settled(samples.select(*order, *columns))
    # numbers by ranges: only the sizes of ranges pass the driver
    ranged = settled(ids.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}
    before = {p: sum(n for q, n in sizes.items() if q < p) for p in sizes}
    cases = sum(sizes.values())
    if cases < 2:
        return cases, spark.createDataFrame([], "resample int, " + ", ".join(f"{c} double" for c in columns))
    if cases.bit_length() > 32:
        raise ValueError("a pick is one word of the generator, of 32 bits")
    offset = F.element_at(F.create_map(*(F.lit(x) for p, n in before.items() for x in (p, n))), F.col("_part"))
    case = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + offset
    numbered = ranged.withColumn("case", case.cast("long")).select(F.floor(F.col("case") / BLOCK).cast("int").alias("block"), (F.col("case") % BLOCK).cast("int").alias("at"), *(F.col(c).cast("double").alias(c) for c in columns))
    streams = spark.createDataFrame(_streams(cases, resamples, seed, min(parts, resamples)), "first int, n int, state binary").repartition(min(parts, resamples))
    size = BLOCK

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for k, counts in enumerate(_counts(r["state"], cases, r["n"])):
                    counts = counts if counts.max() > 255 else counts.astype(np.uint8)
                    blocks = [counts[at : at + size].tobytes() for at in range(0, cases, size)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(blocks), r["first"] + k, np.int32)), pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array(blocks, pa.binary())], names=["resample", "block", "counts"])

    def add_up(drawn: pa.Table, own: pa.Table) -> pa.Table:
        values = np.zeros((own.num_rows, len(columns)))
        for j, c in enumerate(columns):
            values[own["at"].to_numpy(), j] = own[c].fill_null(0).to_numpy()  # as sum() passes over NULL
        sums = np.empty((drawn.num_rows, len(columns)))
        for k, counts in enumerate(drawn["counts"]):
            bytes_ = counts.as_buffer()
            sums[k] = np.frombuffer(bytes_, np.uint8 if bytes_.size == len(values) else np.uint32) @ values
        return pa.table([drawn["resample"], *map(pa.array, sums.T)], names=["resample", *columns])

    drawn = streams.mapInArrow(draw, "resample int, block int, counts binary")
    parts_ = drawn.groupBy("block").cogroup(numbered.groupBy("block")).applyInArrow(add_up, "resample int, " + ", ".join(f"{c} double" for c in columns))
    return cases, parts_.groupBy("resample").agg(*(F.sum(c).alias(c) for c in columns))


def _interval(statistics: DataFrame, level: float) -> tuple[float, float] | None:
    """Percentiles between the two nearest of the statistics; None with fewer than two."""
    at = [(1 - level) / 2, 1 - (1 - level) / 2]
    r = statistics.where("x IS NOT NULL").agg(F.count("x").alias("n"), F.percentile("x", at).alias("p")).first()
    return tuple(r["p"]) if r["n"] >= 2 else None


def ratio_statistics(samples: DataFrame, resamples: int = RESAMPLES, seed: int = SEED, order: str = "case_id") -> DataFrame:
    """resample and x = sum(num) / sum(den) over the cases that it draws."""
    _, sums = resample_sums(samples, ["num", "den"], [order], resamples, seed)
    return sums.select("resample", ratio(F.col("num"), F.col("den")).alias("x"))


def ratio_interval(samples: DataFrame, resamples: int = RESAMPLES, level: float = LEVEL, seed: int = SEED, order: str = "case_id") -> tuple[float, float] | None:
    """Bootstrap interval of sum(num) / sum(den) over cases; None with fewer than two."""
    return _interval(ratio_statistics(samples, resamples, seed, order), level)


def paired_difference_interval(baseline: DataFrame, candidate: DataFrame, resamples: int = RESAMPLES, level: float = LEVEL, seed: int = SEED) -> tuple[float, float] | None:
    """Bootstrap interval of the candidate's rate less the baseline's, both over the same drawn cases; sides that have other
    cases than each other are an error."""
    if not unmatched(baseline, candidate, ["case_id"]).isEmpty():
        raise ValueError("paired samples are of the same cases")
    both = baseline.select("case_id", "num", "den").join(candidate.select("case_id", F.col("num").alias("num2"), F.col("den").alias("den2")), "case_id")
    _, sums = resample_sums(both, ["num", "den", "num2", "den2"], ["case_id"], resamples, seed)
    return _interval(sums.select((ratio(F.col("num2"), F.col("den2")) - ratio(F.col("num"), F.col("den"))).alias("x")), level)


def latency_comparison(baseline: DataFrame, candidate: DataFrame, replayed: bool = False) -> DataFrame:
    """Mean seconds of both sides; unavailable where one of them replays saved results."""
    mean = lambda df, c: df.agg((F.sum("seconds") / F.count("seconds")).alias(c))
    out = mean(baseline, "before_mean").join(mean(candidate, "after_mean"))  # two rows of one
    if replayed:
        out = out.select(*(F.lit(None).cast("double").alias(c) for c in out.columns))
    return out.withColumn("delta", F.col("after_mean") - F.col("before_mean"))
