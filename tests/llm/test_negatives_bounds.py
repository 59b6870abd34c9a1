"""What a run of op12 writes down, and its tiles and windows where numbers are of odd sizes."""

import os
import random

import numpy as np
from gristmill.llm import negatives as ng
from pyspark.sql import functions as F

R = random.Random(4)


def written(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def test_disk(spark, tmp_path, monkeypatch):
    """What is written grows with the rows, not with anchors times rows: scores and copies of shards are not."""
    gen = np.random.default_rng(2)
    got = []
    for n in (1000, 4000):
        monkeypatch.setattr(ng, "cut", lambda df, n=n: (df.write.mode("append").parquet(f"{tmp_path}/{n}/{len(os.listdir(tmp_path / str(n))) if (tmp_path / str(n)).exists() else 0}"), spark.read.schema(df.schema).parquet(f"{tmp_path}/{n}/{len(os.listdir(tmp_path / str(n))) - 1}"))[1])
        df = spark.createDataFrame([(k, k % 5, v) for k, v in enumerate(gen.normal(size=(n, 16)).tolist())], "vec_id long, label int, embedding array<double>")
        out = ng.hard_negatives(df, F.col("vec_id") % 4 == 0, anchor_size=64, size=256)
        plan = out._jdf.queryExecution().toString()
        assert "CartesianProduct" in plan and "FlatMapCoGroupsInArrow" not in plan
        assert out.count() > 100
        got.append(written(tmp_path / str(n)))
    assert got[1] < 5 * got[0]  # 16 times the scores


def cells(ids, labels, x, windows=b""):
    chunks = [ng.narrow(x[:, k : k + 4]) for k in range(0, x.shape[1], 4)]
    of = lambda v: np.array(v, "<i8").tobytes()
    return {"s_ids": of(ids), "s_keys": of(ids), "s_labels": of(labels), "s_windows": windows, "s_widths": [w for w, _ in chunks], "s_numbers": [b for _, b in chunks]}


def test_scores_of_any_size():
    """Floats where they are exact, longs that wrap elsewhere."""
    for most in (3, 1 << 11, 1 << 12, 1 << 25, 1 << 40):
        a, b = (np.array([[R.randint(-most, most) for _ in range(8)] for _ in range(9)], np.int64) for _ in range(2))
        got = ng.scores(*(ng.Shard(cells(range(9), [0] * 9, x), "s", 4) for x in (a, b)))
        want = [[(sum(int(p) * int(q) for p, q in zip(x, y, strict=True)) + (1 << 63)) % (1 << 64) - (1 << 63) for y in b] for x in a]
        assert got.astype(np.int64).tolist() == want


def test_best_over_many_shards():
    """Ties go to smaller ids, whichever order shards come in, and bounds hold."""
    low, high = np.array([-3, 0, 1, -(1 << 63)]), np.array([3, 1 << 62, 0, (1 << 63) - 1])
    for kind in (np.float32, np.float64, np.int64):
        best, seen = ng.Best(low, high, 3), []
        for start in R.sample(range(0, 200, 10), 20):
            score = np.array([[R.randint(-5, 5) for _ in range(10)] for _ in low])
            best.add(score.astype(kind), None, np.arange(start, start + 10))
            seen.append((start, score))
        for r in range(len(low)):
            every = sorted((-int(s[r, k]), at + k) for at, s in seen for k in range(10) if low[r] <= s[r, k] <= high[r])[:3]
            assert [(-int(s), int(i)) for s, i in zip(best.score[r, : best.n[r]], best.id[r, : best.n[r]], strict=True)] == every
