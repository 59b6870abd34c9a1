"""Hard negatives against all inner products, one by one."""

import math
import random

import duckdb
import numpy as np
import pytest
from conftest import DATA
from gristmill.llm.negatives import OP12_SQL, hard_negatives, narrow, op12_hard_negatives, product, wide
from pyspark.sql import functions as F

R = random.Random(8)


def vector(n=9):
    return [R.choice([R.gauss(0, 1), R.gauss(1, 0.3)]) for _ in range(n)]


SAME = vector()
ROWS = [(k, R.choice([0, 0, 0, 0, 1, 2, 3, 44, -5]), vector()) for k in range(300)]
ROWS += [(1000 + k, k % 3, SAME) for k in range(12)] + [(2000 + k, 1, [0.0] * 9) for k in range(3)]  # ties, equal and zero vectors
ROWS += [(3000, None, SAME), (3001, 1, None), (3002, 1, [1.0, None]), (3003, 1, [float("nan")] * 9), (3004, 1, [float("inf")] * 9), (None, 1, SAME)]
ROWS += [(4000, 1, vector(5)), (4001, 0, []), (4002, 9, vector()), (4005, 1, vector(12))]  # other lengths, a label of one row
ROWS += [(5000, 0, SAME)] * 4 + [(5000, 1, SAME), (6, 2, vector())]  # repeats, and ids with two rows


def rule(rows, anchor, positives=5, negatives=3, low=50, high=95):
    seen = {(k, label, tuple(math.floor(256 * x) for x in v)) for k, label, v in rows if k is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for k, label, v in sorted(seen):
        if anchor(k):
            near = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i, m != label) for i, m, w in seen if i != k)
            for s, i, _ in [x for x in near if not x[2]][:positives]:
                inside = [x for x in near if x[2] and low * -s <= 100 * -x[0] <= high * -s]
                out += [(k, i, r + 1, x[1], -s, -x[0]) for r, x in enumerate(inside[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("dimensions,size,anchor_size", [(4, 16, 3), (32, 4096, 256)])
def test_negatives(spark, dimensions, size, anchor_size):
    rows = [(k, label, v, "clash", "clash") for k, label, v in ROWS]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, numbers string, shard string").repartition(4)
    got = hard_negatives(df, F.col("vec_id") % 3 == 0, dimensions=dimensions, size=size, anchor_size=anchor_size)
    want = rule(ROWS, lambda k: k % 3 == 0)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 500
    assert hard_negatives(df.where("false"), F.col("vec_id") % 3 == 0).count() == 0
    assert hard_negatives(df, F.col("vec_id") < 0).count() == 0
    assert hard_negatives(df.where("vec_id = 4002"), F.col("vec_id") % 3 == 0).count() == 0


def test_huge_components(spark):
    """Components beyond long are cut to its ends, and nothing crashes."""
    df = spark.createDataFrame([(k, k % 2, [1e300 * (k - 3), 2.0**40]) for k in range(8)], "vec_id long, label int, embedding array<double>")
    assert hard_negatives(df, F.col("vec_id") < 3).count() >= 0


def test_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    got = sorted(map(tuple, op12_hard_negatives(spark, DATA).collect()))
    assert got == sorted(db.execute(OP12_SQL).fetchall()) and got


def test_numbers():
    for x in ([], [0], [127, -128], [128], [-(1 << 31)], [1 << 31, 5], [-(1 << 63)]):
        x = np.array(x, np.int64)
        assert wide(*narrow(x)).tolist() == x.tolist()
    a = np.array([[1 << 40, 3]], np.int64)
    assert product(a, a).tolist() == [[((1 << 80) + 9) % (1 << 64)]] and product(a // (1 << 20), a).tolist() == [[1 << 60]]
