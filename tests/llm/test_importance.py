"""Importance resampling against a serial rendering of its rule."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from gristmill.llm.importance import OP11_SQL, Tournament, checksums, importance_resampling, op11_importance

R = random.Random(3)
VOCABULARY = [*(f"w{k}" for k in range(200)), "éa", "数", "X9", "don't", "a-b", "y" * 300]
LOWER = {c: c + 32 for c in range(65, 91)}


def prose(n):
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


ROWS = [(k, prose(R.randint(0, 90))) for k in range(150)] + [(500, None), (501, ""), (502, " .,\n"), (None, prose(40)), (7, prose(30))]
ROWS += [(600, prose(50))] * 40 + [(601, "Same text with some words " * 6)] * 3
TARGET = [prose(60) + " w1 w2 w3" * 10, None, ""]


def rule(rows, target, longest, n, least, percent):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return words, [" ".join(words[k : k + m]) for m in range(1, longest + 1) for k in range(len(words) - m + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % n
    source, wanted = Counter(bucket(f) for _, t in rows for f in features(t)[1]), Counter(bucket(f) for t in target for f in features(t)[1])
    s, t = sum(source.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + n) / ((source[b] + 1) * (t + n)))) for b in range(n)]
    out, eligible = [], 0
    for k, text in rows:
        words, f = features(text)
        weight = sum(gain[bucket(x)] for x in f)
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        eligible += len(words) >= least
        out.append((len(words) >= least, k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    out.sort(key=lambda r: (not r[0], -r[4], math.inf if r[1] is None else r[1]))
    return [(*r[1:], p + 1 if p < percent * eligible // 100 else None) for p, r in enumerate(out)]


@pytest.mark.parametrize("longest,run,percent", [(1, 1 << 18, 10), (1, 9, 10), (3, 20, 37), (1, 5, 100)])
def test_draw(spark, longest, run, percent):
    schema = "doc_id long, text string, score string, words string"
    docs = spark.createDataFrame([(k, t, "clash", "clash") for k, t in ROWS], schema).repartition(5)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = [tuple(r) for r in importance_resampling(docs, target, longest, 997, percent=percent, run=run).collect()]
    assert sorted(got, key=str) == sorted(rule(ROWS, TARGET, longest, 997, 20, percent), key=str)
    assert importance_resampling(docs.where("false"), target).count() == 0
    assert importance_resampling(docs, target.where("false"), n=50).where("rank IS NOT NULL").count() == len([r for r in rule(ROWS, [], 1, 50, 20, 10) if r[4]])


def test_sql(spark):
    import duckdb

    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    assert sorted(map(tuple, op11_importance(spark, DATA).collect())) == sorted(db.execute(OP11_SQL).fetchall())


def test_tournament():
    runs = [sorted((R.randint(0, 30), k) for _ in range(R.randint(0, 20))) for k in range(7)]
    tree, first = Tournament([iter(r) for r in runs]), []
    for _ in range(25):
        first.append(tree.take())
    assert first == sorted(sum(runs, []))[:25] and sorted([*first, *tree.rest()]) == sorted(sum(runs, []))
    assert Tournament([]).take() is None and Tournament([iter([(1,)])]).take() == (1,)


def test_checksums():
    words = [b"", b"a", b"123456789", b"x" * 500, "数é".encode(), b"q" * 96, b"q" * 97]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    assert checksums(data, ends - [len(w) for w in words], ends).tolist() == [zlib.crc32(w) for w in words]
