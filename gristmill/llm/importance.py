"""Operator 11: importance resampling towards a target distribution, by hashed features.

A document's features are its runs of 1 to ``longest`` consecutive words, in lower case for A-Z; a feature belongs to the
bucket crc32(feature) % BUCKETS. The gain of a bucket is the logarithm of its share of the target over its share of the
documents, in thousandths, rounded down; a document's weight is the sum of the gains of its features. Its score adds Gumbel
noise from a hash of its doc_id, so that the highest scores are a draw without replacement in proportion to the weights.

1. Counts of buckets: each task adds up its texts in one array, and the arrays' cells are added by bucket. There are BUCKETS
   cells, whatever the input, so the gains are one small array that tasks read weights from.
2. Scores are written down. Among the eligible rows (``least`` words or more) the number to draw is exact, and so are the
   numbers of rows in ranges of scores; the ends of the ranges are quantiles, which need not be exact.
3. Each task sorts its eligible rows into runs, highest score first, cut at the ends of ranges, and writes them down.
   Equal rows are one entry with a count, so a repeated row is no hot spot. A range is merged from its runs by a tournament
   tree. What lies above it is known, so it gives out final ranks, and stops as soon as the draw is full; ranges below the
   draw are not merged at all.

Null or empty text, or one without words: no features, weight 0, not eligible. doc_id null: the hash takes an empty id, and
the row comes after all others with its score. Equal (score, doc_id): repeated rows, each of which takes a rank. Very long
texts are read whole. Columns other than doc_id and text may have any names. Empty table: no rows; empty target: all gains
are against an even target.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, slices, table, utf8

#: Parameters of the draw.
BUCKETS, LONGEST, LEAST, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Rows that a task sorts into one run, and that a range holds at about (48 bytes each).
RUN = 1 << 18
#: Words longer than this get their checksum one by one.
_LONG = 96
#: Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320

_WORD = np.zeros(256, bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NO_ID = (1 << 63) - 1


def _crc_table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(POLYNOMIAL), crc >> 1)
    return crc


_TABLE = _crc_table()


def _step(crc: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _TABLE[(crc ^ byte) & 0xFF] ^ (crc >> np.uint32(8))


def checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of each data[start:end], or of what ``before`` is the checksum of, and then data[start:end]."""
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32) if before is None else ~before
    length = end - start
    order = np.argsort(-length, kind="stable")
    start, crc, length = start[order], crc[order], length[order]
    many = int(np.searchsorted(-length, -_LONG, side="left"))  # so many are longer
    for k in range(many):
        crc[k] = ~np.uint32(zlib.crc32(data[start[k] : start[k] + length[k]].tobytes(), int(~crc[k])))
    start, rest, length = start[many:], crc[many:], length[many:]
    for k in range(int(length[0]) if len(length) else 0):
        n = int(np.searchsorted(-length, -k, side="left"))  # those that have a byte there come first
        rest[:n] = _step(rest[:n], data[start[:n] + k])
    out = np.empty(len(order), np.uint32)
    out[order] = ~crc
    return out


def buckets(texts: pa.Array, longest: int = LONGEST, n: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of texts with the row of each (in any order), and the number of words of each text."""
    data, offsets = utf8(texts)
    data = _LOWER[data]
    own = np.r_[False, _WORD[data], False]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(own[1:-1] & (~own[:-2] | edge[:-1]))
    end = np.flatnonzero(own[1:-1] & (~own[2:] | edge[1:])) + 1
    first = np.searchsorted(start, offsets)
    words = np.diff(first)
    row = np.repeat(np.arange(len(words)), words)
    crc = checksums(data, start, end)
    found, rows = [crc % np.uint32(n)], [row]
    space = np.uint32(32)
    for k in range(1, longest):
        there = np.flatnonzero(row[k:] == row[: len(row) - k])
        crc = ~_step(~crc[there], space)
        crc = checksums(data, start[there + k], end[there + k], crc)
        found.append(crc % np.uint32(n))
        rows.append(row[there])
        full = np.zeros(len(row), np.uint32)
        full[there] = crc
        crc = full
    return np.concatenate(found), np.concatenate(rows), words


def bucket_counts(texts: DataFrame, longest: int, n: int) -> np.ndarray:
    """How many features of all texts fall into each bucket: n numbers, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                total += np.bincount(buckets(part.column("text"), longest, n)[0], minlength=n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(n, np.int64)
    for r in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(h: int) -> int:
    """Gumbel noise in thousandths, from a hash of 32 bits."""
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = "doc_id long, n_features long, weight long, score long, words long"


def scores(docs: DataFrame, gain: np.ndarray, longest: int, seed: int) -> DataFrame:
    """doc_id, n_features, weight, score, words of every row."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                bucket, row, words = buckets(part.column("text"), longest, len(gain))
                features = np.bincount(row, minlength=len(words))
                weight = np.zeros(len(words), np.int64)
                np.add.at(weight, row, gain[bucket])
                out = weight + np.fromiter(map(noise, part.column("h").to_pylist()), np.int64, len(words))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(features), pa.array(weight), pa.array(out), pa.array(words)], names=["doc_id", "n_features", "weight", "score", "words"])

    return docs.withColumn("h", h).select("doc_id", "text", "h").mapInArrow(score, _SCORED)


class Tournament:
    """A tree of losers over sorted runs: the winner is the smallest head of all; taking it replays one path of the tree."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.leaves = 1 << max(0, len(runs) - 1).bit_length()
        self.heads = [next(r, None) for r in runs] + [None] * (self.leaves - len(runs))
        winners = [0] * self.leaves + list(range(self.leaves))
        self.losers = [0] * self.leaves
        for node in range(self.leaves - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._first(a, b) else (b, a)
        self.winner = winners[1] if self.leaves > 1 else 0

    def _first(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and x <= y

    def take(self) -> tuple | None:
        """The next row of all runs."""
        at = self.winner
        head = self.heads[at]
        if head is not None:
            self.heads[at] = next(self.runs[at], None)
            node = (at + self.leaves) >> 1
            while node:
                if not self._first(at, self.losers[node]):
                    at, self.losers[node] = self.losers[node], at
                node >>= 1
            self.winner = at
        return head

    def rest(self) -> Iterator[tuple]:
        """What was not taken, in no order."""
        for head, run in zip(self.heads, self.runs, strict=False):
            if head is not None:
                yield head
                yield from run


_COLUMNS = ("score", "doc_id", "n_features", "weight", "times")
_RUNS = "part int, " + ", ".join(f"{c} binary" for c in _COLUMNS)


def _sorted(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Rows by falling score, then doc_id; equal rows are one with a count (the last column)."""
    order = np.lexsort((columns[3], columns[2], columns[1], -columns[0]))
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    return [*(c[at] for c in columns), np.diff(np.r_[at, len(order)])]


def sorted_runs(batches: Iterator[pa.RecordBatch], ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs of about RUN rows, cut at the ends of the ranges: a row of arrays for each range that a run touches."""

    def run(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = _sorted([np.concatenate(c) for c in zip(*held, strict=True)])
        part = np.searchsorted(ends, -columns[0], side="left")
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        pieces = list(zip(starts.tolist(), [*starts[1:].tolist(), len(part)], strict=True))
        cells = [pa.array([c[a:b].astype("<i8").tobytes() for a, b in pieces], pa.binary()) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(part[starts], pa.int32()), *cells], names=["part", *_COLUMNS])

    held, n = [], 0
    for batch in batches:
        held.append([batch.column(c).fill_null(_NO_ID).to_numpy(zero_copy_only=False) for c in _COLUMNS[:4]])
        n += batch.num_rows
        if n >= RUN:
            yield run(held)
            held, n = [], 0
    if n:
        yield run(held)


_MERGED = "doc_id long, n_features long, weight long, score long, rank long, times long"


def merged(runs: pa.Table, above: np.ndarray, draw: int) -> pa.Table:
    """Rows of a range with their first ranks: ``above[range]`` eligible rows come before it, and ``draw`` of all are drawn."""

    def rows(k: int) -> Iterator[tuple]:
        score, *others = (np.frombuffer(runs.column(c)[k].as_py(), "<i8") for c in _COLUMNS)
        return zip((-score).tolist(), *(c.tolist() for c in others), strict=True)

    out: list[tuple] = []

    def put(row: tuple, rank: int | None, times: int) -> None:
        out.append((None if row[1] == _NO_ID else row[1], row[2], row[3], -row[0], rank, times))

    tree, rank = Tournament([rows(k) for k in range(runs.num_rows)]), int(above[runs.column("part")[0].as_py()]) + 1
    while rank <= draw and (row := tree.take()) is not None:
        drawn = min(row[4], draw - rank + 1)
        put(row, rank, drawn)
        if drawn < row[4]:
            put(row, None, row[4] - drawn)
        rank += drawn
    for row in tree.rest():
        put(row, None, row[4])
    return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[f.split()[0] for f in _MERGED.split(", ")])


def drawn(scored: DataFrame, least: int, percent: int, run: int = RUN) -> DataFrame:
    """Scored rows with rank: 1, 2, 3 ... for the highest ``percent`` of those with ``least`` words or more, else NULL."""
    eligible = scored.where(F.col("words") >= least)
    total = eligible.count()
    draw = percent * total // 100
    plain = ["doc_id", "n_features", "weight", "score"]
    if not draw:
        return scored.select(*plain, F.lit(None).cast("long").alias("rank"))
    n = -(-total // run)
    at = [k / n for k in range(1, n) if k <= n * draw / total + 1]
    ends = sorted(set(eligible.agg(F.percentile_approx(-F.col("score"), at, 10 * n)).first()[0])) if at else []
    part = F.size(F.filter(F.lit(ends).cast("array<long>"), lambda s: s < -F.col("score"))) if ends else F.lit(0)
    counts = {r["part"]: r["count"] for r in eligible.groupBy(part.alias("part")).count().collect()}
    above = np.cumsum([0, *(counts.get(k, 0) for k in range(len(ends)))])
    last = int(np.searchsorted(above, draw, side="left")) - 1  # the draw ends in this range
    in_draw = (F.col("words") >= least) & (part <= last)
    values = np.array(ends, np.int64)
    runs = cut(scored.where(in_draw).mapInArrow(lambda batches: sorted_runs(batches, values), _RUNS))
    ranked = runs.groupBy("part").applyInArrow(lambda t: merged(t, above, draw), _MERGED)
    ranked = ranked.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    out = ranked.select(*plain, (F.col("rank") + F.col("k")).alias("rank"))
    return out.unionByName(scored.where(~in_draw).select(*plain, F.lit(None).cast("long").alias("rank")))


def importance_resampling(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST, n: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED, run: int = RUN
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs; target: a table with a text column."""
    d = documents(docs)
    gain = gains(bucket_counts(d.select("text"), longest, n), bucket_counts(target.select(F.coalesce("text", F.lit("")).alias("text")), longest, n))
    return drawn(cut(scores(d, gain, longest, seed)), least, percent, run)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The checksum is a fold over the bytes of each distinct word, with a table made by the rule above.
OP11_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT b AS byte, b AS crc, 0 AS k FROM range(256) t(b)
  UNION ALL SELECT byte, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, {POLYNOMIAL}) ELSE crc >> 1 END, k + 1 FROM bits WHERE k < 8),
crcs AS (SELECT list(crc ORDER BY byte) AS tab FROM bits WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
s AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM d) GROUP BY word),
t AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM b) GROUP BY word),
v AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM s UNION SELECT word FROM t)),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
  lambda crc, byte: xor(crc >> 8, tab[(xor(crc, byte) & 255) + 1])), 4294967295::BIGINT) % {BUCKETS} AS bucket FROM v, crcs),
sums AS (SELECT bucket, coalesce(sum(s.n), 0) AS s, coalesce(sum(t.n), 0) AS t FROM hashed LEFT JOIN s USING (word) LEFT JOIN t USING (word) GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {BUCKETS}) / ((s + 1)::DOUBLE * (sum(t) OVER () + {BUCKETS})))) AS BIGINT) AS gain FROM sums),
terms AS (SELECT doc_id, unnest(words) AS word FROM d),
weights AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM terms JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT d.doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST} ORDER BY score DESC, doc_id) AS place, sum((n_features >= {LEAST})::INTEGER) OVER () AS eligible FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST} AND place <= {PERCENT} * eligible // 100 THEN place END AS rank FROM ranked
"""
