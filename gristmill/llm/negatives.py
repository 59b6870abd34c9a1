"""Operator 12: hard negatives by a two-dimensional block matrix multiply.

Anchors and rows are cut into shards in the order of vec_id, and each shard into chunks of DIMENSIONS. Shards of anchors meet
shards of rows in a grid: a task holds some anchors' shards and some rows' shards, adds the inner products of a pair of shards
chunk by chunk, and keeps only the best of each anchor so far. Scores and copies of shards are never written down: rows are
written once and read again by each task that meets them. Two multiplications are made:

1. anchors by rows of the same group of labels, which gives each anchor's first positives;
2. anchors with the windows of their positives by all rows, which gives the first negatives inside each window.

Every anchor meets every row once in 2, in blocks: the anchors are the stated set of queries, so the time grows with anchors
times rows, and the disk with rows. No shard, tile or list grows with the table, whatever the labels are.

Components are floor(256 * x) as long; beyond its range they are its ends, and sums wrap as longs do. Missing components
of shorter vectors count as 0. Rows with a null vec_id, label or vector, or with a null or non-finite component, take no
part. Exact repeats of a row count once; rows that share a vec_id, but not label or vector, are rows of their own, except
that a row with the anchor's vec_id is never its positive or negative. Ties in the score go to the smaller vec_id. Columns
other than vec_id, label and embedding may have any names. Empty table, or no anchors: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table

#: Rows of a shard of anchors and of a shard of rows, and components of a chunk.
ANCHORS, ROWS, DIMENSIONS = 256, 4096, 32
#: Groups that labels are dealt to; each is cut into as many shards as its rows need.
GROUPS = 64
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 50, 95

_SHARD = "group int, ids binary, keys binary, labels binary, windows binary, widths array<int>, numbers array<binary>"
_SHARD_TYPES = [pa.int32(), *[pa.binary()] * 4, pa.list_(pa.int32()), pa.list_(pa.binary())]
_NAMES = [f.split()[0] for f in _SHARD.split(", ")]
_BEST = "anchor_id long, anchor_key long, place long, other_id long, score long"


def usable(vectors: DataFrame, relabel: Column | None = None) -> DataFrame:
    """vec_id, label, numbers (array of long) and key (tells rows with one vec_id apart) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if relabel is None else relabel).cast("long").alias("label"), x.alias("x"))
    finite = F.forall("x", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    v = v.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    v = v.select("vec_id", "label", F.transform("x", lambda x: F.floor(F.lit(256.0) * x)).alias("numbers")).distinct()
    return v.withColumn("key", F.xxhash64("vec_id", "label", "numbers"))


def narrow(x: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers in as few bytes each as hold all of them."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return width, np.ascontiguousarray(x.astype(f"<i{width}")).tobytes()


def wide(width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{width}").astype(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T as int64: with doubles where these are exact."""
    most = a.shape[1] * np.abs(a.astype(np.float64)).max(initial=0) * np.abs(b.astype(np.float64)).max(initial=0)
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    with np.errstate(over="ignore"):
        return a @ b.T


def shard(rows: pa.Table, dimensions: int, length: int) -> list:
    """One shard: its rows' ids, keys, labels and windows, and a block of numbers for each chunk of dimensions."""
    numbers = rows.column("numbers").combine_chunks()
    sizes = numbers.value_lengths().to_numpy(zero_copy_only=False)
    matrix = np.zeros((rows.num_rows, max(1, -(-length // dimensions)) * dimensions), np.int64)
    at = np.repeat(np.arange(rows.num_rows), sizes)
    matrix[at, np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = numbers.flatten().to_numpy(zero_copy_only=False)
    heads = [rows.column(c).to_numpy().astype("<i8").tobytes() for c in ("vec_id", "key", "label")]
    heads.append(rows.column("windows").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<i8").tobytes() if "windows" in rows.column_names else b"")
    chunks = [narrow(matrix[:, k : k + dimensions]) for k in range(0, matrix.shape[1], dimensions)]
    return [rows.column("group")[0].as_py(), *heads, [w for w, _ in chunks], [x for _, x in chunks]]


def shards(rows: DataFrame, size: int, dimensions: int, length: int) -> DataFrame:
    """Shards of at most size rows of one group, whose vec_ids rise from row to row."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        for batch in batches:
            t = pa.table(batch)
            waiting = t if waiting is None else pa.concat_tables([waiting, t])
            while waiting.num_rows > size:
                yield made(waiting.slice(0, size))
                waiting = waiting.slice(size)
        if waiting is not None and waiting.num_rows:
            yield made(waiting)

    def made(t: pa.Table) -> pa.RecordBatch:
        group = t.column("group").to_numpy()
        ends = np.r_[np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)].tolist()
        out = [shard(t.slice(a, b - a), dimensions, length) for a, b in zip([0, *ends], ends, strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), _SHARD_TYPES, strict=True)], names=_NAMES)

    order = ["group", "vec_id", "key"]
    columns = [*order, "label", "numbers", *(c for c in rows.columns if c == "windows")]
    return rows.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut_up, _SHARD)


class Shard:
    """A shard as a task reads it: numbers as floats where the scores that they make are exact in these."""

    def __init__(self, cells: dict, side: str, dimensions: int):
        self.ids, self.keys, self.labels, self.windows = (np.frombuffer(cells[f"{side}_{c}"], "<i8") for c in ("ids", "keys", "labels", "windows"))
        self.chunks = [wide(w, x).reshape(-1, dimensions) for w, x in zip(cells[f"{side}_widths"], cells[f"{side}_numbers"], strict=True)]
        with np.errstate(over="ignore"):
            self.norm = float(np.sqrt(sum((c.astype(np.float64) ** 2).sum(axis=1) for c in self.chunks)).max(initial=0))
        self.floats = {}

    def of(self, kind: type) -> list[np.ndarray]:
        if kind not in self.floats:
            self.floats[kind] = [c.astype(kind) for c in self.chunks]
        return self.floats[kind]


def scores(a: Shard, b: Shard) -> np.ndarray:
    """Inner products of all rows of a with all of b, added chunk by chunk.

    The sum of the products' absolute values is at most the product of both norms, so floats below their range of exact
    whole numbers give the same sums as longs.
    """
    most = a.norm * b.norm
    kind = np.float32 if most < 2.0**23 else np.float64 if most < 2.0**52 else None
    if kind is not None:
        pairs = list(zip(a.of(kind), b.of(kind), strict=True))
        total = pairs[0][0] @ pairs[0][1].T
        for x, y in pairs[1:]:
            total += x @ y.T
        return total
    total = np.zeros((len(a.ids), len(b.ids)), np.int64)
    with np.errstate(over="ignore"):
        for x, y in zip(a.chunks, b.chunks, strict=True):
            total += product(x, y)
    return total


class Best:
    """The best most scores inside each of a shard of anchors' windows so far, ties to the smaller id."""

    def __init__(self, low: np.ndarray, high: np.ndarray, most: int):
        self.low, self.high, self.most = low, high, most
        self.score = np.zeros((len(low), most), np.int64)
        self.id = np.zeros((len(low), most), np.int64)
        self.n = np.zeros(len(low), np.int64)

    def add(self, scores: np.ndarray, fits: np.ndarray | None, ids: np.ndarray) -> None:
        """Takes scores of all anchors with rows of rising ids."""
        if not len(ids) or not len(self.low):
            return
        full = self.n == self.most
        # a score as low as the worst so far needs a smaller id
        worst = self.score[:, -1] + np.where((ids[0] >= self.id[:, -1]) & (self.score[:, -1] < _MOST), 1, 0)
        low = np.where(full, np.maximum(worst, self.low), self.low)
        kind = scores.dtype
        if kind != np.int64:  # scores are whole numbers below the range of kind; beyond it, no bound decides
            edge = 1 << (24 if kind == np.float32 else 53)
            inside = (scores >= np.clip(low, -edge, edge).astype(kind)[:, None]) & (scores <= np.clip(self.high, -edge, edge).astype(kind)[:, None])
        else:
            inside = (scores >= low[:, None]) & (scores <= self.high[:, None])
        if fits is not None:
            inside &= fits
        row, column = np.nonzero(inside)
        if not len(row):
            return
        found, other = scores[row, column].astype(np.int64), ids[column]
        touched = np.unique(row)
        old_row = np.repeat(touched, self.n[touched])
        place = np.arange(len(old_row)) - np.repeat(np.cumsum(self.n[touched]) - self.n[touched], self.n[touched])
        row, found, other = np.r_[row, old_row], np.r_[found, self.score[old_row, place]], np.r_[other, self.id[old_row, place]]
        order = np.lexsort((other, ~found, row))
        row, found, other = row[order], found[order], other[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        count = np.diff(np.r_[first, len(row)])
        place = np.arange(len(row)) - np.repeat(first, count)
        keep = place < self.most
        self.score[row[keep], place[keep]], self.id[row[keep], place[keep]] = found[keep], other[keep]
        self.n[row[first]] = np.minimum(count, self.most)


_MOST, _LEAST = (1 << 63) - 1, -(1 << 63)


class Positives:
    """An anchors' shard's best rows with the anchor's own label."""

    def __init__(self, anchors: Shard, most: int):
        self.anchors = anchors
        self.best = [Best(np.full(len(anchors.ids), _LEAST), np.full(len(anchors.ids), _MOST), most)]

    def add(self, rows: Shard) -> None:
        a = self.anchors
        fits = (a.labels[:, None] == rows.labels) & (a.ids[:, None] != rows.ids)
        if fits.any():
            self.best[0].add(scores(a, rows), fits, rows.ids)


class Negatives:
    """An anchors' shard's best rows with other labels, inside the window of each of its positives."""

    def __init__(self, anchors: Shard, positives: int, most: int, low: int, high: int):
        self.anchors, self.best = anchors, []
        windows = anchors.windows.reshape(len(anchors.ids), 1 + positives)
        for place in range(positives):
            there = windows[:, 0] > place
            bounds = [(-(-low * s // 100), high * s // 100) for s in windows[:, 1 + place].tolist()]  # of any size
            at = [np.array([min(max(b[k], _LEAST), _MOST) for b in bounds], np.int64) for k in (0, 1)]
            empty = ~there | np.array([b[0] > b[1] or b[0] > _MOST or b[1] < _LEAST for b in bounds], bool)
            self.best.append(Best(np.where(empty, 1, at[0]), np.where(empty, 0, at[1]), most))

    def add(self, rows: Shard) -> None:
        a = self.anchors
        found = scores(a, rows)
        fits = (a.labels[:, None] != rows.labels) & (a.ids[:, None] != rows.ids)
        for b in self.best:
            b.add(found, fits, rows.ids)


def meet(anchors: DataFrame, rows: DataFrame, same_group: bool, dimensions: int, start) -> DataFrame:
    """What is best of each anchor among the rows of each part of the grid; start: a state of an anchors' shard."""
    side = lambda df, s: df.select(*(F.col(c).alias(f"{s}_{c}") for c in df.columns))
    a, b = side(anchors, "a"), side(rows, "b")
    pairs = a.hint("shuffle_replicate_nl").join(b, (F.col("a_group") == F.col("b_group")) if same_group else F.lit(True), "inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, shard_ = None, None, None
        for batch in batches:
            for r in range(batch.num_rows):
                cells = {n: batch.column(k)[r] for k, n in enumerate(batch.schema.names)}
                mine = (cells["a_ids"].as_buffer().to_pybytes(), cells["a_keys"].as_buffer().to_pybytes())
                if mine != key:
                    if state is not None:
                        yield best_rows(state)
                    key, shard_ = mine, Shard({n: v.as_py() for n, v in cells.items() if n.startswith("a_")}, "a", dimensions)
                    state = start(shard_)
                state.add(Shard({n: v.as_py() for n, v in cells.items() if n.startswith("b_")}, "b", dimensions))
        if state is not None:
            yield best_rows(state)

    return pairs.mapInArrow(run, _BEST)


def best_rows(state: Positives | Negatives) -> pa.RecordBatch:
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    for place, b in enumerate(state.best):
        row, k = np.nonzero(np.arange(b.most) < b.n[:, None])
        for column, x in zip(out, (state.anchors.ids[row], state.anchors.keys[row], np.full(len(row), place), b.id[row, k], b.score[row, k]), strict=True):
            column.append(x.astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=[f.split()[0] for f in _BEST.split(", ")])


def hard_negatives(
    vectors: DataFrame, anchors: Column, relabel: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    dimensions: int = DIMENSIONS, size: int = ROWS, anchor_size: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors``: a condition on vec_id. ``relabel``: what stands for label, over the columns of vectors.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    v = cut(usable(vectors, relabel).withColumn("group", F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int")))
    asked = v.where(anchors)
    length = v.agg(F.max(F.size("numbers"))).first()[0]
    if length is None or asked.isEmpty():
        return spark.createDataFrame([], schema)
    rows = cut(shards(v, size, dimensions, length))
    found = meet(cut(shards(asked, anchor_size, dimensions, length)), rows, True, dimensions, lambda a: Positives(a, positives))
    w = Window.partitionBy("anchor_id", "anchor_key").orderBy(F.desc("score"), "other_id")  # ``positives`` rows of each part
    found = found.withColumn("place", F.row_number().over(w).cast("long") - 1).where(F.col("place") < positives)
    found = cut(found.select("anchor_id", "anchor_key", "place", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))
    listed = found.groupBy("anchor_id", "anchor_key").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("p"))
    windows = F.concat(F.array(F.size("p").cast("long")), F.transform("p", lambda x: x.positive_score), F.array_repeat(F.lit(0).cast("long"), positives - F.size("p")))
    listed = listed.select(F.col("anchor_id").alias("vec_id"), F.col("anchor_key").alias("key"), windows.alias("windows"))
    asked = cut(shards(asked.join(listed, ["vec_id", "key"]), anchor_size, dimensions, length))
    best = meet(asked, rows, False, dimensions, lambda a: Negatives(a, positives, negatives, low, high))
    w = Window.partitionBy("anchor_id", "anchor_key", "place").orderBy(F.desc("score"), "other_id")  # ``negatives`` rows of each part
    best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives)
    best = best.join(found, ["anchor_id", "anchor_key", "place"])
    return best.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabel = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, relabel)


OP12_SQL = f"""
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS numbers
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: NOT coalesce(isfinite(x), false))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.numbers, b.numbers), lambda p: coalesce(p[1] * p[2], 0))), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score QUALIFY rank <= {NEGATIVES}
"""
