"""Operator 8: scoring by cross-entropy difference.

Two bigram models over one vocabulary, all words of all documents, are counted with the same order and smoothing: the
target model on documents labelled as good, the background model on all documents. A document's score is its loss per token
(nats) under the target model less that under the background model: lower means more like the target. A word is a run of
anything but ASCII white space, in lower case for A-Z; each document ends with an end token, which also stands before its
first word.

P(w | v) = MIX * count(v w) / count(v) + (1 - MIX) * (count(w) + 1) / (tokens + types), without the first term if v was
never seen. Null or empty text: one token, the end. Repeated rows count and are scored each. Without target documents the
target model is uniform over the vocabulary. Empty table: no rows.

Words and bigrams are 64-bit keys. A block of documents sends each of its keys once, with its counts, to the bucket of the
key; the bucket adds up the counts of all blocks and sends each block the totals of its own keys. So no table of a whole
model is held in one place, and a frequent key is one entry of each block. Rows with the same doc_id are in one block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, mix64, shuffle_partitions, slices, table
from .near_dedup import shingles

MIX = 0.7
#: Bytes of text in a block of documents, and in the share of a bucket.
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20

_END = np.uint64(0)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """Words and bigrams of a block's texts: the sorted keys, where each token's are among them, and the texts' offsets."""

    def __init__(self, texts: pa.Table):
        hashes, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for part in slices(texts.select(["text"]), "text", 2 << 20):
            h, bounds = shingles(part.column("text"), 1)
            hashes.append(h)
            counts.append(np.diff(bounds))
        h, words = np.concatenate(hashes), np.concatenate(counts)
        self.bounds = np.r_[0, np.cumsum(words + 1)]
        own = np.ones(self.bounds[-1], bool)
        own[self.bounds[1:] - 1] = False
        token = np.full(len(own), _END)
        token[own] = h
        word, at = np.unique(token, return_inverse=True)
        before = np.r_[np.searchsorted(word, _END), at[:-1]]
        pair, pair_at = np.unique(before * len(word) + at, return_inverse=True)
        one = mix64(word) | np.uint64(1)  # keys of words are odd, of bigrams even
        two = mix64(mix64(word[pair // len(word)]) * _ODD + word[pair % len(word)]) & ~np.uint64(1)
        self.keys, where = np.unique(np.r_[one, two], return_inverse=True)
        self.word, self.pair = where[at], where[len(word) + pair_at]
        self.before = where[before]

    def counts(self, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each key, in all texts and in those that are good."""
        on = np.repeat(good, np.diff(self.bounds))
        count = lambda at: np.bincount(at, minlength=len(self.keys))
        return count(self.word) + count(self.pair), count(self.word[on]) + count(self.pair[on])


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, the first byte of all of them first, compressed, behind their count."""
    raw = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(8, "little") + pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def _numbers(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.decompress(data[8:], 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view("<u8").ravel()


_CELLS = "bucket long, block long, keys binary, background binary, target binary"
_TOTALS = "bucket long, block long, background binary, target binary, types long, tokens long, target_tokens long"
_SCORED = "doc_id long, n_tokens long, loss_target double, loss_background double, score double"


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    types = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([r[k] for r in rows], types[kind]) for k, (name, kind) in enumerate(fields)})


def _cells(docs: pa.Table, good: pa.Table, buckets: int) -> pa.Table:
    """Sorted keys of a block, as differences, and their counts, for each bucket."""
    if not docs.num_rows:
        return _rows([], _CELLS)
    g = Grams(docs)
    counts = g.counts(pc.is_in(docs.column("doc_id"), value_set=good.column("id").combine_chunks()).to_numpy())
    bucket = ((g.keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    block, rows = docs.column("block")[0].as_py(), []
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True):
        rows.append((int(bucket[a]), block, _planes(np.diff(g.keys[a:b], prepend=np.uint64(0))), *(_planes(c[a:b]) for c in counts)))
    return _rows(rows, _CELLS)


def _totals(t: pa.Table, blocks: int) -> pa.Table:
    """For each block, totals of its keys of a bucket; for all blocks, what the bucket adds to types and tokens."""
    cells = [np.cumsum(_numbers(k), dtype=np.uint64) for k in t.column("keys").to_pylist()]
    keys, at = np.unique(np.concatenate(cells), return_inverse=True)
    sums = []
    for c in ("background", "target"):
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, at, np.concatenate([_numbers(x) for x in t.column(c).to_pylist()]).astype(np.int64))
        sums.append(total)
    words = (keys & np.uint64(1)) == 1
    bucket, own = t.column("bucket")[0].as_py(), (int(words.sum()), *(int(s[words].sum()) for s in sums))
    ends = np.cumsum([len(c) for c in cells]).tolist()
    some = {block: [_planes(s[at[b - len(c) : b]]) for s in sums] for block, c, b in zip(t.column("block").to_pylist(), cells, ends, strict=True)}
    none = [_planes(np.empty(0, np.int64))] * 2
    return _rows([(bucket, block, *some.get(block, none), *own) for block in range(blocks)], _TOTALS)


def _scored(docs: pa.Table, totals: pa.Table) -> pa.Table:
    """Losses of a block's documents, from the totals of its keys."""
    if not docs.num_rows:
        return _rows([], _SCORED)
    g, totals = Grams(docs), totals.sort_by("bucket")
    types, n, losses = sum(totals.column("types").to_pylist()), np.diff(g.bounds), []
    for column, tokens in (("target", "target_tokens"), ("background", "tokens")):
        count = np.concatenate([_numbers(x) for x in totals.column(column).to_pylist()]).astype(np.float64)
        unigram = (count[g.word] + 1) / (sum(totals.column(tokens).to_pylist()) + types)
        history = count[g.before]
        p = np.where(history > 0, MIX * count[g.pair] / np.maximum(history, 1) + (1 - MIX) * unigram, unigram)
        losses.append(-np.add.reduceat(np.log(p), g.bounds[:-1]) / n)
    return pa.table([docs.column("doc_id"), pa.array(n), *map(pa.array, losses), pa.array(losses[0] - losses[1])], names=[f.split()[0] for f in _SCORED.split(", ")])


def cross_entropy_difference(docs: DataFrame, good: DataFrame) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score of every row; good: doc_ids of target documents."""
    d = documents(docs)
    total = d.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    least = shuffle_partitions(docs.sparkSession)
    blocks, buckets = max(least, total // BLOCK_BYTES), max(least, total // BUCKET_BYTES)
    block = lambda id_: F.pmod(F.xxhash64(id_), F.lit(blocks)).alias("block")
    by_block = d.select("doc_id", "text", block(F.coalesce("doc_id", F.xxhash64("text")))).groupBy("block")
    ids = good.select(F.col("doc_id").cast("long").alias("id")).where("id IS NOT NULL").distinct()
    cells = by_block.cogroup(ids.select("id", block(F.col("id"))).groupBy("block")).applyInArrow(lambda a, b: _cells(a, b, buckets), _CELLS)
    totals = cells.groupBy("bucket").applyInArrow(lambda t: _totals(t, blocks), _TOTALS)
    return by_block.cogroup(totals.groupBy("block")).applyInArrow(lambda a, b: _scored(a, b), _SCORED)


def op8_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))
