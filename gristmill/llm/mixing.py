"""Operator 4: mixing sources to target weights by blocks.

Words of each source, laid end to end, are cut into blocks of BLOCK words; hot sources are laid out in many strips, each
of about STRIP words (at most STRIPS strips). The mix has as many slots as the targets need, in shards of SLOTS
slots. Each shard draws from the multinomial of the target weights how many slots each source gets, conditioned on the
totals (so whole-mix shares come out exactly): counts are halved recursively with draws seeded by the node of the halving,
which lets each shard find its own counts and first slots alone. The j-th slot of a source maps through a keyed
pseudorandom permutation of its block numbers, a new one for each pass over the source; blocks join slots by number.

Sources stand in code-point order, null last, with weights 5, 2, 1 repeating. Targets share all words by weight; one that
exceeds CAP times its source's size stops there, and the excess is shared again. A document gives each of its words at
most CAP times. Null or empty text: size 0, taken 0. Repeated rows and null doc_ids: each row takes part. Ties of equal
rows: any order, they are alike. Very long texts lie in many blocks. A source of size 0 has target 0. Empty table: no
rows. Columns other than doc_id, source and text may have any names. Reruns agree: every draw and permutation depends on
SEED and numbers only. (A shard's draw among 10**9 slots or more, which exceeds the generator, is made by its normal limit.)
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import cycle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut, fresh, one_of_each, release, slices, table, utf8, words

BLOCK = 128
STRIP = 1 << 20
STRIPS = 1 << 24
SLOTS = 4096
CAP = 3
SEED = 17
WEIGHTS = (5.0, 2.0, 1.0)


def targets(sizes: list[int], weights: list[float], cap: float = CAP) -> list[float]:
    """Targets of sources that share the sum of all sizes by weight, none above cap times its size."""
    out, open_ = [0.0] * len(sizes), [k for k, s in enumerate(sizes) if s > 0]
    rest = float(sum(sizes))
    while open_:
        unit = rest / sum(weights[k] for k in open_)
        over = [k for k in open_ if weights[k] * unit > cap * sizes[k]]
        for k in over or open_:
            out[k] = float(cap * sizes[k]) if over else weights[k] * unit
            rest -= out[k] if over else 0
        if not over:
            break
        open_ = [k for k in open_ if k not in over]
    return out


def shard_counts(totals: list[int], shards: int, shard: int, seed: int = SEED) -> tuple[list[int], list[int]]:
    """First slot and number of slots of each source in a shard: multinomial draws, conditioned on the totals."""
    low, high, first, have = 0, shards, np.zeros(len(totals), np.int64), np.array(totals, np.int64)
    size = int(have.sum())
    bound = lambda k: size * k // shards
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng((seed, low, high))
        need, pool, left = bound(middle) - bound(low), int(have.sum()), np.zeros(len(have), np.int64)
        for k, n in enumerate(have.tolist()):  # a multivariate hypergeometric draw, source by source
            pool -= n
            left[k] = _hypergeometric(rng, n, pool, need)
            need -= left[k]
        if shard < middle:
            high, have = middle, left
        else:
            low, first, have = middle, first + left, have - left
    return first.tolist(), have.tolist()


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if good == 0 or draws == 0:
        return 0
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    n = good + bad  # by its normal limit, within the range that the totals allow
    mean = draws * good / n
    sd = (mean * (bad / n) * ((n - draws) / max(n - 1, 1))) ** 0.5
    return int(min(max(round(rng.normal(mean, sd)), draws - bad, 0), good, draws))


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..size-1: a Feistel network on the next even number of bits, walked until inside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng((SEED, key)).integers(0, 1 << 62, 6, dtype=np.uint64)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + k) * np.uint64(0xD6E8FEB86659FD93)
            f ^= f >> np.uint64(32)
            f *= np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ (f >> np.uint64(40)) & mask
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def _draw(batches: Iterator[pa.RecordBatch], totals: list[int], blocks: list[int], shards: int) -> Iterator[pa.RecordBatch]:
    """Slots of shards: shard, slot, source number, pass over the source, block number."""
    for batch in batches:
        for shard in batch.column(0).to_pylist():
            first, count = shard_counts(totals, shards, shard)
            order = np.random.default_rng((SEED, shards, shard)).permutation(sum(count))
            at = 0
            for k, (f, n) in enumerate(zip(first, count, strict=True)):
                j = np.arange(f, f + n, dtype=np.int64)
                turn = j // max(blocks[k], 1)
                block = np.empty(n, np.int64)
                for t in np.unique(turn):
                    on = turn == t
                    block[on] = permuted(j[on] % blocks[k], blocks[k], k * CAP + int(t))
                full = lambda v, t: pa.array(np.full(n, v), t)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [full(shard, pa.int64()), pa.array(order[at : at + n], pa.int64()), full(k, pa.int32()), pa.array(turn, pa.int32()), pa.array(block)],
                    names=["shard", "slot", "source_no", "turn", "block"],
                )
                at += n


def _cut_out(batches: Iterator[pa.RecordBatch], whole: str, begins: str, ends: str) -> Iterator[pa.RecordBatch]:
    """Texts cut to their runs of words, a bounded part of a batch at a time."""
    release()
    for batch in batches:
        for part in slices(batch, "text", 8 << 20):
            data, offsets = utf8(part.column("text"))
            start, end, first = words(data, offsets)
            texts = part.column("text").to_pylist()
            for k in np.flatnonzero(~part.column(whole).to_numpy(zero_copy_only=False)).tolist():
                at = [first[k] + np.array(part.column(c)[k].as_py(), np.int64) for c in (begins, ends)]
                texts[k] = "\n".join(data[x:y].tobytes().decode() for x, y in zip(start[at[0]].tolist(), end[at[1] - 1].tolist(), strict=True))
            part = part.drop_columns([whole, begins, ends])
            yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(texts, part.schema.field("text").type))


class Mix:
    """The mix of docs: its sources, its slots, and the runs of words of documents that fill blocks."""

    def __init__(self, docs: DataFrame, block: int = BLOCK, strip: int = STRIP, slots: int = SLOTS, weights: tuple = WEIGHTS):
        self.spark, self.block = docs.sparkSession, block
        size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("text").alias("same"))
        self.rows = cut(rows)
        sums = self.rows.groupBy("source").agg(F.sum("size").alias("size")).collect()  # one row for each source
        sums.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        self.names, self.sizes = [r["source"] for r in sums], [r["size"] for r in sums]
        self.targets = targets(self.sizes, [w for w, _ in zip(cycle(weights), sums, strict=False)])
        named = [(k, n, s, t, min(max(1, round(s / strip)), STRIPS)) for k, (n, s, t) in enumerate(zip(self.names, self.sizes, self.targets, strict=True))]
        schema = "source_no int, source string, source_size long, target double, strips int"
        self.sources = self.spark.createDataFrame(named, schema)
        self._lay(slots)

    def _lay(self, slots: int) -> None:
        same = self.rows["source"].eqNullSafe(self.sources["source"])
        placed = self.rows.join(self.sources, same).drop(self.sources["source"])  # a row for each source
        placed = placed.withColumn("strip", F.pmod(F.xxhash64("doc_id", "same"), "strips").cast("int"))
        w = Window.partitionBy("source_no", "strip").orderBy("doc_id", "same").rowsBetween(Window.unboundedPreceding, -1)
        self.placed = cut(placed.withColumn("begin", F.coalesce(F.sum("size").over(w), F.lit(0))).drop("strips"))
        # a strip's blocks follow those of the strips before it; strips number the words over STRIP, not the documents
        strips = self.placed.groupBy("source_no", "strip").agg(F.sum("size").alias("words"))
        strips = strips.withColumn("blocks", F.ceil(F.col("words") / self.block).cast("long"))
        before = Window.partitionBy("source_no").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)
        self.strips = strips.withColumn("first_block", F.coalesce(F.sum("blocks").over(before), F.lit(0)))
        counted = {r["source_no"]: r["n"] for r in strips.groupBy("source_no").agg(F.sum("blocks").alias("n")).collect()}
        self.blocks = [counted.get(k, 0) for k in range(len(self.names))]
        mean = [s / b if b else 1.0 for s, b in zip(self.sizes, self.blocks, strict=True)]
        self.totals = [min(round(t / m), CAP * b) for t, m, b in zip(self.targets, mean, self.blocks, strict=True)]
        self.shards = max(1, round(sum(self.totals) / slots))

    def slots(self) -> DataFrame:
        """shard, slot, source_no, turn (pass over the source), block."""
        totals, blocks, shards = self.totals, self.blocks, self.shards
        numbers = self.spark.range(0, shards, 1, min(shards, 10_000))
        return numbers.mapInArrow(lambda batches: _draw(batches, totals, blocks, shards), "shard long, slot long, source_no int, turn int, block long")

    def pieces(self) -> DataFrame:
        """Which words of the row at (source_no, strip, begin) lie in a block: word_begin, word_end."""
        p = self.placed.where("size > 0").join(self.strips.select("source_no", "strip", "first_block"), ["source_no", "strip"])
        n = F.lit(self.block)
        local = F.explode(F.sequence(F.floor(F.col("begin") / n), F.floor((F.col("begin") + F.col("size") - 1) / n))).alias("local")
        p = p.select("source_no", "strip", "size", "begin", "first_block", local)
        lo = F.greatest(F.col("local") * n, F.col("begin")) - F.col("begin")
        hi = F.least((F.col("local") + 1) * n, F.col("begin") + F.col("size")) - F.col("begin")
        return p.select("source_no", "strip", "begin", (F.col("first_block") + F.col("local")).alias("block"), lo.alias("word_begin"), hi.alias("word_end"))

    def filled(self) -> DataFrame:
        """Each slot's runs of words: slots joined to pieces by block number."""
        return self.slots().hint("merge").join(self.pieces(), ["source_no", "block"])

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken of every row."""
        uses = self.slots().groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("uses"))
        pieces = self.pieces().join(uses.hint("merge"), ["source_no", "block"])  # their number grows with the words
        key = ["source_no", "strip", "begin"]  # of rows with words; a strip has one row at each place
        per = pieces.groupBy(*key).agg(F.sum(F.col("uses") * (F.col("word_end") - F.col("word_begin"))).alias("taken"))
        some = self.placed.where("size > 0").join(per, key, "left").select("doc_id", "size", "source_size", "target", "taken")
        none = self.placed.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(None).cast("long").alias("taken"))
        return some.unionByName(none).withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))

    def documents(self, docs: DataFrame) -> DataFrame:
        """Rows of docs as the mix takes them: for each pass over its source, a row with the words taken, cut from the text.

        A row that a pass takes whole keeps its text as it is; of others, the taken runs of words are joined by line breaks.
        Of rows with the same doc_id, source and text, which each take part, any one lends its other columns to all.
        Texts are shuffled once: rows are dealt by short keys, and the runs come to them.
        """
        id_, source, same, whole, begins, ends = names = fresh(docs, "id", "source", "same", "whole", "begins", "ends")
        keys = lambda d, s, h: {id_: F.coalesce(d.cast("long"), F.lit(-(1 << 63))), source: F.coalesce(F.concat(F.lit("s"), s.cast("string")), F.lit("")), same: h}
        place = ["source_no", "strip", "begin"]
        runs = self.filled().groupBy(*place, "turn").agg(F.sort_array(F.collect_list(F.struct("word_begin", "word_end"))).alias("runs"))
        taken = self.placed.where("size > 0").join(runs.hint("merge"), place)
        full = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r.word_end - r.word_begin) == F.col("size")
        taken = taken.select(*(c.alias(n) for n, c in keys(F.col("doc_id"), F.col("source"), F.col("same")).items()), full.alias(whole), F.col("runs.word_begin").alias(begins), F.col("runs.word_end").alias(ends))
        once = one_of_each(docs.withColumns(keys(F.col("doc_id"), F.col("source"), F.xxhash64("text"))), [id_, source, same])
        pieces = once.join(taken.hint("merge"), [id_, source, same]).select(*docs.columns, whole, begins, ends)
        return pieces.mapInArrow(lambda batches: _cut_out(batches, *names[3:]), docs.schema)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(table(spark, sf_dir, "documents")).taken()
