"""Operator 5: best-fit-decreasing packing of documents into fixed windows.

Documents are dealt by doc_id to partitions; each partition packs on its own, a bounded number of tokens at a time. A
document longer than a window is first cut into full windows. The rests are taken from the longest to the shortest, and
each goes to the open window with the least room that still holds it, which a segment tree over remaining room finds.
A sequence whose length is a power of two needs no padding; all others are padded to the window.
Null or empty text: a piece of the end id alone. Repeated rows: each is packed; rows with a null doc_id are dealt by their
text. Ties in length: in the order of doc_id, then text. Columns other than doc_id and text may have any names. Empty
table: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, table
from .tokens import default_tokenizer, ids_of

WINDOW = 1024
#: Tokens that a task packs together; more lowers padding a little and takes 4 bytes each.
TOGETHER = 24 << 20

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class OpenWindows:
    """Open windows by remaining room; a leaf of the tree counts the windows with that room, an inner node those below."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, n: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += n
            node >>= 1

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._add(room, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out the window with the least room that holds need: (room, window)."""
        count, node = self.count, need + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.windows[room].pop()


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """Window and offset of each length (at most window each), and the number of windows."""
    windows, offsets, opened = [0] * len(lengths), [0] * len(lengths), 0
    tree = OpenWindows(window)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = tree.tightest(lengths[k])
        room, w = found or (window, opened)
        opened += found is None
        windows[k], offsets[k] = w, window - room
        if room > lengths[k]:
            tree.put(room - lengths[k], w)
    return windows, offsets, opened


def _pieces(docs: list[tuple[int | None, bytes]], sequence: int, window: int) -> tuple[pa.RecordBatch, int]:
    rows, rests = [], []
    for doc_id, ids in docs:
        n = len(ids) // 4
        full = n - n % window
        for start in range(0, full, window):
            rows.append((doc_id, start, window, n, sequence, 0, ids[4 * start : 4 * (start + window)]))
            sequence += 1
        if n > full:
            rests.append((doc_id, full, n - full, n, ids[4 * full :]))
    windows, offsets, opened = best_fit([r[2] for r in rests], window)
    rows += [(*r[:4], sequence + w, o, r[4]) for r, w, o in zip(rests, windows, offsets, strict=True)]
    c = list(zip(*rows, strict=True))
    numbers = [*c[:3], [zlib.crc32(x) for x in c[6]], *c[3:6]]
    arrays = [*(pa.array(a, pa.int64()) for a in numbers), pa.array(c[6], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in SCHEMA.split(", ")]), sequence + opened


def _partition(batches: Iterator[pa.RecordBatch], tokenizer: str, window: int, together: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    sequence, waiting, held = TaskContext.get().partitionId() << 40, [], 0
    for batch in batches:
        for doc_id, ids in ids_of(batch, tokenizer):
            waiting.append((doc_id, ids))
            held += len(ids) // 4
            if held >= together:
                out, sequence = _pieces(waiting, sequence, window)
                yield from _batches(out)
                waiting, held = [], 0
    if waiting:
        yield from _batches(_pieces(waiting, sequence, window)[0])


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, together: int = TOGETHER) -> DataFrame:
    """Pieces of documents with their place in a sequence; ids are little-endian unsigned 32-bit numbers."""
    tokenizer = tokenizer or default_tokenizer()
    dealt = documents(docs).repartition(F.coalesce("doc_id", F.xxhash64("text"))).sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(lambda batches: _partition(batches, tokenizer, window, together), SCHEMA)


def _batches(batch: pa.RecordBatch, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def padded_length(length: int, window: int = WINDOW) -> int:
    """Length of a sequence with its padding."""
    return length if length & (length - 1) == 0 else window


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("ids")


