"""Operator 1: repeated strings between documents, found in suffix order.

Every byte covered by a LENGTH-byte string that also starts in a document with a smaller doc_id is removed. Texts are cut
into fragments: a run of strings (windows of LENGTH bytes) whose smallest seed (hash of SEED bytes) is the same one, so
equal strings always lie in fragments with equal seeds, wherever they are. Seeds that two documents share are found first;
fragments with such a seed go, equal ones once for each block of documents, to the bucket of their seed. There the
collection is sorted column by column: each round inserts one symbol of every fragment, from its end to its start, into
the Burrows-Wheeler transform of the collection and the lengths of common prefixes of neighbours, which lie in external
files that each round reads and writes in sequence. Neighbours with common prefixes of LENGTH or more start with the same
string; the smallest doc_id among them decides. A fragment whose seed has no other fragment needs no sorting. Fragments of
a seed that very many have (a common line in ever other surroundings) are cut into single strings, which are dealt by
their own hash and sorted there, so that no bucket grows with such a seed. Fragments and strings are told apart by 64-bit
keys of their bytes until they are sorted.

Very long texts are cut like others. Columns other than doc_id and text may have any names; repeated rows are rows of one
document. Null or empty text: nothing to remove, sha256 of no bytes. Texts shorter than LENGTH stay whole. Rows with the same
doc_id do not remove each other's bytes. A null doc_id counts as larger than all others. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from pathlib import Path
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, gram_hash, mix64, pack_rows, shuffle_partitions, table, utf8

LENGTH = 50
SEED = 24
#: Strings of a fragment at most; a longer run is cut.
RUN = 50
WIDTH = LENGTH + RUN - 1
#: Bytes of text in a block of documents, and in the share of a bucket.
BLOCK_BYTES = 2 << 20
BUCKET_BYTES = 8 << 20
#: Fragments of one seed, about, beyond which each of their strings goes to the bucket of its own hash.
HOT = 1 << 15
#: Fragments of a collection, about; those of one seed stay together.
COLLECTION = 1 << 12

_LAST = (1 << 63) - 1


class Fragments:
    """Fragments of a block's documents: seed, start in the block's bytes, number of strings, document's row."""

    def __init__(self, texts: pa.ChunkedArray):
        self.data, self.offsets = utf8(texts)
        n = len(self.data) - LENGTH + 1
        if n <= 0:
            self.seed, self.start, self.strings, self.row = np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
            return
        low = gram_hash(self.data, SEED)
        done, span = 1, LENGTH - SEED + 1
        while done < span:  # the smallest of ever longer runs of seeds
            step = min(done, span - done)
            low = np.minimum(low[:-step], low[step:])
            done += step
        size = np.diff(self.offsets)
        on = np.flatnonzero(size >= LENGTH)
        valid = np.zeros(n + 1, np.int8)
        valid[self.offsets[on]] = 1
        valid[self.offsets[on] + size[on] - LENGTH + 1] -= 1
        low[np.cumsum(valid[:n], dtype=np.int8) == 0] = 0
        first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        length = np.diff(np.r_[first, n])
        keep = low[first] != 0
        first, length = first[keep], length[keep]
        parts = -(-length // RUN)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        self.start = np.repeat(first, parts) + k * RUN
        self.strings = np.minimum(np.repeat(length, parts) - k * RUN, RUN)
        self.seed = low[self.start]
        self.row = np.searchsorted(self.offsets, self.start, side="right") - 1

    def take(self, keep: np.ndarray) -> Fragments:
        self.seed, self.start, self.strings, self.row = self.seed[keep], self.start[keep], self.strings[keep], self.row[keep]
        return self

    def single(self, on: np.ndarray) -> np.ndarray:
        """Cuts these fragments into single strings; returns which of the fragments are now such a string."""
        times = np.where(on, self.strings, 1)
        k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        self.take(np.repeat(np.arange(len(on)), times))
        on = np.repeat(on, times)
        self.start = self.start + k
        self.strings = np.where(on, 1, self.strings)
        return on

    def contents(self) -> np.ndarray:
        """Bytes of each fragment, plus one and filled up with zeros, which no byte of UTF-8 becomes."""
        at = self.start[:, None] + np.arange(WIDTH)
        inside = np.arange(WIDTH) < (self.strings + LENGTH - 1)[:, None]
        return np.where(inside, self.data[np.minimum(at, len(self.data) - 1)] + np.uint8(1), np.uint8(0))


def content_keys(contents: np.ndarray) -> np.ndarray:
    """A 64-bit key of each row of bytes."""
    wide = np.zeros((len(contents), -(-WIDTH // 8) * 8), np.uint8)
    wide[:, :WIDTH] = contents
    h = np.full(len(contents), 1, np.uint64)
    for column in wide.view(np.uint64).T:
        h = mix64(h ^ column)
    return h


def sort_collection(contents: np.ndarray, lengths: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of a collection and common prefixes of neighbouring suffixes, symbol by symbol.

    Rows hold symbols 1 to 255, from the left; 0 is the end, and ends of different rows differ. The files in folder hold
    the transform and the prefix lengths after each round. They only grow, and are written over in place: a file that is
    truncated before it is written again can go to the disk each time it is closed.
    """
    with open(Path(folder) / "transform", "w+b") as transforms, open(Path(folder) / "prefixes", "w+b") as prefixes:
        return _inserted(contents, lengths, (transforms, prefixes))


def _read(files: tuple[BinaryIO, BinaryIO]) -> tuple[np.ndarray, np.ndarray]:
    for f in files:
        f.seek(0)
    return tuple(np.fromfile(f, np.uint8) for f in files)


def _write(file: BinaryIO, data: np.ndarray) -> None:
    file.seek(0)
    data.tofile(file)


def _inserted(contents: np.ndarray, lengths: np.ndarray, files: tuple[BinaryIO, BinaryIO]) -> tuple[np.ndarray, np.ndarray]:
    m = len(contents)
    rows = np.arange(m)
    _write(files[0], contents[rows, lengths - 1])
    _write(files[1], np.zeros(m, np.uint8))
    at, active = rows.copy(), rows
    for done in range(1, int(lengths.max()) + 1):
        active = active[lengths[active] >= done]
        transform, prefix = _read(files)
        t = len(transform)
        by_symbol = np.argsort(transform, kind="stable")
        ends = np.searchsorted(transform[by_symbol], 1)
        pending = np.zeros(t, bool)
        pending[at[active]] = True
        new = np.flatnonzero(pending[by_symbol])
        new = new[new >= ends]
        place = by_symbol[new]
        order = np.argsort(at[active])
        owner = active[order][np.searchsorted(at[active][order], place)]
        # a suffix's neighbours with the same first symbol came from the nearest rows with that symbol
        symbol = transform[place]
        before, after = by_symbol[new - 1], by_symbol[np.minimum(new + 1, t - 1)]
        has_before = (new > ends) & (transform[before] == symbol)
        has_after = (new + 1 < t) & (transform[after] == symbol) & ~pending[after]
        runs = np.r_[prefix, np.uint8(255)]

        def least(low: np.ndarray, high: np.ndarray, runs: np.ndarray = runs) -> np.ndarray:
            """Smallest prefix in rows low + 1 to high."""
            return np.minimum.reduceat(runs, np.column_stack([low + 1, high + 1]).ravel())[::2] if len(low) else np.empty(0, np.uint8)

        own = np.zeros(len(new), np.uint8)
        own[has_before] = least(before[has_before], place[has_before]) + np.uint8(1)
        behind = least(place[has_after], after[has_after]) + np.uint8(1)
        row = m + new - ends
        old = np.ones(t + len(new), bool)
        old[row] = False
        left = lengths[owner] - done - 1
        grown = np.empty(t + len(new), np.uint8)
        grown[old] = transform
        grown[row] = np.where(left >= 0, contents[owner, left], 0)
        _write(files[0], grown)
        grown[old] = prefix
        grown[row] = own
        grown[row[has_after] + 1] = behind
        _write(files[1], grown)
        at[owner] = row
    return _read(files)


def smallest_by_string(contents: np.ndarray, lengths: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each string of each row, the smallest doc of all rows that hold the string; columns are strings' starts."""
    with tempfile.TemporaryDirectory() as folder:
        transform, prefix = sort_collection(contents, lengths, folder)
    m, ends = len(contents), int((transform == 0).sum())
    back = np.empty(len(transform), np.int64)
    back[np.argsort(transform, kind="stable")] = np.arange(len(transform)) + m - ends
    group = np.cumsum(prefix < LENGTH) - 1
    starts = np.flatnonzero(prefix < LENGTH)
    docs = np.full(len(transform), _LAST, np.int64)
    where = np.full((m, RUN), -1, np.int64)
    at, active = np.arange(m), np.arange(m)
    for done in range(1, int(lengths.max()) + 1):
        active = active[lengths[active] >= done]
        at[active] = back[at[active]]
        if done >= LENGTH:
            docs[at[active]] = doc[active]
            where[active, lengths[active] - done] = at[active]
    least = np.minimum.reduceat(docs, starts)
    return np.where(where >= 0, least[group[where]], _LAST)


def collections(seed: np.ndarray, which: np.ndarray) -> list[np.ndarray]:
    """These fragments, those of one seed together, in parts of about COLLECTION: equal strings have equal seeds."""
    which = which[np.argsort(seed[which], kind="stable")]
    starts = np.flatnonzero(np.r_[True, seed[which][1:] != seed[which][:-1]]) if len(which) else np.empty(0, np.int64)
    part = starts // COLLECTION
    return np.split(which, starts[1:][part[1:] != part[:-1]]) if len(which) else []


def _squeezed(parts: Iterator[tuple[int, list[bytes]]]) -> Iterator[tuple[int, list[bytes]]]:
    """The columns of each part compressed, each behind its length."""
    for part, columns in parts:
        yield part, [len(c).to_bytes(8, "little") + pa.compress(c, codec="zstd", asbytes=True) for c in columns]


def _opened(column: pa.ChunkedArray) -> list[bytes]:
    return [pa.decompress(c[8:], int.from_bytes(c[:8], "little"), codec="zstd", asbytes=True) for c in column.to_pylist()]


def _short(seed: np.ndarray) -> np.ndarray:
    """The upper six bytes of seeds, which tell whether they are shared; a false alarm only sends a fragment along."""
    return np.ascontiguousarray(seed.astype("<u8")[:, None].view(np.uint8)[:, 2:]).view("V6").ravel()


def _whole(column: pa.ChunkedArray) -> np.ndarray:
    """Six-byte seeds as numbers."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    return wide.view("<u8").ravel()


def _table(columns: dict[str, list], types: dict[str, pa.DataType]) -> pa.Table:
    return pa.table({k: pa.array(columns[k], t) for k, t in types.items()})


_SEEDS = {"bucket": pa.int64(), "block": pa.int64(), "seeds": pa.binary(), "marks": pa.binary()}
_SHARED = {"block": pa.int64(), "seeds": pa.binary(), "hot": pa.binary()}
_FRAGMENTS = {"bucket": pa.int64(), "block": pa.int64(), "seeds": pa.binary(), "strings": pa.binary(), "contents": pa.binary(), "docs": pa.binary(), "several": pa.binary(), "hot": pa.binary()}
_RUNS = {"block": pa.int64(), "runs": pa.binary()}
_OUT = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "spans": pa.list_(pa.int64())}
_RUN = np.dtype([("seed", "<u8"), ("key", "<u8"), ("begin", "u1"), ("end", "u1"), ("hot", "?"), ("doc", "<i8")])


def _schema(types: dict[str, pa.DataType]) -> str:
    names = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{k} {names[t]}" for k, t in types.items())


def _rows(parts: Iterator, types: dict[str, pa.DataType], block: int) -> pa.Table:
    out: dict[str, list] = {k: [] for k in types}
    for part, columns in parts:
        for k, v in zip(types, [part, block, *columns], strict=True):
            out[k].append(v)
    return _table(out, types)


def _seeds(docs: pa.Table, buckets: int) -> pa.Table:
    """Each bucket's seeds of a block; a byte tells whether several of the block's documents have the seed, and about how
    many fragments (eight times the logarithm to base 2)."""
    f, ids = Fragments(docs.column("text")), docs.column("id").to_numpy()
    block = docs.column("block")[0].as_py()
    order = np.argsort(f.seed, kind="stable")
    seed, doc = f.seed[order], ids[f.row[order]]
    high = seed >> np.uint64(16)
    starts = np.flatnonzero(np.r_[True, high[1:] != high[:-1]]) if len(seed) else np.empty(0, np.int64)
    several = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts) if len(starts) else np.empty(0, bool)
    size = np.minimum(np.ceil(8 * np.log2(np.diff(np.r_[starts, len(seed)]))), 127).astype(np.uint8)
    seed = seed[starts]
    return _rows(pack_rows((seed >> np.uint64(20)) % np.uint64(buckets), [_short(seed), size << 1 | several]), _SEEDS, block)


def _joined(t: pa.Table, column: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(column).to_pylist()), dtype)


def _shared(t: pa.Table, hot: int) -> pa.Table:
    """Seeds of a bucket that two documents share, by block, and which of them have more than hot fragments."""
    seed, mark = _whole(t.column("seeds")), _joined(t, "marks", np.uint8)
    block = np.repeat(t.column("block").to_numpy(), [len(s) // 6 for s in t.column("seeds").to_pylist()])
    order = np.argsort(seed, kind="stable")
    seed, mark, block = seed[order], mark[order], block[order]
    starts = np.flatnonzero(np.r_[True, seed[1:] != seed[:-1]])
    count = np.diff(np.r_[starts, len(seed)])
    shared = np.repeat((count > 1) | np.bitwise_or.reduceat(mark & 1, starts).astype(bool), count)
    many = np.repeat(np.add.reduceat(2.0 ** ((mark >> 1) / 8), starts) > hot, count)
    parts = list(pack_rows(block[shared], [_short(seed[shared] << np.uint64(16)), many[shared]]))
    return _table({"block": [p for p, _ in parts], "seeds": [c[0] for _, c in parts], "hot": [c[1] for _, c in parts]}, _SHARED)


def _fragments(docs: pa.Table, seeds: pa.Table, buckets: int) -> pa.Table:
    """Distinct fragments of a block that have shared seeds, for their buckets; strings of hot seeds, for those of their hash."""
    if not docs.num_rows or not seeds.num_rows:
        return _rows(iter(()), _FRAGMENTS, 0)
    f = Fragments(docs.column("text"))
    shared, many = _whole(seeds.column("seeds")), _joined(seeds, "hot", bool)
    f.take(np.isin(f.seed >> np.uint64(16), shared))
    hot = f.single(np.isin(f.seed >> np.uint64(16), shared[many]))
    doc = docs.column("id").to_numpy()[f.row]
    contents = f.contents()
    key = content_keys(contents)
    order = np.lexsort((doc, key))
    starts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    first = order[starts]
    several = doc[order[np.r_[starts[1:], len(order)] - 1]] != doc[first]
    columns = [f.seed[first], f.strings[first].astype(np.uint8), contents[first], doc[first], several, hot[first]]
    bucket = np.where(hot, key >> np.uint64(20), f.seed >> np.uint64(20))[first] % np.uint64(buckets)
    return _rows(_squeezed(pack_rows(bucket, columns)), _FRAGMENTS, docs.column("block")[0].as_py())


def _sorted(t: pa.Table) -> pa.Table:
    """For each block, runs of strings of its fragments with the smallest doc_id that has them."""
    each = _opened(t.column("strings"))
    block = np.repeat(t.column("block").to_numpy(), [len(s) for s in each])
    strings = np.frombuffer(b"".join(each), np.uint8)
    kinds = (("seeds", np.uint64), ("docs", np.int64), ("several", bool), ("hot", bool), ("contents", np.uint8))
    seed, doc, several, hot, contents = (np.frombuffer(b"".join(_opened(t.column(c))), d) for c, d in kinds)
    contents = contents.reshape(-1, WIDTH)
    key = content_keys(contents)
    _, first, same = np.unique(key, return_index=True, return_inverse=True)
    least = np.full(len(first), _LAST, np.int64)
    np.minimum.at(least, same, doc)
    owners, count = np.unique(seed[first], return_counts=True)
    alone = count[np.searchsorted(owners, seed[first])] == 1
    smallest = np.where(np.arange(RUN) < strings[first].astype(np.int64)[:, None], least[:, None], _LAST)
    for many in collections(seed[first], np.flatnonzero(~alone)):
        at = first[many]
        smallest[many] = smallest_by_string(contents[at], strings[at].astype(np.int64) + LENGTH - 1, least[many])
    mine = smallest[same]
    inside = np.arange(RUN) < strings.astype(np.int64)[:, None]
    useful = inside & ((mine < doc[:, None]) | several[:, None])
    begins = useful & np.column_stack([np.ones(len(mine), bool), (mine[:, 1:] != mine[:, :-1]) | ~useful[:, :-1]])
    ends = useful & np.column_stack([(mine[:, 1:] != mine[:, :-1]) | ~useful[:, 1:], np.ones(len(mine), bool)])
    row, begin = np.nonzero(begins)
    runs = np.empty(len(row), _RUN)
    runs["seed"], runs["key"], runs["begin"], runs["end"], runs["hot"], runs["doc"] = seed[row], key[row], begin, np.nonzero(ends)[1] + 1, hot[row], mine[row, begin]
    parts = list(pack_rows(block[row], [runs]))
    return _table({"block": [p for p, _ in parts], "runs": [c[0] for _, c in parts]}, _RUNS)


def _applied(docs: pa.Table, found: pa.Table) -> pa.Table:
    """Removes what the runs cover from a block's documents."""
    ids = docs.column("id").to_numpy()
    if found.num_rows:
        f = Fragments(docs.column("text"))
        runs = np.sort(_joined(found, "runs", _RUN), order="key")
        f.take(np.isin(f.seed, runs["seed"]))
        f.single(np.isin(f.seed, runs["seed"][runs["hot"]]))
        key, doc = content_keys(f.contents()), ids[f.row]
        low, high = (np.searchsorted(runs["key"], key, side=s) for s in ("left", "right"))
        fragment = np.repeat(np.arange(len(key)), high - low)
        run = runs[np.arange(len(fragment)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[fragment]]
        hit = run["doc"] < doc[fragment]
        start, run = f.start[fragment[hit]], run[hit]
        edge = np.zeros(len(f.data) + 1, np.int32)
        np.add.at(edge, start + run["begin"], 1)
        np.add.at(edge, start + run["end"] - 1 + LENGTH, -1)
        data, offsets, covered = f.data, f.offsets, np.cumsum(edge[:-1]) > 0
    else:
        data, offsets = utf8(docs.column("text"))
        covered = np.zeros(len(data), bool)
    out: dict[str, list] = {k: [] for k in _OUT}
    for doc_id, a, b in zip(ids.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        gone = covered[a:b]
        step = np.diff(np.r_[False, gone, False].astype(np.int8))
        spans = np.column_stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)])
        kept = data[a:b][~gone] if len(spans) else data[a:b]
        values = (None if doc_id == _LAST else doc_id, b - a, b - a - len(kept), len(spans), hashlib.sha256(kept.tobytes()).hexdigest(), spans.ravel().tolist())
        for k, v in zip(_OUT, values, strict=True):
            out[k].append(v)
    return _table(out, _OUT)


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (begins and ends of removed runs, by turns) of every row."""
    spark = docs.sparkSession
    d = documents(docs).select(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), "text")
    total = d.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    least = shuffle_partitions(spark)
    blocks, buckets = max(least, total // BLOCK_BYTES), max(2 * least, total // BUCKET_BYTES)
    d = d.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    by_block = d.groupBy("block")
    seeds = by_block.applyInArrow(lambda t: _seeds(t, buckets), _schema(_SEEDS))
    shared = seeds.groupBy("bucket").applyInArrow(lambda t: _shared(t, hot), _schema(_SHARED))
    fragments = by_block.cogroup(shared.groupBy("block")).applyInArrow(lambda a, b: _fragments(a, b, buckets), _schema(_FRAGMENTS))
    runs = fragments.groupBy("bucket").applyInArrow(lambda t: _sorted(t), _schema(_RUNS))
    return by_block.cogroup(runs.groupBy("block")).applyInArrow(lambda a, b: _applied(a, b), _schema(_OUT))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")
