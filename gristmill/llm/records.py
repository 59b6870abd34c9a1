"""Operator 2: token ids in length-delimited binary records with an offset index.

A shard is one file of frames ``length u64 | masked crc32c of the length u32 | payload | masked crc32c of the payload
u32`` (the layout that training-data readers know), all little-endian. A payload is ``doc_id i64 | bytes for an id u32 |
number of ids u32 | ids``. Beside each shard lies an index of ``offset u64 | payload bytes u32`` for each frame, so that a
reader can fetch frames in any order.

Documents lie in ascending doc_id (null first, then by a hash of the text), shard after shard. Each task writes its shard under a name
of its own attempt and returns that name; only returned names are in the manifest, so lost or repeated tasks do no harm.
Null or empty text: a record of the end id alone. Repeated doc_ids: a record each. Very long texts: one record. Columns
other than doc_id and text may have any names. Empty table: no shard.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, shared_path, table
from .tokens import crc32, default_tokenizer, ids_of

#: Fixed values of the record format: the reversed Castagnoli polynomial and the constant that masks a checksum.
CASTAGNOLI = 0x82F63B78
MASK_DELTA = 0xA282EAD8

_HEADER = struct.Struct("<qII")
_FRAME = struct.Struct("<QI")
_INDEX = np.dtype([("offset", "<u8"), ("length", "<u4")])
_NO_ID = -(1 << 63)
_BLOCK = 512


def _table16() -> np.ndarray:
    """Checksum of every pair of bytes."""
    crc = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(16):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(CASTAGNOLI), crc >> 1)
    return crc


_TABLE = _table16()


def _steps(crc: np.ndarray, words: Iterable[np.ndarray]) -> np.ndarray:
    for w in words:
        crc = _TABLE[(crc ^ w) & 0xFFFF] ^ (crc >> 16)
    return crc


def _zeros_table() -> np.ndarray:
    """What a block of zero bytes makes of each byte of a checksum."""
    parts = (np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])).ravel()
    zero = np.zeros(len(parts), np.uint32)
    return _steps(parts, (zero for _ in range(_BLOCK // 2))).reshape(4, 256)


_SHIFT = _zeros_table()


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each part of at least four bytes, all at once.

    Blocks of all parts advance together, then the blocks of each part are joined. Zeros before a part leave a
    checksum that starts at zero as it is; starting at all ones is the same as inverting the first four bytes.
    """
    if not parts:
        return np.empty(0, np.uint32)
    blocks = np.array([-(-len(p) // _BLOCK) for p in parts])
    ends = np.cumsum(blocks) * _BLOCK
    data = np.zeros(int(ends[-1]), np.uint8)
    for p, end in zip(parts, ends.tolist(), strict=True):
        data[end - len(p) : end] = np.frombuffer(p, np.uint8)
        data[end - len(p) : end - len(p) + 4] ^= 0xFF
    words = np.ascontiguousarray(data.view("<u2").reshape(-1, _BLOCK // 2).T)
    each = _steps(np.zeros(words.shape[1], np.uint32), (w.astype(np.uint32) for w in words))
    first = np.r_[0, np.cumsum(blocks)[:-1]]
    crc = np.zeros(len(parts), np.uint32)
    for k in range(int(blocks.max())):
        on = np.flatnonzero(blocks > k)
        c = crc[on]
        crc[on] = _SHIFT[0][c & 255] ^ _SHIFT[1][c >> 8 & 255] ^ _SHIFT[2][c >> 16 & 255] ^ _SHIFT[3][c >> 24] ^ each[first[on] + k]
    return ~crc


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint64)
    return ((crc >> np.uint64(15) | crc << np.uint64(17) & np.uint64(0xFFFFFFFF)) + np.uint64(MASK_DELTA)).astype(np.uint32)


def frames(payloads: list[bytes]) -> list[bytes]:
    lengths = [len(p).to_bytes(8, "little") for p in payloads]
    return [
        a + int(x).to_bytes(4, "little") + p + int(y).to_bytes(4, "little")
        for a, x, p, y in zip(lengths, masked(crc32c(lengths)), payloads, masked(crc32c(payloads)), strict=True)
    ]


def _payload(doc_id: int | None, ids: bytes, width: int) -> bytes:
    n = len(ids) // 4
    body = ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    return _HEADER.pack(_NO_ID if doc_id is None else doc_id, width, n) + body


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _shard(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, flush: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    from tokenizers import Tokenizer

    number = TaskContext.get().partitionId()
    width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4
    system, base = _open(folder)
    system.create_dir(base, recursive=True)
    name = f"shard-{number:06d}-{uuid.uuid4().hex}"
    n = tokens = at = held = 0
    waiting: list[bytes] = []
    with system.open_output_stream(f"{base}/{name}.rec") as out, system.open_output_stream(f"{base}/{name}.idx") as index:

        def put() -> int:
            end = at
            for p, f in zip(waiting, frames(waiting), strict=True):
                out.write(f)
                index.write(_FRAME.pack(end, len(p)))
                end += len(f)
            waiting.clear()
            return end

        for batch in batches:
            for doc_id, ids in ids_of(batch, tokenizer):
                waiting.append(_payload(doc_id, ids, width))
                held += len(ids)
                n, tokens = n + 1, tokens + len(ids) // 4
                if held >= flush:
                    at, held = put(), 0
        at = put()
    if n:
        yield pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int32()), pa.array([f"{folder}/{name}"]), *(pa.array([x], pa.int64()) for x in (n, tokens, at))], names=["shard", "path", "n_records", "n_tokens", "n_bytes"]
        )
    else:
        system.delete_file(f"{base}/{name}.rec")
        system.delete_file(f"{base}/{name}.idx")


def write_records(docs: DataFrame, folder: str, tokenizer: str | None = None, flush: int = 4 << 20) -> DataFrame:
    """Writes the documents' ids to folder, and returns the manifest: shard, path, n_records, n_tokens, n_bytes."""
    tokenizer = tokenizer or default_tokenizer()
    ordered = documents(docs).withColumn("mark", F.xxhash64("text")).repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text").drop("mark")
    written = ordered.mapInArrow(lambda batches: _shard(batches, folder, tokenizer, flush), "shard int, path string, n_records long, n_tokens long, n_bytes long")
    written.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(written.schema).parquet(f"{folder}/manifest")


def read_records(path: str, chunk: int = 4 << 20, rows: list[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids as 32-bit bytes) of a shard's records, or of the given rows in their order, after checking checksums."""
    system, base = _open(path)
    with system.open_input_file(f"{base}.idx") as f:
        index = np.frombuffer(f.read(), _INDEX)
    with system.open_input_file(f"{base}.rec") as f:
        if rows is not None:
            for row in rows:
                yield from _parse(f.read_at(int(index["length"][row]) + 16, int(index["offset"][row])), index["length"][row : row + 1])
            return
        begin = 0
        sizes = np.cumsum(index["length"].astype(np.int64) + 16)
        while begin < len(index):
            end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + chunk)))
            offset = int(index["offset"][begin])
            yield from _parse(f.read_at(int(sizes[end - 1]) - offset, offset), index["length"][begin:end])
            begin = end


def _parse(data: bytes, lengths: np.ndarray) -> Iterator[tuple[int | None, bytes]]:
    heads, sums, payloads, at = [], [], [], 0
    for n in lengths.tolist():
        heads.append(data[at : at + 8])
        payloads.append(data[at + 12 : at + 12 + n])
        sums += [data[at + 8 : at + 12], data[at + 12 + n : at + 16 + n]]
        if heads[-1] != n.to_bytes(8, "little"):
            raise ValueError("a frame's length differs from the index")
        at += n + 16
    stored = np.frombuffer(b"".join(sums), "<u4").reshape(-1, 2)
    if (stored[:, 0] != masked(crc32c(heads))).any() or (stored[:, 1] != masked(crc32c(payloads))).any():
        raise ValueError("a record's checksum is wrong")
    for p in payloads:
        doc_id, width, n = _HEADER.unpack_from(p)
        ids = np.frombuffer(p, f"<u{width}", n, _HEADER.size)
        yield None if doc_id == _NO_ID else doc_id, ids.astype("<u4").tobytes()


_READ = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, path string, row long"


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _READ.split(", ")]
    types = [pa.int64()] * 4 + [pa.int32(), pa.string(), pa.int64()]
    for batch in batches:
        for s in batch.to_pylist():
            rows, at = [], s["start"]
            for row, (doc_id, ids) in enumerate(read_records(s["path"])):
                rows.append((doc_id, at, len(ids) // 4, crc32(ids), s["shard"], s["path"], row))
                at += len(ids) // 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def record_table(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Reads all shards back: doc_id, start, n_tokens, ids_crc32, and the record's shard, path and row."""
    shards, start = [], 0
    for r in manifest.orderBy("shard").collect():  # one row for each shard
        shards.append((r["shard"], r["path"], start))
        start += r["n_tokens"]
    if not shards:
        return spark.createDataFrame([], _READ)
    parts = spark.sparkContext.parallelize(shards, len(shards))
    return spark.createDataFrame(parts, "shard int, path string, start long").mapInArrow(lambda batches: _read_shards(batches), _READ)


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_records(table(spark, sf_dir, "documents"), shared_path(spark, "records"))
    return record_table(spark, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")
