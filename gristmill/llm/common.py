"""Small helpers that the operators share: inputs, the shared folder, Arrow text buffers, hashes."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words of every operator that counts words: runs of anything but these ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; one of our own only where that is unset."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        sc.setCheckpointDir("/tmp/checkpoints")
        current = sc._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: computed once, and a lost executor takes nothing with it."""
    spark = df.sparkSession
    path = shared_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(docs: DataFrame) -> DataFrame:
    """doc_id as long and text, null text as empty; other columns are dropped, so their names cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """What make gives, kept in this Python worker for later tasks with the same key: one thing at a time."""
    if key not in _kept:
        release()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Lets go of what an earlier operator kept in this Python worker, which Spark hands on from stage to stage."""
    if _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until they are unlike all columns of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def one_of_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of those with equal keys. Rows are dealt and sorted by the keys, as a join on them needs anyway."""
    (before,) = fresh(df, "before")
    w = Window.partitionBy(*keys).orderBy(*keys)
    return df.withColumn(before, F.lag(F.lit(1)).over(w)).where(F.col(before).isNull()).drop(before)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, one text after the other, and the offsets of the texts (one more than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the words of texts, and the first word of each text (one more than texts)."""
    n = len(data)
    space = np.r_[True, _SPACE[data], True]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(~space[1 : n + 1] & (space[:n] | edge[:n]))
    end = np.flatnonzero(~space[1 : n + 1] & (space[2:] | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def slices(batch: pa.RecordBatch | pa.Table, column: str, size: int) -> Iterator[pa.RecordBatch | pa.Table]:
    """Cuts a batch so that each part holds about size bytes of the column, or a single longer row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False) if batch.num_rows else []
    begin = total = 0
    for row, length in enumerate(lengths):
        if row > begin and total + length > size:
            yield batch.slice(begin, row - begin)
            begin, total = row, 0
        total += length
    if batch.num_rows > begin:
        yield batch.slice(begin)


def pack_rows(parts: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """Sorts rows by part and yields each part with its columns as bytes: the unit of a shuffle of plain arrays."""
    if len(parts) == 0:
        return
    order = np.argsort(parts, kind="stable")
    ordered = parts[order]
    columns = [c[order] for c in columns]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    for begin, end in zip(starts, np.r_[starts[1:], len(ordered)], strict=True):
        yield int(ordered[begin]), [c[begin:end].tobytes() for c in columns]


def mix64(x: np.ndarray) -> np.ndarray:
    """Scrambles unsigned 64-bit numbers: a bijection (multiply and xor-shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def gram_hash(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of every run of length bytes, from hashes of runs of powers of two."""
    n = len(data) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))[data]
    size, done, total, rest = 1, 0, None, length
    while rest:
        if rest & 1:
            part = power[done : done + n]
            total = part.copy() if total is None else total * _odd(2 * size + 1) + part
            done += size
        rest >>= 1
        if rest:
            power = power[:-size] * _odd(4 * size + 3) + power[size:]
            size *= 2
    return mix64(total)


def _odd(k: int) -> np.uint64:
    return np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF | 1)


def bounded_sample(rows: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """The n rows with the smallest hash of key for each value of by: first of a share of each value, then of those."""
    h = rows.withColumn("_h", F.xxhash64(key))
    for keys in ([by, F.pmod("_h", F.lit(64))], [by]):
        w = Window.partitionBy(*keys).orderBy("_h", key)
        h = h.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return h.drop("_h", "_r")


def letters() -> np.ndarray:
    """Bytes as letters are counted: those of ASCII letters, in lower case, and of longer characters; all else is a space."""
    out = np.full(256, 32, np.uint8)
    out[128:] = np.arange(128, 256)
    out[97:123] = np.arange(97, 123)
    out[65:91] = np.arange(97, 123)
    return out
