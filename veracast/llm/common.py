"""Shared plumbing: Arrow batches as byte arrays, shared-folder tables, deterministic splits."""

from __future__ import annotations

import ctypes
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once by a Python worker; a single longer text is still taken whole.
CHUNK_BYTES = 1 << 20
#: Bytes of a batch between Spark and Python, which both hold at once.
BATCH_BYTES = 2 << 20
#: Bytes that a task writing a table holds before it lets them go.
ROW_GROUP_BYTES = 16 << 20


#: What empties each cache that this process has filled, and the module whose task filled them.
CACHES: list[Callable[[], None]] = []
_HOLDER = [""]


def turn_to(module: str) -> None:
    """Empties the caches of another operator's tasks, if this process has run them."""
    if _HOLDER[0] != module:
        for clear in CACHES:
            clear()
        _HOLDER[0] = module


def let_go() -> None:
    """Gives free memory back, so that the next task in this process starts without what this one held."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        pass  # another C library than glibc, which has no such call


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``: nothing but its module's bounded caches outlives a task, and those no task of another operator."""
    module = run.__module__

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(module)
        try:
            yield from run(batches)
        finally:
            let_go()

    return task


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds about ``limit`` bytes, so that a worker's memory is bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
    return raw, offsets - lo


def texts(column: pa.Array) -> list[str]:
    """The rows as Python strings; null is empty."""
    return pc.fill_null(column, "").to_pylist()


def crc_of_id(doc_id) -> int:
    """CRC-32 of the id written as text; 0 for a null id."""
    return zlib.crc32(str(doc_id).encode()) if doc_id is not None else 0


def remainder_col(id_col: str, modulus: int):
    """``crc_of_id(id) % modulus`` as a column."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % modulus


def small_batches(spark: SparkSession) -> None:
    """Bounds what Python workers hold: batches by bytes, so that long texts do not add up, and one heap that gives memory back."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    for name, value in (("ARROW_DEFAULT_MEMORY_POOL", "system"), ("MALLOC_ARENA_MAX", "1")):
        spark.sparkContext.environment.setdefault(name, value)


def read_documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; set here only where the cluster names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "/tmp/checkpoints"
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veracast-{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_STEP = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}
CACHES.append(_POWERS.clear)


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base ** i modulo 2**64 for i below n, kept and doubled as needed."""
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base)
        have[0] = 1
        _POWERS[name] = have = np.multiply.accumulate(have)
    return have


#: Bytes hashed at once; the working arrays take some thirty times that.
HASH_BYTES = 1 << 20


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each raw[start:end], equal for equal bytes wherever they stand (differences of a running polynomial).

    Spans come in the order of their starts, and are taken block by block.
    """
    if len(raw) <= HASH_BYTES or not len(start):
        return _span_hashes(raw, start, end)
    out = np.empty(len(start), np.uint64)
    cuts = np.unique(np.searchsorted(start, np.arange(0, len(raw), HASH_BYTES)))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(start)], strict=True):
        if b > a:
            lo, hi = int(start[a]), int(end[a:b].max())
            out[a:b] = _span_hashes(raw[lo:hi], start[a:b] - lo, end[a:b] - lo)
    return out


def _span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(raw)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers("up", _STEP, n + 1)[:n], out=total[1:])
    h = (total[end] - total[start]) * _powers("down", _INVERSE, n + 1)[start]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] places, then the same for each further span."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(length) - length
    return np.arange(total) + np.repeat(start - before, length)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return edge[::2], edge[1::2]


def by_part(ids: np.ndarray, hs: np.ndarray, sizes: np.ndarray, data: bytes, parts: int) -> pa.RecordBatch:
    """Rows of (id, h, bytes) as one blob for each part that ids fall into: (part, blob). Rows stay few however many the ids are."""
    part = ((ids.astype(np.uint64) * _STEP) >> np.uint64(33)).astype(np.int64) % parts
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    raw, start, rows = np.frombuffer(data, np.uint8), np.cumsum(sizes) - sizes, []
    for p in np.flatnonzero(np.diff(edges)).tolist():
        o = order[edges[p] : edges[p + 1]]
        rows.append((p, b"".join((np.int64(len(o)).tobytes(), ids[o].tobytes(), hs[o].tobytes(), sizes[o].astype(np.int64).tobytes(), raw[ragged(start[o], sizes[o])].tobytes()))))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "blob"])


def from_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in a task's blobs as (id, h, data), the bytes of equal (id, h) joined."""
    found: dict[tuple[int, int], list[bytes]] = {}
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            n = int(np.frombuffer(blob, np.int64, 1)[0])
            ids, hs, sizes = (np.frombuffer(blob, np.int64, n, 8 + 8 * k * n).tolist() for k in range(3))
            at = 8 + 24 * n
            for i, h, size in zip(ids, hs, sizes, strict=True):
                found.setdefault((i, h), []).append(blob[at : at + size])
                at += size
    keys = list(found)
    for k in range(0, len(keys), 5000):
        part = keys[k : k + 5000]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array([h for _, h in part], pa.int64()), pa.array([b"".join(found.pop(x)) for x in part], pa.binary())], ["id", "h", "data"])
