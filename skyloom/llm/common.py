"""Shared pieces: words and hashes of Arrow text columns, row numbers, durable intermediate tables."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words: space, tab, LF, VT, FF, CR. Words are everything else.
WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64
_SEGMENT = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256).astype(U64)
_powers: dict[str, np.ndarray] = {"up": np.ones(0, U64), "down": np.ones(0, U64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another and the offsets of each text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z; all other bytes stay."""
    return _LOWER[data]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~_SPACE[data]
    edge = at[(at > 0) & (at < len(data))]
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    before[edge] = False
    after[edge - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def stripped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without the bytes at their ends that ``sign`` (256 booleans) marks; of a span of signs the last byte stays."""
    if not len(starts):
        return starts, ends
    plain = np.flatnonzero(~sign[data])
    plain = np.concatenate(([-1], plain, [len(data)]))
    s = np.minimum(plain[np.searchsorted(plain, starts)], ends - 1)
    return s, np.maximum(plain[np.searchsorted(plain, ends) - 1] + 1, s + 1)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        n = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; starts and ends ascend. Memory is bounded by segments of 1 MB."""
    out, i, n = np.empty(len(starts), U64), 0, len(starts)
    while i < n:
        first = starts[i]
        if ends[i] - first > _SEGMENT:
            out[i] = int.from_bytes(hashlib.blake2b(data[first : ends[i]].tobytes(), digest_size=8).digest(), "little")
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(ends, first + _SEGMENT, "right")))
        up, down = _power(int(ends[j - 1] - first) + 1)
        part = data[first : ends[j - 1]]
        total = np.zeros(len(part) + 1, U64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=total[1:])
        s, e = starts[i:j] - first, ends[i:j] - first
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
        i = j
    return out


def runs(hashes: np.ndarray, k: int, salt: int = 0, factor: int = 0xA0761D6478BD642F) -> np.ndarray:
    """Hashes of every k consecutive word hashes (across texts as well: callers cut at text ends); another odd ``factor`` gives independent ones."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total, m = np.zeros(n, U64), U64(factor | 1)
    for j in range(k):
        total = total * m + hashes[j : j + n]
    return mix(total + U64((k * 0xE7037ED1A0B428DB + salt) % 2**64))


def _folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder) if spark.conf.isModifiable("spark.checkpoint.dir") else spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def durable(df: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it again: cuts lineage and survives lost executors.

    The path is added to ``kept``; ``forget`` deletes what a finished step no longer reads. Tables that a returned,
    still lazy result reads stay in the folder, as those of ``checkpoint()`` do.
    """
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if kept is not None:
        kept.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, kept: list[str]) -> None:
    """Delete tables that ``durable`` wrote."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while kept:
        path = jvm.org.apache.hadoop.fs.Path(kept.pop())
        path.getFileSystem(conf).delete(path, True)


def give_back() -> None:
    """Return memory that numpy and Arrow have freed to the system, which they keep for later otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library on Linux
    if trim:
        trim(0)


def numbered(df: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """Adds ``__f`` and ``__r``: a hash of the file and the row's number in it, the same at every reading of the table.

    They come from Spark's file metadata; a table that is not read from files is written first.
    """
    try:
        at = df.metadataColumn("_metadata")
        return df.withColumns({"__f": F.xxhash64(at.getField("file_path")), "__r": at.getField("row_index")})
    except AnalysisException:
        return numbered(durable(df, kept), kept)


def pieces(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Slices of a batch whose texts hold about ``most`` bytes together (at least one text each)."""
    at, i = text_bytes(batch.column(column))[1], 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def aside(df: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """Rename columns of ``df`` that clash with ``names`` in any case; the second value renames them back (withColumnsRenamed)."""
    there = {c.lower() for c in names}
    moved = {c: f"__aside_{i}" for i, c in enumerate(df.columns) if c.lower() in there}
    return df.withColumnsRenamed(moved), {v: k for k, v in moved.items()}


def without(df: DataFrame, names) -> DataFrame:
    """``df`` without the columns named like ``names`` in any case."""
    gone = {c.lower() for c in names}
    return df.select(*[F.col(quoted(c)) for c in df.columns if c.lower() not in gone])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
