"""Shared helpers: Arrow batches of bounded size, shared storage, vectorised words."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on.
CHUNK_BYTES = 1 << 19
#: Rows that one vectorised step works on, at most.
CHUNK_ROWS = 1024
#: Bytes of an Arrow batch between the JVM and a Python worker, at most.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the cluster's shared checkpoint folder.

    The session's spark.checkpoint.dir is used. Where it is unset, a session on one machine (master
    local) sets a local folder for itself; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.pairsight.scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="pairsight-")
        spark.conf.set("spark.pairsight.scratch", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialise(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write once to shared storage and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pairsight_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of ``materialise`` that no later step reads."""
    for df in frames:
        path = getattr(df, "_pairsight_path", None)
        if path:
            jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)


def small(df: DataFrame, rows: int, bound: int = 200_000) -> DataFrame:
    """Broadcast hint only where the counted rows are within the bound."""
    return F.broadcast(df) if rows <= bound else df


def row_keys(id_col: Column, text: Column) -> list[Column]:
    """Two longs, ka and kb, that tell a row by its id and text."""
    return [F.xxhash64(id_col, text).alias("ka"), F.xxhash64(text, F.lit(3), id_col).alias("kb")]


def crc_mod(col: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch | dict]], schema: str | object, text: str | None = None, done: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow over slices of at most about CHUNK_BYTES of the ``text`` column and CHUNK_ROWS rows.

    ``fn`` maps a slice to dicts of columns (or record batches). The session's limit on the bytes of
    Arrow batches is lowered to BATCH_BYTES if it is higher: both ends hold whole batches. ``done``
    runs at a task's end; workers live on, so what they hold then counts against later stages.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    struct = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    digits = "".join(c for c in df.sparkSession.conf.get(limit) if c.isdigit() or c == "-")
    if int(digits or 0) <= 0 or int(digits) > BATCH_BYTES:
        df.sparkSession.conf.set(limit, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # gives memory back when asked to
        for batch in batches:
            release_memory()
            for part in slices(batch, text):
                for out in fn(part):
                    if isinstance(out, pa.RecordBatch):
                        yield out
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in arrow], schema=arrow)
                    del out
            del batch
        if done is not None:
            done()
        release_memory()

    return df.mapInArrow(run, struct)


def release_memory() -> None:
    """Give freed memory back to the system: workers live on after their task and share an executor's limit."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not this C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batch: pa.RecordBatch, text: str | None) -> Iterator[pa.RecordBatch]:
    if batch.num_rows == 0:
        return
    if text is None:
        yield batch
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > CHUNK_BYTES or i - start >= CHUNK_ROWS):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    yield batch.slice(start)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


# ---- vectorised words -------------------------------------------------------------------------

#: Bytes that separate words: space and 0x09 to 0x0D.
_SEP = np.zeros(256, bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Keeps the first k bytes of eight.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
_LONG = 64


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def run_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of bytes raw[start:end], independent for different seeds.

    Eight bytes at a time go through a bijective finaliser, so runs of equal length up to eight
    bytes never collide; runs beyond 64 bytes take BLAKE2.
    """
    size = ends - starts
    if not len(size):
        return np.zeros(0, np.uint64)
    eight = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(9), strides=(1,))
    h = mix((size.astype(np.uint64) + np.uint64(seed + 1)) * _STEP)
    h = mix(h ^ (eight[starts] & _MASK[np.minimum(size, 8)]))
    for k in range(8, _LONG, 8):
        rest = np.flatnonzero(size > k)
        if not len(rest):
            break
        h[rest] = mix(h[rest] * _STEP ^ (eight[starts[rest] + k] & _MASK[np.minimum(size[rest] - k, 8)]))
    for i in np.flatnonzero(size > _LONG).tolist():
        digest = hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        h[i] = int.from_bytes(digest, "little")
    return h


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of several texts.

    starts, ends: byte positions in ``data``; doc: index of each word's text; first: index of the
    first word of each text, with the number of words as last entry.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.n = len(texts)
        joined = b" ".join(texts) + b" "
        self.raw = joined.translate(LOWER) if lower else joined
        self.data = np.frombuffer(self.raw, np.uint8)
        sep = _SEP[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], sep)).view(np.int8)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, self.n)
        self.offsets = np.concatenate(([0], np.cumsum(lengths + 1)))
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return run_hashes(self.raw, self.starts, self.ends, seed)

    def joined(self, gone: np.ndarray | None = None) -> list[bytes]:
        """Each text's words, without those flagged in ``gone``, joined by single spaces."""
        left = self.starts, self.ends
        first = self.first
        if gone is not None:
            keep = np.concatenate(([0], np.cumsum(~gone)))
            left, first = (self.starts[~gone], self.ends[~gone]), keep[first]
        size = left[1] - left[0] + 1  # with the separator that follows, which becomes a space
        edge = np.zeros(len(self.data) + 1, np.int8)
        edge[left[0]] += 1
        edge[left[1] + 1] -= 1
        inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
        data = np.where(_SEP[self.data[inside]], np.uint8(32), self.data[inside]).tobytes()
        at = np.concatenate(([0], np.cumsum(size)))[first].tolist()
        return [data[a : max(a, b - 1)] for a, b in zip(at, at[1:], strict=False)]


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` consecutive word hashes (over the whole array).

    Runs are built by doubling, with a finaliser at every step, so that no arrangement of few
    different words cancels out.
    """
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    run, length, at = words, 1, 0
    out = np.full(n, size, np.uint64)
    while True:
        if size & length:
            out = mix(out * _STEP + run[at : at + n])
            at += length
        if 2 * length > size:
            return out
        run = mix(run[:-length] * _STEP + run[length:])
        length *= 2
