"""Helpers shared by the operators: shared storage, Arrow batches, vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that an operator turns into one output batch at most (one longer text still makes one).
BATCH_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only where it is unset and the master is local."""
    jsc = spark.sparkContext._jsc.sc()
    known = jsc.getCheckpointDir()
    if known.isDefined():
        return known.get()
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="shared-")
    spark.sparkContext.setCheckpointDir(path)
    return jsc.getCheckpointDir().get()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of the actions within are deleted as each of them ends, not when the driver's memory is next collected: for actions whose
    result is written or a number, so that nothing reads their shuffles again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Tables:
    """Intermediate tables in the shared folder: they cut the lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        with passing(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def keep_freed() -> None:
    """From now on this process keeps some MB of what it frees. glibc hands back every block of over 128 KB, and the pages of the next such array are fetched anew;
    that bound grows once a larger block is freed."""
    np.empty(1 << 24, np.uint8)


def unused(columns: list[str], *stems: str) -> list[str]:
    """A name for each stem that is none of the columns, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def tasks_for(df: DataFrame) -> int:
    """Shuffle partitions that the session asks for."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts hold about `most` bytes, or one row."""
    arr = batch.column(column)
    n = batch.num_rows
    if not n or arr.nbytes <= most:
        if n:
            yield batch
        return
    size = pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i in range(n):
        if total and total + size[i] > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(size[i])
    yield batch.slice(begin)


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array, without copying where there are no nulls; null texts count as empty."""
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    offsets = np.frombuffer(offs, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The white space of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, first word of each text and the total) of all words; texts end words."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    begins[inner] |= solid[inner]
    ends = np.zeros(len(raw) + 1, bool)
    ends[1:] = solid
    ends[1:-1] &= ~solid[1:]
    ends[inner] |= solid[inner - 1]
    b = np.flatnonzero(begins)
    return b, np.flatnonzero(ends), np.searchsorted(b, offsets)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse; those of short spans are kept."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, 1 << 16)
        both = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, out=p))
        if size > 1 << 20:
            return both[0], both[1]
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def span_hashes(units: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of units[begin:end], in time linear in the units: a polynomial by prefix sums, then mixed with the length."""
    n = len(units)
    powers, back = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
    return mix((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
