"""Shared plumbing: the shared folder, written intermediates, Arrow columns."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where it is unset and all runs on one machine, as in tests, a temporary folder is used;
    on a cluster without the setting this is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="brindle-"))
    return _LOCAL[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which a query's shuffle files go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage and survives lost executors.

    The shuffle files of the write go with its end; else they lie on the disks until the driver happens to collect its garbage.
    """
    path = scratch(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_bucket(column: str, n: int):
    """crc32 of the id as text, modulo n; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def strings(column: pa.Array) -> list[str]:
    """The texts of a column; null becomes the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


def text_slices(column: pa.Array, size: int = 1 << 20):
    """Lists of the texts of a column, in order, of about ``size`` bytes each; null becomes the empty text."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(lengths, dtype=np.int64) - lengths) // size
    cuts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(column)]):
        yield strings(column.slice(a, b - a))


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each row of a string column; null becomes no bytes."""
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def release() -> None:
    """Hand the memory that this process holds but does not use back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc only
        trim(0)


def releasing(rows):
    """``rows``, a function from batches to batches, that releases memory at the end of each partition.

    Idle workers live on into the next stages, and all that they hold counts for their executor.
    """

    @functools.wraps(rows)
    def run(batches):
        try:
            yield from rows(batches)
        finally:
            release()

    return run


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
