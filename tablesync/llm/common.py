"""Shared helpers: Arrow text buffers, vectorised hashing, durable cuts and components."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once by the vectorised code; its temporaries take about 60 times that.
SLICE_BYTES = 1 << 20
#: Rows of a few numbers that may be broadcast: at most 40 MB, and a hash table of a few times that.
BROADCAST_ROWS = 1_000_000
#: Multiplier of the polynomial word hash, modulo 2**64; odd, so it can be inverted.
BASE = 0x9E3779B97F4A7C15 | 1


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return (path or "/tmp/tablesync-checkpoints").rstrip("/")


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What durable() writes inside goes at the end, but for what is written to last."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, _scratch.pop()):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame, name: str, lasts: bool = False, few: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that later stages don't hang on lost executors.

    few: sums and links, which are small against the texts; they go into a file for four shuffle
    partitions (or one a core, if that is more). Every file costs an executor a child process or two
    where Hadoop's native library is missing.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _scratch and not lasts:
        _scratch[-1].append(path)
    files = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    out = (df.coalesce(files) if few else df).write
    # row groups of 16 MB bound a writer's memory; no file that only says that the job succeeded
    out.option("parquet.block.size", 16 << 20).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def small_side(ids: DataFrame) -> DataFrame:
    """ids (a few numbers a row), to be broadcast if a count finds at most BROADCAST_ROWS of them; beyond that joins shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def discard(df: DataFrame) -> None:
    """Deletes what durable() wrote for df; nothing that is still to be computed may read it."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._durable_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lean() -> None:
    """Gives a worker's freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not glibc


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, so that it needn't be installed there."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).parent.parent
        folder = tempfile.mkdtemp(prefix="tablesync-")  # Spark reads it as long as the application lives
        atexit.register(shutil.rmtree, folder, True)
        path = Path(folder, f"{package.name}.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(str(path))
        _shipped.add(context.applicationId)


def arrow_rows(spark: SparkSession, rows: int = 500) -> None:
    """Bounds Arrow batches, so that long texts don't fill a Python worker; and sees to it that workers have this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")  # rows of long texts that a scan holds


def carry(docs: DataFrame, keep: tuple[str, ...], made: tuple[str, ...]) -> tuple[list[Column], list[str]]:
    """Kept columns as k0, k1, ..., and their names in the result: one named as a column that the result has of its own gets `_kept` behind its name."""
    return [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], [f"{c}_kept" if c in made else c for c in keep]


def text_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over runs of rows with at most `most` bytes, or one longer row; null is empty."""
    col = batch.column(column)
    text = col.cast(pa.large_string()).fill_null("") if col.null_count else col.cast(pa.large_string())
    if not len(text):
        return
    _, off, data = text.buffers()
    offsets = np.frombuffer(off, np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, len(text))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the public splitmix64 steps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.ones(size, np.uint64)
            p[1:] = base
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal content wherever it stands."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of links; component is the smallest reachable node.

    Alternates large-star and small-star steps (Kiveris et al. 2014) over edge tables; each round's
    edges are written to the shared folder. Minima are partial aggregates, and joins back to a hub's
    edges are left to adaptive skew splitting.
    """
    edges = durable(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc", few=True)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges, old = durable(small, "cc", few=True), edges
        discard(old)
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if state == now:
            break
        state = now
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out.source = edges  # for discard(), once out has been used
    return out
