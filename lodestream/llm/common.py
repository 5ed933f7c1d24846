"""What the operators share: table access, a shared scratch folder, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores where it is smaller than a split of its files for each of them: a small file is read as one task, which others would wait for.

    The plan's own estimate of bytes decides, so that a larger table is read as it lies, without a shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * split else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and all runs on one machine."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = getattr(spark.sparkContext, "_lodestream_dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="lodestream-")
        spark.sparkContext._lodestream_dir = own
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestream/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str) -> None:
    """Write df as Parquet; the shuffle files of this query, which no other reads, go when it ends."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            conf.unset(_CLEANUP)
        else:
            conf.set(_CLEANUP, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back; cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Space:
    """Intermediate tables of one operator in the shared folder, deleted when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        write(df, path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.held.pop(id(t))[1])
            path.getFileSystem(conf).delete(path, True)

    def drop_all_but(self, *tables: DataFrame) -> None:
        keep = {id(t) for t in tables}
        self.drop(*(t for i, (t, _) in list(self.held.items()) if i not in keep))


BATCH_BYTES = 8_000_000


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow with batches of bounded bytes, so that a Python worker's memory does not depend on the rows' size.

    The bound is a setting of the session, read when a plan is built; a smaller one of the user stays.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name)
    if not now.rstrip("bB").isdigit() or not 0 < int(now.rstrip("bB")) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))

    def work(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(work, schema)


def release() -> None:
    """Gives the memory that a task has freed back to the system, as an idle worker of one stage lives on beside the next stages'."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(batches, rows: int = 1000):
    """Arrow batches cut to at most `rows` rows, so that a task's working set stays bounded."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())


def mix64(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, elementwise on uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices flat[s : s + n] for all pairs (s, n), joined."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return flat[:0]
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]))]


def slices_of(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary array whose i-th value is the bytes of flat[bounds[i] : bounds[i + 1]]."""
    data = np.ascontiguousarray(flat)
    offsets = (bounds * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def with_end(flat: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends end_id to each of the documents in flat."""
    return np.insert(flat, bounds[1:], end_id), bounds + np.arange(len(bounds))


def partition_bases(df: DataFrame, key: str, amount: str, base: str) -> DataFrame:
    """Each key's sum of what stands before it, for keys that number tasks: one small row per task."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    totals = df.groupBy(key).agg(F.sum(amount).alias("_n"))
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(key, F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias(base))


def chunks(texts: pa.Array, limit: int = 24_000_000):
    """Index ranges of consecutive texts of about `limit` bytes each (one text at least)."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + limit, "right")))
        yield a, b
        a = b
