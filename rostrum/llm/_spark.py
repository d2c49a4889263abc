"""Shared plumbing: scratch tables in the cluster's shared folder, and Arrow slices."""
import gc
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only on a local master where none is configured, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="rostrum-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Rows in an Arrow batch: a few hundred long texts bound a Python worker's memory.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


#: Jobs opened within the innermost ``Scratch.group`` of this thread.
_group: ContextVar = ContextVar("group", default=None)


class Scratch:
    """Tables of one job in the shared folder. ``save`` cuts the lineage: a lost executor costs no recomputation.

    Results are lazy and read these tables, so they stay until ``close``, until their ``group`` ends, or until the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/rostrum-{uuid.uuid4().hex}"
        self.n = 0
        if (own := _group.get()) is not None:
            own.append(self)
        if spark.conf.get(BATCH, None) is None:  # a session's own setting stays
            spark.conf.set(BATCH, "500")

    def save(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """With ``rows``, about how many there are, a table is written in no more tasks than the cluster has use for: two a
        core, or one for each half million rows. Many tiny files cost more than the work they hold."""
        self.n += 1
        if self.n == 1:
            path, fs = self._at(self.root)
            fs.mkdirs(path)
            fs.deleteOnExit(path)
        if rows is not None:
            df = df.coalesce(max(2 * self.spark.sparkContext.defaultParallelism, rows // 500_000 + 1))
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def release(self) -> None:
        """Spark deletes shuffle files once their plans are garbage; a loop of large shuffles asks for that each round."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *frames: DataFrame) -> None:
        """Deletes saved tables that no later result reads."""
        for f in frames:
            path, fs = self._at(f.scratch_path)
            fs.delete(path, True)

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def close(self) -> None:
        """Deletes the job's tables; only for when no result that reads them is still wanted."""
        if self.n:
            path, fs = self._at(self.root)
            fs.delete(path, True)

    @classmethod
    @contextmanager
    def group(cls):
        """Closes, in the end, the jobs opened within by this thread; those of other threads and of groups around it stay."""
        token = _group.set([])
        try:
            yield
        finally:
            for job in _group.get():
                job.close()
            _group.reset(token)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as the cluster has cores, if it has fewer: a small file is read by few tasks, whatever is to be done with its rows.

    A table of more partitions than cores, as any large one is, is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores in front as it takes to be none of ``df``'s columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """Slices of a batch with about ``limit`` bytes of text (one row at least), each with its bytes and row offsets.

    A null text has no bytes."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    if not len(col):
        return
    if col.null_count:
        col = col.fill_null(b"")
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j
