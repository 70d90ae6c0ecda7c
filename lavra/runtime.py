"""Session, table access and lineage cuts shared by every module."""

from __future__ import annotations

import contextlib
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BYTES = 8 << 20  # of rows that go to a Python worker at a time; Spark's own 64 MB stand in the JVM and in the worker, and doubled while a batch grows


def session(app: str = "lavra", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution and UTC time; `master` and `partitions` only for local runs."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, as Python workers import it. Where the session doesn't say how large the batches
    for workers are, they hold `BYTES`."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, f"{BYTES}b")
    context = spark.sparkContext
    if getattr(context, "_lavra_shipped", False):
        return
    package = Path(__file__).resolve().parent
    made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='lavra-')}/lavra", "zip", package.parent, package.name)
    context.addPyFile(made)
    context._lavra_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes of text in a column, a row at least, so that a Python worker holds few texts at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(sizes):
            if size and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out where a table has fewer splits than there are cores (a small file with one row group); larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or the context's checkpoint folder. A temporary folder
    stands for it in local runs alone; on a cluster its absence is an error, as executors don't see the driver's disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="lavra-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: the plan behind it never runs again,
    and a lost executor costs no recomputation. `discard` deletes what a session has written so."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lavra/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext.__dict__.setdefault("_lavra_written", []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lavra_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes large tables that `materialise` returned, once nothing that was built on them is still to run."""
    for each in tables:
        spark, path = each.sparkSession, each._lavra_path
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        with contextlib.suppress(ValueError):
            spark.sparkContext.__dict__["_lavra_written"].remove(path)


def settle(spark: SparkSession) -> None:
    """Shuffle files go once the driver has dropped the plans that made them; this has it do so now, not when its heap is full. To be called
    after steps that shuffle much, whose results are written."""
    gc.collect()
    spark._jvm.System.gc()


def discard(spark: SparkSession, keep: int = 0) -> int:
    """Deletes the tables that `materialise` has written in this session but the first `keep`, once no result is to be read any more;
    how many there were."""
    written = spark.sparkContext.__dict__.get("_lavra_written", [])
    gone = written[keep:]
    del written[keep:]
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(gone)


@contextlib.contextmanager
def working(spark: SparkSession) -> Iterator[None]:
    """What is materialised within is deleted at the end: for work whose results are written elsewhere by then."""
    before = len(spark.sparkContext.__dict__.get("_lavra_written", []))
    try:
        yield
    finally:
        discard(spark, before)
