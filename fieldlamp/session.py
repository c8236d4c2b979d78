"""Sessions, tables and the folder that executors share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What the plans of this library count on; a cluster sets its own sizes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}
ROOT, BATCH, CLEANUP = "spark.checkpoint.dir", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = 8 << 20
INNER: contextvars.ContextVar[str | None] = contextvars.ContextVar("scratch", default=None)


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("fieldlamp").config(map={**SETTINGS, **settings})
    return (builder.master(master) if master else builder).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(spark: SparkSession) -> SparkSession:
    """Batches between the JVM and Python end at BATCH_BYTES, unless the session has a limit of its own."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. It is the session's spark.checkpoint.dir; only where that
    is unset (tests, one machine) a folder of this machine is made and set."""
    root = spark.conf.get(ROOT, None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="fieldlamp-")
        spark.conf.set(ROOT, root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{INNER.get() or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def save(df: DataFrame, path: str, block_bytes: int = 16 << 20) -> None:
    """Write df as Parquet. Shuffle files of the job go as soon as it has ended, and a writer holds one block of rows."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").option("parquet.block.size", str(block_bytes)).parquet(path)
    finally:
        conf.set(CLEANUP, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """df by way of Parquet in the shared folder: lineage ends there, lost executors cost no recomputation, and every
    consumer reads the same rows. ``unstage`` deletes the files."""
    path = new_path(df.sparkSession, label)
    save(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def remove_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def unstage(*frames: DataFrame) -> None:
    """Delete what ``written`` wrote for these, once no later read needs it."""
    for df in frames:
        remove_path(df.sparkSession, df.staged_path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Everything staged inside goes to one folder, which is deleted at the end."""
    inner = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    before = INNER.set(inner)
    try:
        yield
    finally:
        INNER.reset(before)
        remove_path(spark, inner)
