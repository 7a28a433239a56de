"""Session helpers shared by jobs, tests and the bench."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("promptweir")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", f"{tempfile.gettempdir()}/promptweir-shared")  # one machine: any folder is shared
        .config("spark.promptweir.spread", str(cpus))  # small test tables are one partition
        .getOrCreate()
    )


def _application_dir(spark: SparkSession) -> str:
    """This application's folder in the cluster's shared checkpoint folder, deleted when it ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.gettempdir()  # one machine: its own folder is the shared one
    folder = f"{base.rstrip('/')}/promptweir-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return folder


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh name in the application's shared folder.

    Only a local master may do without ``spark.checkpoint.dir``.
    """
    return f"{_application_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def spread(frame: DataFrame, partitions: int | None) -> DataFrame:
    """Deals a frame out to ``partitions`` before costly expressions, if the caller wants it."""
    return frame.repartition(partitions) if partitions else frame


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, read by every later use,
    and of a size the planner knows."""
    path = shared_dir(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


#: Bytes of an Arrow batch on its way to a Python worker, unless the session says otherwise.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds what a worker and its executor hold of long texts at a time. Spark's own bound counts
    rows, or 64 MB; a session that sets another bound keeps it. Holds for the session, as results
    are evaluated after the operator has returned."""
    if spark.conf.get(_BATCH) in ("67108864b", "64m", "64MB"):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
