"""Session set-up for local runs and the one place where written intermediates go."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from collections.abc import Iterator

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(app: str = "revlens", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "4g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, as ``--py-files`` would.

    Once per application: the Arrow helpers are looked up by module name there.
    """
    context = spark.sparkContext
    if any("revlens-pkg" in f for f in context.listFiles):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="revlens-zip-"), "revlens-pkg")
    context.addPyFile(shutil.make_archive(base, "zip", root_dir=root, base_dir="revlens"))


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session without the setting (a test) gets a temporary folder; on
    a cluster a folder of one machine would be wrong, so the setting is required.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="revlens-")
    return _LOCAL_DIRS[context.applicationId]


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/revlens/{name}-{uuid.uuid4().hex}"


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    """Intermediates serve one application: its end removes them."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def materialise(
    df: DataFrame, name: str, partition_by: tuple[str, ...] = (), rows_per_file: int | None = None
) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a result must not be computed twice (paid model calls) or where
    its lineage should end. The files outlive any lost executor.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    _remove_at_exit(spark, path)
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(written: DataFrame) -> None:
    """Remove a table that :func:`materialise` wrote and that nothing will read again, where
    many of them would add up before the application ends."""
    jvm = written.sparkSession.sparkContext._jvm
    for file in written.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)).getParent()
        folder.getFileSystem(written.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def one_at_a_time(shared: list[Broadcast]) -> Iterator:
    """In a task: the value of each broadcast, of which only one is held in memory."""
    for part in shared:
        yield part.value
        if len(shared) > 1:
            vars(part).pop("_value", None)
