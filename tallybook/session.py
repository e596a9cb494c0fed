"""Session settings shared by the library, the tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the plans rely on: AQE re-plans joins from measured sizes (this is the size
# check behind every broadcast of a table that can grow) and splits skewed join partitions.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", app: str = "tallybook", memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE_PARTITIONS", "8"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="run-warehouse-"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: setCheckpointDir's, else spark.checkpoint.dir.

    Only a session that runs in one local process, as in tests, gets a folder of its own.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="run-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_SCRATCH: list[list[str]] = []  # paths cut in each open scratch block


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables cut inside the block are deleted behind it; the yielded function cuts a table that
    stays (until the end of the block around, if there is one)."""
    paths: list[str] = []

    def kept(df: DataFrame) -> DataFrame:
        out = cut_lineage(df)
        lasting = paths.pop()
        if len(_SCRATCH) > 1:
            _SCRATCH[-2].append(lasting)
        return out

    _SCRATCH.append(paths)
    try:
        yield kept
    finally:
        _SCRATCH.pop()
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in paths:
            at = hadoop.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_scratch(df: DataFrame, path: str) -> None:
    """Rows written for reading back."""
    df.write.option("compression", "zstd").option(
        "parquet.compression.codec.zstd.level", 1).parquet(path)
    release_shuffles(df.sparkSession)


def release_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of ended writes.

    Spark deletes a shuffle's files once the driver has collected the plan that made them, which it
    may not get to for half an hour.
    """
    spark._jvm.System.gc()


def cut_lineage(df: DataFrame, packed: bool = True) -> DataFrame:
    """The rows written once to the shared folder and read back.

    Used where several joins need the same narrow table: later plans start from a stored table
    with known size, and a lost executor costs no recomputation of what led to it. Unless `packed`,
    the files are written as any table, and the shuffles stay until the driver drops them.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    if packed:
        write_scratch(df, path)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
