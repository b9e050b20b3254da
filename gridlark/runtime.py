"""Session helpers shared by every layer: reading tables, cutting lineage, shipping the package."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one machine's processes."""
    return spark.sparkContext.master.split("[")[0] == "local"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: from its folder where they have it, else from an archive that Spark sends them."""
    sc = spark.sparkContext
    parts = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT in parts:
        return
    sc.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])
    if not is_local(spark):
        base = str(Path(tempfile.mkdtemp(prefix="gridlark-")) / "gridlark")  # the driver's own copy, served by Spark
        sc.addPyFile(shutil.make_archive(base, "zip", ROOT, "gridlark"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, as a lazy scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all nodes share: spark.checkpoint.dir as the cluster names it.

    Where that is unset, a temporary folder of the driver is used on a local master; on any other that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="gridlark-"))
    return named or sc.getCheckpointDir()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package wrote, on whatever file system it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files and checkpoints that no frame refers to any more.

    Its cleaner learns of them only when the driver's garbage is collected, which a long chain of
    small steps may not cause before disks are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parallelism(spark: SparkSession) -> int:
    """Reducer count for explicit repartitions: what the session is configured for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: Rows of an Arrow batch that hold whole texts: Python workers keep room for a batch, and live on between stages.
TEXT_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession) -> None:
    """Have the session pass at most TEXT_ROWS rows a batch to Python, unless its owner named a number."""
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, TEXT_ROWS)
