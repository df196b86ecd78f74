"""Session helpers: Spark settings, table access and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: With adaptive execution, Spark 4.1 takes a union of differently coalesced inputs for partitioned by their common key,
#: and aggregates and windows after it come out wrong; so this shortcut stays off.
UNION_PARTITIONING = "spark.sql.unionOutputPartitioning"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("vecquarry")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(UNION_PARTITIONING, "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Make a session fit for the operators: safe unions, and the package on the executors' Python path."""
    spark.conf.set(UNION_PARTITIONING, "false")
    sc = spark.sparkContext
    if getattr(sc, "_vecquarry_shipped", None) is None:
        here = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="vecquarry-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        at = os.path.join(folder, "vecquarry.zip")
        with zipfile.ZipFile(at, "w") as z:
            for p in here.rglob("*.py"):
                z.write(p, p.relative_to(here.parent))
        sc.addPyFile(at)
        sc._vecquarry_shipped = at
    return spark


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``, only with ``columns`` if any are named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows over all shuffle partitions, which adaptive execution doesn't merge: for stages whose work is larger than their input."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``; a local session that has none gets one of its own, removed when it ends."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if getattr(sc, "_vecquarry_folder", None) is None:
        sc._vecquarry_folder = tempfile.mkdtemp(prefix="vecquarry-checkpoints-")
        atexit.register(shutil.rmtree, sc._vecquarry_folder, ignore_errors=True)
    return "file://" + sc._vecquarry_folder


def cut(df: DataFrame, instead: DataFrame | None = None) -> DataFrame:
    """``df`` as a written table in the shared checkpoint folder, so that lost executors don't force its lineage again.

    A columnar table is smaller than a checkpoint of rows, and later plans know its size. It is deleted when the
    application ends, or when a further step of a loop is cut with this table as ``instead``.
    """
    spark = df.sparkSession
    at = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(path)
    if instead is not None and getattr(instead, "_cut_at", None):
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(instead._cut_at), True)
    out = spark.read.schema(df.schema).parquet(at)
    out._cut_at = at
    return out
