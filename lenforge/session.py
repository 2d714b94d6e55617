"""Session helpers shared by the library: table loading, reliable checkpoints, text clean-up columns."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "lenforge", cores: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, pass the cluster's own session to the operators instead."""
    n = cores or os.cpu_count() or 8
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LENFORGE_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; Catalyst prunes its columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder the cluster names in spark.checkpoint.dir; sets a local one only in local mode (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lenforge-checkpoint-")
    sc.setCheckpointDir(named)


def work_folder(spark: SparkSession) -> str:
    """A new path below the shared checkpoint folder, for tables a query writes and reads again."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/work-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Materialises ``df`` as Parquet in the shared checkpoint folder: a lost executor costs a read and no recomputation, and later scans read only their columns."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes a table made by ``written`` that no later step reads."""
    files = table.inputFiles()
    if files:
        sc = table.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def strip(col: Column | str) -> Column:
    """Removes Unicode white space at both ends (Spark's trim removes spaces only)."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")

