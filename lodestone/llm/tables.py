"""Reading inputs, shared intermediate tables, and settings that follow the session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's setting by which an execution removes the files of its shuffles when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a folder of
    its own for the session; a cluster is refused, as its executors would each write to their own disks."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, so a lost executor costs no recomputation.

    Columns of equal names must have been renamed before. The files stay until the shared folder is cleaned.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    # the files of its shuffles go with the job, not when the driver's garbage collection finds them unused
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "snappy").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, limit: int, size: Column | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows, else as it is, for a shuffled join.

    df is counted, so it is a table that is cheap to read. Its columns are of fixed width, but for what size counts in each
    row, of which there may be at most limit in all.
    """
    n, total = df.agg(F.count("*"), F.sum(F.lit(0) if size is None else size)).first()
    return F.broadcast(df) if n <= limit and (total or 0) <= limit else df


def forget(*tables: DataFrame) -> None:
    """Deletes the files of tables that written() gave, once nothing that is still to run reads them."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
