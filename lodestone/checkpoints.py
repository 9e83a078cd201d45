"""Cutting lineage in loops: tables kept in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the setting is missing a local session gets one of its own; a cluster is refused, as
    its executors share none."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            path = tempfile.mkdtemp(prefix="lodestone-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
        context.setCheckpointDir(path)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df as it is now, from files in spark.checkpoint.dir, so that lost executors cost nothing and plans stay small."""
    _folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """df as a Parquet table in that folder: for tables that are large or read more than once. It stays until the folder is cleaned."""
    path = f"{_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
