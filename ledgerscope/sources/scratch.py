"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerscope.errors import SourceError


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name below the one that ``spark.checkpoint.dir`` states.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise SourceError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="scratch-")
        context.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to a shared folder and read again, for results that several later steps read."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mounted(path: str) -> str:
    """The path on the mounted file system behind a plain path or a ``file:`` address."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise SourceError(f"not a path on a mounted file system: {path}")
    return path
