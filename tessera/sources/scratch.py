"""Tables written once to a folder that all executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    """A new path under ``spark.checkpoint.dir``; under a temporary folder only in local mode."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tessera-scratch-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/tessera-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back: computed once, and a lost executor costs a reread of files.

    For tables that several jobs use, such as the rows that candidates are fitted on. Files stay until
    the folder is cleared; no executor memory is held.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
