"""Tables written on the way, in a folder that every executor reaches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; on one machine, where the session names none, below a temporary folder that goes with the process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_partmill_tables", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="partmill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = spark._partmill_tables = "file://" + folder
    return f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """`df` written as Parquet and read back: later joins read it instead of computing it again."""
    path = scratch_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
