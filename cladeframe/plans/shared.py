"""Where queries that write and read again put their files."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a single machine where that is unset, a local one, deleted at the end."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="cladeframe-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        found = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_folder(spark: SparkSession, tag: str) -> str:
    """A folder not used yet under the shared one."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, tag: str) -> DataFrame:
    """A table written there and read again, which outlives any executor."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
