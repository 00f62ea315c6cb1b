"""Tables that several parts of a report read, written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset, as in tests on one machine, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="depthwise-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet under the shared folder and read back. The tables stay there for as long as results may read them;
    the folder can be emptied after a job."""
    spark = df.sparkSession
    path, schema = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
