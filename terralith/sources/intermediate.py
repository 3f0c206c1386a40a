"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Only where the session has no spark.checkpoint.dir and all its work is in one JVM, as in tests.
LOCAL = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; without it the warehouse, or on one machine LOCAL. Never a folder of one machine on a cluster."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own
    if spark.sparkContext.master.startswith("local"):
        return LOCAL
    warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
    if not warehouse:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return warehouse


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a Parquet table in the shared folder: later jobs start from it, whichever executors are lost.

    The folder goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/terralith/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
