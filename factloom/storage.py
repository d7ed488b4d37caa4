"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="factloom-checkpoints-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", root)
    _delete_at_exit(spark, root)
    return root


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared folder and read back; its lineage ends there.

    The folder is the session's ``spark.checkpoint.dir``; the table goes when
    the session's JVM ends. A local session without that setting gets a folder
    of its own; a cluster session fails.
    """
    spark = df.sparkSession
    path = f"{_shared_root(spark)}/factloom-tables/{uuid.uuid4().hex}"
    _delete_at_exit(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
