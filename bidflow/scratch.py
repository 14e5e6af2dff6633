"""Tables that cut the lineage of long jobs, in the folder that a cluster's machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session that names none gets a temporary folder, once."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, written once and read back."""
    path = f"{folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    for table in tables:
        spark = table.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
