"""Helpers that the corpus operators share: shared storage, ids and row iteration."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none (tests, a local session) a temporary folder is
    chosen, once for the session.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, written once to shared storage and read back: a cut in the lineage."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more; other tables are left alone."""
    for table in tables:
        if "stored_at" in vars(table):
            remove_folder(table.sparkSession, table.stored_at)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder of new_folder() through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def rows(batches, *names):
    """Tuples of Python values of the named columns, from Arrow record batches."""
    for batch in batches:
        yield from zip(*(batch.column(name).to_pylist() for name in names), strict=True)


def compressed(df: DataFrame, text_col: str = "text", out: str = "data") -> DataFrame:
    """df with the UTF-8 of a text column compressed, for shuffles (null and empty: null)."""
    others = [f for f in df.schema.fields if f.name != text_col]

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            data = [pack(t) if t else None for t in batch.column(text_col).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in others), pa.array(data, pa.binary())], names=[*(f.name for f in others), out])

    return df.mapInArrow(run, T.StructType([*others, T.StructField(out, T.BinaryType())]))


def uncompressed(batch, name: str = "data"):
    """The texts of a compressed column as bytes."""
    unpack = zstandard.ZstdDecompressor().decompress
    for data in batch.column(name).to_pylist():
        yield unpack(data) if data else b""
