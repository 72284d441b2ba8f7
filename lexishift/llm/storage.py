"""Shared folders, written tables and files that tasks write themselves.

Everything intermediate goes below ``spark.checkpoint.dir``, the folder that the driver and all executors
share. Tasks reach it through ``pyarrow.fs``, which resolves the same URIs (file, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a local session (as in tests) gets one; a cluster must name its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local[") and master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-lexishift-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/") if "://" in root or not root.startswith("/") else "file://" + root.rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder name for one run of an operator."""
    return f"{shared_root(spark)}/lexishift/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet and read it back: lineage ends here and a lost executor costs nothing before it."""
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def task_fs(uri: str):
    """(filesystem, path) for a task that reads or writes plain files below a shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def carried(docs: DataFrame, **columns: str) -> DataFrame:
    """All columns of ``docs`` as one struct ``_row`` beside the named ones, so no name of theirs can clash with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[F.col(f"`{c}`").alias(n) for n, c in columns.items()])


def restored(df: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of ``docs`` from ``_row``, those in ``changed`` replaced where ``docs`` has them."""
    return df.select(*[(changed[c].cast(docs.schema[c].dataType) if c in changed else F.col("_row")[c]).alias(c) for c in docs.columns])
