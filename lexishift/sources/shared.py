"""The folder that the driver and all executors share, and tables written once below it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a local session (as in tests) gets one; a cluster must name its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-lexishift-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/") if "://" in root or not root.startswith("/") else "file://" + root.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet and read again: plans that use it several times do its work once, and lineage ends here."""
    path = f"{shared_root(df.sparkSession)}/lexishift/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
