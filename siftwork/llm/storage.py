"""Tables that cut lineage: written to the shared folder in spark.checkpoint.dir and read again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's shared folder. Where none is set, a local session gets a temporary one; a cluster has to set its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="siftwork-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """`df`, computed once and read back; survives the loss of any executor."""
    spark = df.sparkSession
    at = f"{folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.saved_at = at
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `saved` made and nothing reads any more."""
    for t in tables:
        if at := getattr(t, "saved_at", None):
            jvm = t.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
