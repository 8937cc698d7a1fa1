"""Tables written in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import hashlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_WRITE = 8 << 20  # bytes that go to the JVM at once


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else the context's checkpoint folder; a temporary one is set only where both are unset (local runs)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    context = spark.sparkContext
    have = context._jsc.sc().getCheckpointDir()
    if not have.isDefined():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        have = context._jsc.sc().getCheckpointDir()
    return have.get()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone already at exit
        pass


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, name: str, content: bytes) -> str:
    """The path of a file with these bytes, in a folder of its own in the shared one; both are removed at exit."""
    folder = f"{shared_dir(spark).rstrip('/')}/file-{uuid.uuid4().hex}"
    path = f"{folder}/{name}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    for lo in range(0, len(content), _WRITE):
        out.write(content[lo : lo + _WRITE])
    out.close()
    atexit.register(_remove, spark, folder)
    return path


def shipped(spark: SparkSession, stem: str, content: bytes) -> str:
    """The name under which executors, those started later too, find these bytes by ``SparkFiles.get``; it holds a digest of them, so no two contents share it."""
    name = f"{stem}-{hashlib.sha256(content).hexdigest()[:32]}"
    if not any(os.path.basename(x) == name for x in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(stored(spark, name, content))
    return name
