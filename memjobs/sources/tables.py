"""Tables written in the folder that driver and executors share, to cut lineage and to compute a shared input once."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession


def base_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the context's checkpoint folder; a temporary one is set only where both are unset, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder that is no longer needed; nothing happens where it or the JVM is gone."""
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # at exit the JVM may have ended
        pass


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder's path below the shared one; what is written there is removed at exit."""
    path = f"{base_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table: later readers don't compute them again, and lost executors lose nothing."""
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *key: str) -> DataFrame:
    """The rows in as many partitions as a shuffle has, by a key of one or more columns; the number is stated, so small rows with much work ahead aren't coalesced into few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def write_files(lines: DataFrame, folder: str, order: tuple[str, ...] = ()) -> int:
    """lines (path, content, *order): a file for each path below the folder, its rows' contents one after another in this order; returns how many.

    Tasks write the files themselves, under their last names.  The number of
    partitions is stated, since small rows would else be coalesced into one task
    that writes all the files.
    """

    def job(batches):
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        made, last, out, n = set(), None, None, 0
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path != last:
                    if out:
                        out.close()
                    target = f"{base}/{path}"
                    parent = target.rpartition("/")[0]
                    if parent not in made:
                        store.create_dir(parent)
                        made.add(parent)
                    last, out, n = path, store.open_output_stream(target), n + 1
                out.write(content.encode())
        if out:
            out.close()
        yield pa.RecordBatch.from_pydict({"n": [n]})

    spark = lines.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = lines.where("path is not null and content is not null").repartition(tasks, "path").sortWithinPartitions("path", *order).select("path", "content")
    return placed.mapInArrow(job, "n long").groupBy().sum("n").first()[0] or 0
