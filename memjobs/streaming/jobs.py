"""The write path, duplicates, project state and activity on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memjobs.operators import extract, state
from memjobs.operators.health import normalised
from memjobs.sources.tables import remove, shared_folder, written


def stream_memories(events: DataFrame) -> DataFrame:
    """Stateless extraction, redaction and scoring; the same rows as the batch path with every rule's row kept."""
    return extract.score_memories(extract.redact_memories(extract.extract_memories(events, keep_all=True)))


def stream_dedupe(memories: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first of each project, session, type and text within ``delay`` of event time: the state's horizon."""
    keyed = memories.withColumn("content_hash", F.sha2(normalised(F.col("raw_text")), 256)).withWatermark("timestamp", delay)
    return keyed.dropDuplicatesWithinWatermark(["project_id", "session_id", "memory_type", "content_hash"])


def stream_activity(events: DataFrame, window: str = "24 hours", slide: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """project_id, start, n: rolling event counts."""
    marked = events.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    if marked.isStreaming:
        marked = marked.withWatermark("timestamp", delay)
    counts = marked.groupBy(F.window("timestamp", window, slide).alias("w"), "project_id").agg(F.count("*").alias("n"))
    return counts.select("project_id", F.col("w.start").alias("start"), "n")


def run_to_table(stream: DataFrame) -> DataFrame:
    """Runs a stream over what is there now into a Parquet table, and reads that."""
    folder = shared_folder(stream.sparkSession, "stream")
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


class KeyedState:
    """A stored table of one row a key, below ``folder``; what a batch writes follows what it touched.

    A batch writes the new rows of its keys alone, in folders by bucket of the
    key; of several rows of a key the one of the latest batch counts.  Reading
    for some keys opens their buckets only.  Once the batches since the last
    full table are together as large as it was, the next one writes a full table,
    so a row is rewritten about as often as the state doubles, and no more than
    that many folders are read.  Nothing is kept on the driver: a restarted query
    goes on from the folders, a replayed batch reads what lay before it and
    overwrites its own.  What a full table of an earlier batch stands for is
    deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = 64):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def tables(self, before: int | None = None) -> list[tuple[int, str, str]]:
        """(batch, kind, path) of whole tables that count, oldest first: the last full one before the batch, and those after it."""
        fs, path = self._path(f"{self.folder}/*-*/_SUCCESS")
        found = []
        for status in fs.globStatus(path) or []:
            parent = status.getPath().getParent()
            kind, _, batch = parent.getName().partition("-")
            if before is None or int(batch) < before:
                found.append((int(batch), kind, parent.toString()))
        found.sort()
        full = max((i for i, x in enumerate(found) if x[1] == "full"), default=0)
        return found[full:]

    def bytes_of(self, path: str) -> int:
        fs, target = self._path(path)
        return fs.getContentSummary(target).getLength()

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def load(self, before: int | None = None, keys: DataFrame | None = None) -> DataFrame | None:
        """The state of batches before this one, of these keys (a table with the key column) or of all."""
        tables = [x for x in self.tables(before) if self.bytes_of(x[2])]  # a batch without rows leaves an empty table
        if not tables:
            return None
        rows = None
        for batch, _, path in tables:
            part = self.spark.read.parquet(path).withColumn("_batch", F.lit(batch))
            rows = part if rows is None else rows.unionByName(part)
        if keys is not None:
            keys = keys.select(self.key).distinct()
            opened = [r[0] for r in keys.select(self._bucket()).distinct().collect()]  # as many as there are buckets
            rows = rows.where(F.col("bucket").isin(opened)).join(keys, self.key, "left_semi")
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (self.key, "_batch", "bucket")]), "_batch").alias("s"))
        return newest.select(self.key, "s.*")

    def save(self, rows: DataFrame, batch_id: int) -> None:
        """Stores the new rows of the keys that a batch touched."""
        tables = self.tables(batch_id)
        sizes = [self.bytes_of(p) for _, _, p in tables]
        kind = "batch"
        if len(tables) > 1 and sum(sizes[1:]) >= sizes[0] > 0:
            kind, rest = "full", self.load(batch_id)
            rows = rows.unionByName(rest.join(rows.select(self.key), self.key, "left_anti"))
        for other in ("batch", "full"):
            if other != kind:  # of an earlier try of this batch
                remove(self.spark, f"{self.folder}/{other}-{batch_id}")
        bucketed = rows.withColumn("bucket", self._bucket())
        bucketed.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{kind}-{batch_id}")
        self._clean(tables[0][0] if tables and tables[0][1] == "full" else -1)

    def _clean(self, full: int) -> None:
        fs, path = self._path(f"{self.folder}/*-*")
        for status in fs.globStatus(path) or []:
            if int(status.getPath().getName().partition("-")[2]) < full:
                fs.delete(status.getPath(), True)


def state_sink(store: KeyedState) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: rolls a batch up by project and merges it into those projects' stored state."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        delta = written(state.project_state(batch))
        old = store.load(batch_id, delta)
        store.save(delta.drop("n_sources") if old is None else state.merge_state(old, delta), batch_id)

    return merge


def run_to_state(stream: DataFrame, folder: str | None = None) -> DataFrame | None:
    """Runs a stream of memories into one stored state below ``folder``; a second run on that folder goes on from the first.  None before there is any."""
    folder = folder or shared_folder(stream.sparkSession, "stream")
    store = KeyedState(stream.sparkSession, f"{folder}/state", "project_id")
    query = stream.writeStream.foreachBatch(state_sink(store)).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return store.load()


#: Hours of the rolling windows, by column.
WINDOWS = {"last_1h": 1, "last_24h": 24, "last_7d": 7 * 24, "last_30d": 30 * 24}


def stream_panes(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """project_id, hour, n: events by project and hour of event time.

    Every window is summed from these panes, so an event is counted once however
    many windows hold it.  An event may come late up to ``delay`` behind the
    newest one before its batch and is counted in its own hour; an hour that
    ended before that is closed, and what comes for it then is left out.
    """
    marked = events.select("project_id", F.col("timestamp").cast("timestamp").alias("timestamp")).where("timestamp is not null")
    if marked.isStreaming:
        marked = marked.withWatermark("timestamp", delay)
    return marked.groupBy(F.window("timestamp", "1 hour").alias("w"), "project_id").agg(F.count("*").alias("n")).select("project_id", F.col("w.start").alias("hour"), "n")


def run_to_panes(stream: DataFrame, folder: str | None = None, delay: str = "1 hour") -> DataFrame | None:
    """Runs a stream of events into stored panes below ``folder``; each batch stores the panes that it changed, with their new counts."""
    folder = folder or shared_folder(stream.sparkSession, "stream")
    store = KeyedState(stream.sparkSession, f"{folder}/panes", "pane")
    keyed = stream_panes(stream, delay).select(F.struct("project_id", "hour").alias("pane"), "n")
    query = keyed.writeStream.outputMode("update").foreachBatch(store.save).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    panes = store.load()
    return None if panes is None else panes.select("pane.project_id", "pane.hour", "n")


def rolling_activity(panes: DataFrame) -> DataFrame:
    """project_id, hour, last_1h, last_24h, last_7d, last_30d: events in the windows that end with each hour that has any; sums of panes, none counted anew."""
    hour = F.unix_seconds("hour")
    window = lambda hours: Window.partitionBy("project_id").orderBy(hour).rangeBetween(-(hours - 1) * 3600, 0)
    return panes.select("project_id", "hour", *[F.sum("n").over(window(h)).alias(n) for n, h in WINDOWS.items()])
