"""Look-ups, latest rows per key, top-k lists and table upkeep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANKED = ("recency_score", "importance_score", "timestamp")


def rank_order() -> list[Column]:
    """Recency, importance, time, newest first; the id settles ties."""
    return [*(F.desc(c) for c in RANKED), F.asc("memory_id")]


def events_for(events: DataFrame, project_id: str | None = None, session_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Events of a project or session, newest first."""
    for column, value in (("project_id", project_id), ("session_id", session_id)):
        if value is not None:
            events = events.where(F.col(column) == value)
    newest = events.orderBy(F.desc("timestamp"), F.desc("event_id"))
    return newest if limit is None else newest.limit(limit)


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], order_by: str) -> DataFrame:
    """One row for each key: the one latest by ``order_by``; an update wins over the base on ties."""
    both = base.withColumn("_update", F.lit(0)).unionByName(updates.withColumn("_update", F.lit(1)))
    newest = Window.partitionBy(*keys).orderBy(F.desc(order_by), F.desc("_update"))
    return both.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "_update")


def delete_memories(memories: DataFrame, links: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memories without ``ids`` (memory_id), and links that touch none of them at either end."""
    gone = ids.select("memory_id").distinct()
    kept = memories.join(gone, "memory_id", "left_anti")
    for end in ("source_id", "target_id"):
        links = links.join(gone.withColumnRenamed("memory_id", end), end, "left_anti")
    return kept, links


def top_memories(memories: DataFrame, per: tuple[str, ...] = ("project_id",), memory_type: str | None = None, validity: str | None = None, k: int = 50) -> DataFrame:
    """The first k of each group in rank order, with ``rank``.

    The filter on a bare ``row_number`` lets Spark keep k rows a group before
    the shuffle, so a giant project sends little.
    """
    for column, value in (("memory_type", memory_type), ("validity", validity)):
        if value is not None:
            memories = memories.where(F.col(column) == value)
    place = F.row_number().over(Window.partitionBy(*per).orderBy(*rank_order()))
    return memories.withColumn("rank", place).where(F.col("rank") <= k)


LEDGER_LIMITS = {"active": 100, "proposed": 50}


def decision_ledger(memories: DataFrame, status: str = "active", per: tuple[str, ...] = ("project_id",)) -> DataFrame:
    return top_memories(memories, per, "decision", status, LEDGER_LIMITS[status])


def error_ledger(memories: DataFrame, kind: str | None = None, k: int = 100) -> DataFrame:
    """The kind is tested after the limit, on any of the row's errors."""
    found = top_memories(memories, memory_type="error", k=k)
    return found if kind is None else found.where(F.exists("errors_found", lambda e: e["kind"] == kind))


def search_by_path(memories: DataFrame, fragment: str, k: int = 200) -> DataFrame:
    return top_memories(memories, memory_type="code_change", k=k).where(F.exists("file_references", lambda p: p.contains(fragment)))


def project_overview(memories: DataFrame) -> DataFrame:
    """Per project: total (10 000 at most), active decisions, the first errors and goals as texts of up to 200 characters."""

    def texts(rows: DataFrame, name: str) -> DataFrame:
        text = F.substring(F.coalesce("compressed_summary", "raw_text"), 1, 200)
        ordered = F.array_sort(F.collect_list(F.struct("rank", text.alias("text"))))
        return rows.groupBy("project_id").agg(F.transform(ordered, lambda x: x["text"]).alias(name))

    total = memories.groupBy("project_id").agg(F.least(F.count("*"), F.lit(10_000)).alias("total"), F.count_if((F.col("memory_type") == "decision") & (F.col("validity") == "active")).alias("active_decisions"))
    out = total.join(texts(top_memories(memories, memory_type="error", k=10), "recent_errors"), "project_id", "left")
    return out.join(texts(top_memories(memories, memory_type="goal", k=20), "goals"), "project_id", "left")


def sessions_by_status(sessions: DataFrame, status: str) -> DataFrame:
    return sessions.where(F.col("status") == status).orderBy(F.desc("last_active"), "session_id")


def latest_per(rows: DataFrame, key: str, order_by: str) -> DataFrame:
    """The newest row of each key, such as the latest checkpoint of a session."""
    newest = Window.partitionBy(key).orderBy(F.desc(order_by))
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def marked_stale(memories: DataFrame, markers: DataFrame) -> DataFrame:
    return memories.join(markers.select("memory_id"), "memory_id", "left_semi")


def any_contains(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])
