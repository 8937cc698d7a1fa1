"""Counts and health of the store: conditional aggregates, one pass a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normalised(text) -> F.Column:
    """Lower case, white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def orphans(memories: DataFrame, links: DataFrame) -> DataFrame:
    """Memories at neither end of any link."""
    ends = links.select(F.col("source_id").alias("memory_id")).union(links.select("target_id")).distinct()
    return memories.join(ends, "memory_id", "left_anti")


def store_stats(events: DataFrame, memories: DataFrame) -> DataFrame:
    """One row of totals."""
    of_events = events.agg(F.count("*").alias("events"))
    of_memories = memories.agg(
        F.count("*").alias("memories"), F.countDistinct("project_id").alias("projects"), F.countDistinct("session_id").alias("sessions"),
        F.count_if(F.col("validity") == "superseded").alias("superseded"), F.count_if(F.col("validity") == "stale").alias("stale"),
    )
    return of_events.join(F.broadcast(of_memories))  # one row each


def type_counts(memories: DataFrame) -> DataFrame:
    return memories.groupBy("memory_type").agg(F.count("*").alias("n"))


def health_snapshot(events: DataFrame, memories: DataFrame, links: DataFrame, as_of: str) -> DataFrame:
    """One row: validity counts, ages, orphans, recent activity, duplicates, errors and the score."""
    now = F.lit(as_of).cast("timestamp").cast("double")
    age = (now - F.col("timestamp").cast("double")) / 86_400
    recent = events.agg(*[F.count_if(age < d).alias(f"events_{d}d") for d in (1, 7, 30)])
    kinds = ("active", "superseded", "archived", "stale", "disputed", "proposed", "rejected")
    body = memories.agg(
        F.count("*").alias("memories"), *[F.count_if(F.col("validity") == v).alias(v) for v in kinds],
        F.round(F.avg(age), 2).alias("avg_days"), F.round(F.max(age), 2).alias("max_days"), F.round(F.min(age), 2).alias("min_days"),
        F.count_if(F.col("memory_type") == "error").alias("errors"), F.count_if((F.col("memory_type") == "error") & (age < 7)).alias("errors_7d"),
        F.count_if((F.col("memory_type") == "decision") & (F.col("validity") == "active")).alias("active_decisions"),
    )
    lone = orphans(memories, links).agg(F.count("*").alias("orphans"))
    groups = memories.groupBy(F.sha2(normalised(F.col("raw_text")), 256).alias("h")).agg(F.count("*").alias("n")).where("n > 1")
    doubled = groups.agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_memories"))
    row = body.join(F.broadcast(recent)).join(F.broadcast(lone)).join(F.broadcast(doubled))  # one row each
    ratio = F.when(F.col("memories") > 0, F.round(F.col("orphans") / F.col("memories"), 3)).otherwise(0.0)
    stale = (F.col("stale") + F.col("superseded") + F.col("archived")) / F.greatest(F.col("memories"), F.lit(1))
    score = 1.0 - F.when(ratio > 0.5, 0.2).when(ratio > 0.2, 0.1).otherwise(0.0) - F.when(F.col("duplicate_groups") > 0, 0.1).otherwise(0.0) - F.when(stale > 0.3, 0.1).otherwise(0.0)
    return row.withColumn("orphan_ratio", ratio).withColumn("score", F.greatest(F.lit(0.0), F.round(score, 2)))


def largest_projects(memories: DataFrame, k: int = 20) -> DataFrame:
    return memories.groupBy("project_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project_id").limit(k)


def dashboard_metrics(events: DataFrame, memories: DataFrame, links: DataFrame, corrections: DataFrame, as_of: str) -> DataFrame:
    """One row: last hour's events and memories, share of memories with an outgoing link, errors of the day, disputed, stale, corrections."""
    now = F.lit(as_of).cast("timestamp").cast("double")
    hours = (now - F.col("timestamp").cast("double")) / 3600
    a = events.agg(F.count_if(hours < 1).alias("events_hour"))
    b = memories.agg(
        F.count_if(hours < 1).alias("memories_hour"), F.count("*").alias("memories"), F.count_if((F.col("memory_type") == "error") & (hours < 24)).alias("errors_day"),
        F.count_if(F.col("validity") == "disputed").alias("disputed"), F.count_if(F.col("validity") == "superseded").alias("stale"),
    )
    c = links.agg(F.countDistinct("source_id").alias("linked"))
    d = corrections.agg(F.count("*").alias("corrections"))
    row = a.join(F.broadcast(b)).join(F.broadcast(c)).join(F.broadcast(d))  # one row each
    return row.withColumn("link_ratio", F.round(F.col("linked") / F.greatest(F.col("memories"), F.lit(1)), 3))


def project_breakdown(memories: DataFrame) -> DataFrame:
    """Counts by project, by type and by validity in one pass: unused keys are null."""
    sets = [[F.col("project_id")], [F.col("project_id"), F.col("memory_type")], [F.col("project_id"), F.col("validity")]]
    return memories.groupingSets(sets, F.col("project_id"), F.col("memory_type"), F.col("validity")).agg(F.count("*").alias("n"))


def symbol_breakdown(symbols: DataFrame) -> DataFrame:
    """Symbols by project and type."""
    return symbols.groupBy("project_id", "symbol_type").agg(F.count("*").alias("n"))


def newest_events(events: DataFrame, k: int = 5) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("timestamp"), F.desc("event_id")))
    return events.withColumn("place", place).where(F.col("place") <= k)


def duplicate_groups(memories: DataFrame, k: int | None = 10) -> DataFrame:
    """The largest groups of one normalised text: key, n, types, first id."""
    groups = memories.groupBy(normalised(F.col("raw_text")).alias("text")).agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("memory_type")), "|").alias("types"), F.min("memory_id").alias("first_id")
    )
    groups = groups.where("n > 1")
    return groups if k is None else groups.orderBy(F.desc("n"), "text").limit(k)


def duplicate_totals(memories: DataFrame) -> DataFrame:
    groups = memories.groupBy(normalised(F.col("raw_text")).alias("text")).agg(F.count("*").alias("n"))
    return groups.agg(F.count("*").alias("unique_texts"), F.sum(F.col("n") - 1).alias("surplus"))


def duplicate_members(memories: DataFrame, k: int | None = 10) -> DataFrame:
    """(text, memory_id, memory_type) of the largest groups: a row for each member, so no group is gathered."""
    groups = duplicate_groups(memories, k).select("text")
    return memories.select(normalised(F.col("raw_text")).alias("text"), "memory_id", "memory_type").join(groups, "text", "left_semi")


def busy_events(memories: DataFrame) -> DataFrame:
    """Events that gave more than one memory: event_id, n, their types."""
    counted = memories.where("event_id is not null").groupBy("event_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("memory_type")), "|").alias("types"))
    return counted.where("n > 1")
