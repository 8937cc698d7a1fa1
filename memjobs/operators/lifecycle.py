"""Decay, retention, corrections and decision actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memjobs.operators.ledger import delete_memories, top_memories

# Half-lives in days by memory type; others 30.
HALF_LIVES = {
    "decision": 90, "error": 60, "requirement": 120, "fact": 30, "intent": 14, "code_change": 45, "procedure": 180,
    "reflection": 90, "uncertainty": 7, "preference": 365, "task": 30, "checkpoint": 30, "event": 3,
}
ACTIONS = ("stale", "incorrect", "important", "duplicate", "pin", "unpin", "delete")


def age_days(as_of: str, column: str = "timestamp"):
    seconds = F.lit(as_of).cast("timestamp").cast("long") - F.col(column).cast("timestamp").cast("double")
    return F.floor(seconds / 86_400)


def decay(memories: DataFrame, as_of: str) -> DataFrame:
    """memory_id, project_id, fate (pinned, archived or unchanged; null for superseded rows that are kept), factor."""
    half = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in HALF_LIVES.items() for x in pair]), F.col("memory_type")), F.lit(30))
    aged = memories.withColumn("age", age_days(as_of))
    fate = (
        F.when(F.col("never_delete"), "pinned")
        .when(F.col("validity") == "superseded", F.when(F.col("age") > 30, "archived"))
        .when(F.col("memory_type") == "event", F.when(F.col("age") > 7, "archived"))
        .when((F.col("importance_score") < 0.3) & (F.col("age") > 14), "archived")
        .otherwise("unchanged")
    )
    return aged.select("memory_id", "project_id", fate.alias("fate"), F.pow(F.lit(0.5), F.col("age") / half).alias("factor"))


def retention(events: DataFrame, memories: DataFrame, links: DataFrame, as_of: str, max_age_days: int = 90, max_per_project: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events within the cutoff; pinned memories and the best others of each project; links between what is left."""
    kept_events = events.where(F.col("timestamp") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(max_age_days)))
    best = Window.partitionBy("project_id").orderBy(F.desc("importance_score"), F.desc("recency_score"), F.desc("timestamp"), "memory_id")
    gone = memories.where("not never_delete").withColumn("_n", F.row_number().over(best)).where(F.col("_n") > max_per_project)
    return kept_events, *delete_memories(memories, links, gone)


def apply_corrections(memories: DataFrame, corrections: DataFrame) -> DataFrame:
    """Memories after their corrections (memory_id, action, at), deleted ones dropped.

    Only actions before a delete count; those are folded without order where
    the result allows it: the last of stale, incorrect, duplicate gives the
    validity, the last of important, pin, unpin the pin, and each important
    adds 0.2 up to 1.
    """
    valid = corrections.where(F.col("action").isin(*ACTIONS))

    def last(actions: tuple[str, ...]):
        return F.max_by(F.when(F.col("action").isin(*actions), F.col("action")), F.when(F.col("action").isin(*actions), F.col("at")))

    folded = valid.groupBy("memory_id").agg(
        F.count_if(F.col("action") == "delete").alias("_deletes"),
        last(("stale", "incorrect", "duplicate")).alias("_validity"),
        last(("important", "pin", "unpin")).alias("_pin"),
        F.count_if(F.col("action") == "important").alias("_important"),
    )
    state = memories.join(folded, "memory_id", "left").where(F.coalesce(F.col("_deletes"), F.lit(0)) == 0)
    start = F.when(F.coalesce(F.col("importance_score"), F.lit(0.0)) == 0, 0.5).otherwise(F.col("importance_score"))
    raised = F.when(F.col("_important") > 0, F.least(F.lit(1.0), start + 0.2 * F.col("_important"))).otherwise(F.col("importance_score"))
    validity = F.when(F.col("_validity") == "stale", "superseded").when(F.col("_validity") == "incorrect", "disputed").when(F.col("_validity") == "duplicate", "archived").otherwise(F.col("validity"))
    pinned = F.when(F.col("_pin").isin("important", "pin"), True).when(F.col("_pin") == "unpin", False).otherwise(F.col("never_delete"))
    out = state.withColumns({"importance_score": raised, "validity": validity, "never_delete": pinned})
    return out.drop("_deletes", "_validity", "_pin", "_important")


def correction_stats(corrections: DataFrame, memories: DataFrame) -> DataFrame:
    """Counts by project and action, with a total row (null action); corrections of deleted memories don't count."""
    live = corrections.join(memories.select("memory_id"), "memory_id", "left_semi")
    return live.rollup("project_id", "action").count().where("project_id is not null").withColumnRenamed("count", "n")


def correction_history(corrections: DataFrame, memories: DataFrame) -> DataFrame:
    live = corrections.join(memories.select("memory_id"), "memory_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("at"), "memory_id"))
    return live.withColumn("place", place)


def review_queue(memories: DataFrame, corrections: DataFrame, limit: int = 20, look_at: int = 200) -> DataFrame:
    """Doubtful, never corrected memories among a project's best."""
    best = top_memories(memories, k=look_at).where("confidence_score > 0 and confidence_score < 0.5")
    open_rows = best.join(corrections.select("memory_id").distinct(), "memory_id", "left_anti")
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("rank"))
    return open_rows.withColumn("place", place).where(F.col("place") <= limit)


def stale_files(memories: DataFrame, listing: DataFrame) -> DataFrame:
    """(memory_id, file) of code changes whose file is not in ``listing`` (file)."""
    refs = memories.where("memory_type = 'code_change'").select("memory_id", F.explode("file_references").alias("file"))
    return refs.join(listing.select("file").distinct(), "file", "left_anti").select("memory_id", "file")


def old_decisions(memories: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    aged = memories.where("memory_type = 'decision' and validity = 'active'").withColumn("age_days", age_days(as_of))
    return aged.where(F.col("age_days") > days)


def decision_actions(memories: DataFrame, actions: DataFrame) -> DataFrame:
    """actions (memory_id, action, other_id): supersede by ``other_id``, reject, or confirm a proposed decision.

    Adds ``child_id`` on superseded rows and ``parent_id`` on their successors.
    """
    own = actions.select("memory_id", F.col("action").alias("_action"), F.col("other_id").alias("_other"))
    parents = actions.where("action = 'supersede'").groupBy(F.col("other_id").alias("memory_id")).agg(F.min("memory_id").alias("parent_id"))
    joined = memories.join(own, "memory_id", "left").join(parents, "memory_id", "left")
    validity = (
        F.when(F.col("_action") == "supersede", "superseded").when(F.col("_action") == "reject", "rejected")
        .when((F.col("_action") == "confirm") & (F.col("validity") == "proposed"), "active").otherwise(F.col("validity"))
    )
    child = F.when(F.col("_action") == "supersede", F.col("_other"))
    return joined.withColumn("validity", validity).withColumn("child_id", child).drop("_action", "_other")


def add_verified_fix(memories: DataFrame, fixes: DataFrame) -> DataFrame:
    """fixes (memory_id, fix): fills each empty ``verified_fix`` of the row's errors and appends a lesson; one fix a row, the first in order of text."""
    own = fixes.groupBy("memory_id").agg(F.min("fix").alias("_fix"))
    joined = memories.join(own, "memory_id", "left")
    told = F.transform("errors_found", lambda e: e.withField("verified_fix", F.when(F.coalesce(e["verified_fix"], F.lit("")) == "", F.col("_fix")).otherwise(e["verified_fix"])))
    none = F.array().cast("array<string>")
    lessons = F.coalesce("lessons_learned", none) if "lessons_learned" in memories.columns else none
    learned = F.array_append(lessons, F.concat(F.lit("Verified fix: "), F.substring("_fix", 1, 200)))
    fixed = F.col("_fix").isNotNull()
    return joined.withColumns({"errors_found": F.when(fixed, told).otherwise(F.col("errors_found")), "lessons_learned": F.when(fixed, learned).otherwise(lessons)}).drop("_fix")
