"""Readers: session logs, commits and source trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG = "event_type string, timestamp timestamp, raw_text string, tool_name string, file_path string"
ENDINGS = ("py", "js", "ts", "rs", "go", "java", "c", "cpp", "h", "hpp")
SKIPPED = ("node_modules", "target", "__pycache__")


def read_session_logs(spark: SparkSession, path: str, project_id: str, session_id: str) -> DataFrame:
    """JSON-lines logs to events; ids follow line order in each file; blank lines are skipped."""
    rows = spark.read.schema(LOG).json(path).where("event_type is not null").withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id()})
    place = F.row_number().over(Window.partitionBy("_file").orderBy("_block", "_id")) - 1
    event_id = F.concat(F.lit(f"evt_{session_id}_"), F.lpad(place.cast("string"), 3, "0"))
    payload = F.map_filter(F.create_map(F.lit("content"), "raw_text", F.lit("tool_name"), "tool_name", F.lit("file_path"), "file_path"), lambda _, v: v.isNotNull())
    return rows.select(event_id.alias("event_id"), F.lit(project_id).alias("project_id"), F.lit(session_id).alias("session_id"), "timestamp", "event_type", "raw_text", payload.alias("payload"))


def read_source_files(spark: SparkSession, root: str) -> DataFrame:
    """file_path, content of source files below ``root``; skipped folders and bytes that are not UTF-8 are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(ENDINGS) + "}").load(root)
    for part in SKIPPED:
        files = files.where(~F.col("path").contains(part))
    valid = files.where(F.is_valid_utf8(F.col("content").cast("string")))
    return valid.select(F.col("path").alias("file_path"), F.col("content").cast("string").alias("content"))


def commits_to_events(commits: DataFrame) -> DataFrame:
    """commits (repo, i, subject, files array, stat, base timestamp): a message for each, and a change 30 s later where files changed."""
    at = F.col("base") + F.make_dt_interval(mins=F.col("i").cast("int"))
    said = F.struct(F.lit("user_message").alias("event_type"), F.col("subject").alias("raw_text"), at.alias("timestamp"))
    body = F.concat(F.lit("Changed files: "), F.array_join(F.slice("files", 1, 5), ", "), F.lit("\n"), F.substring(F.coalesce("stat", F.lit("")), 1, 500))
    changed = F.when(F.size("files") > 0, F.struct(F.lit("code_change").alias("event_type"), body.alias("raw_text"), (at + F.make_dt_interval(secs=F.lit(30))).alias("timestamp")))
    return commits.select("repo", "i", F.explode(F.array_compact(F.array(said, changed))).alias("e")).select("repo", "i", "e.*")


def _most_frequent(words: Column, k: int) -> Column:
    """The k most frequent words, equally frequent ones in order: a fold over the sorted words that holds k runs."""
    run = "struct<n:int,word:string>"
    start = F.struct(F.lit("").alias("word"), F.lit(0).alias("n"), F.array().cast(f"array<{run}>").alias("best"))

    def held(state: Column) -> Column:
        own = F.struct((-state["n"]).alias("n"), state["word"].alias("word"))
        return F.when(state["n"] == 0, state["best"]).otherwise(F.slice(F.array_sort(F.concat(state["best"], F.array(own))), 1, k))

    def step(state: Column, word: Column) -> Column:
        same = state["word"] == word
        return F.struct(word.alias("word"), F.when(same, state["n"] + 1).otherwise(1).alias("n"), F.when(same, state["best"]).otherwise(held(state)).alias("best"))

    return F.transform(F.aggregate(F.array_sort(words), start, step, held), lambda x: x["word"])


def commit_windows(commits: DataFrame, size: int, step: int | None = None) -> DataFrame:
    """Full overlapping windows of each repo's commits in order: repo, start, goals (first three subjects), query (three most frequent long words).

    A repo's commits are sorted once; a window's words are counted inside its row.
    """
    step = step or max(1, size // 2)
    order = Window.partitionBy("repo").orderBy("i")
    ahead = F.collect_list(F.struct("subject")).over(order.rowsBetween(0, size - 1))
    rows = commits.select("repo", (F.row_number().over(order) - 1).alias("start"), ahead.alias("ahead"))
    full = rows.where((F.col("start") % step == 0) & (F.size("ahead") == size)).select("repo", "start", F.col("ahead.subject").alias("subjects"))
    words = F.filter(F.regexp_extract_all(F.lower(F.array_join("subjects", " ")), F.lit(r"\S+"), F.lit(0)), lambda x: F.length(x) > 3)
    return full.select("repo", F.col("start").cast("long").alias("start"), F.slice("subjects", 1, 3).alias("goals"), F.array_join(_most_frequent(words, 3), " ").alias("query"))
