"""Event and memory tables derived from the test tables, for queries and their oracles.

The expressions are plain SQL that Spark and DuckDB read alike; ``{k}`` is the
one place where they differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memjobs.sources.tables import dealt, written

AS_OF = "2024-02-15 00:00:00"

EV = {
    "event_id": "'evt_' || event_id",
    "project_id": "'proj_' || user_id",
    "session_id": "'sess_' || user_id || '_' || CAST(floor((day(ts) - 1) / 7.0) AS INT)",
    "timestamp": "CAST(ts AS TIMESTAMP)",
    "event_type": "CASE event_type WHEN 'signup' THEN 'user_message' WHEN 'view' THEN 'assistant_response' WHEN 'click' THEN 'tool_call' WHEN 'purchase' THEN 'code_change' ELSE 'error' END",
    "raw_text": """CASE event_type
 WHEN 'signup' THEN CASE k % 4 WHEN 0 THEN 'Decision: use engine' || m || ' for module store because it is faster'
   WHEN 1 THEN 'We need to fix src/mod' || m || '/api.py before release ' || k
   WHEN 2 THEN 'TypeError: bad value ' || k || ' in parser' || m
   ELSE 'We must add endpoint /api/v' || m || '/items and set CACHE_TTL_' || k END
 WHEN 'view' THEN CASE k % 4 WHEN 0 THEN 'I suggest we should use engine' || m || ' for module store'
   WHEN 1 THEN 'Root cause: pool too small. Fix: raise limit to ' || k || '. Verified: load test ok'
   WHEN 2 THEN 'Plan: refactor parser' || m || '. Which branch?'
   ELSE 'All good on step ' || k END
 WHEN 'click' THEN CASE k % 4 WHEN 0 THEN k || ' passed, ' || m || ' failed'
   WHEN 1 THEN 'src/mod' || m || '/api.py:' || k || ': error: bad type'
   WHEN 2 THEN 'HTTP/1.1 ' || (200 + 4 * k) || ' reply'
   ELSE 'TOTAL ' || k || '%' END
 WHEN 'purchase' THEN CASE k % 4 WHEN 0 THEN 'Updated src/mod' || m || '/file' || (k % 5) || '.py for release'
   WHEN 1 THEN 'Deploy to staging, branch: feature' || m
   WHEN 2 THEN 'Refactor module store'
   ELSE 'Added test for parser' || m END
 ELSE CASE k % 4 WHEN 0 THEN 'Test failed: assertion ' || k || ' in parser' || m
   WHEN 1 THEN 'Connection refused by engine' || m
   WHEN 2 THEN 'Build failed on step ' || k
   ELSE 'KeyError: field' || m || ' missing' END END""",
    "tool_name": "CASE k % 4 WHEN 0 THEN 'pytest' WHEN 1 THEN 'mypy' WHEN 2 THEN 'curl' ELSE 'coverage' END",
    "file_path": "'src/mod' || m || '/file' || (k % 5) || '.py'",
    "error_kind": "CASE k % 2 WHEN 0 THEN 'test_failure' ELSE 'runtime_error' END",
    "k": "k",
    "m": "m",
}

MEM = {
    "memory_id": "'mem_' || substr(event_id, 5)",
    "event_id": "event_id",
    "project_id": "project_id",
    "session_id": "session_id",
    "timestamp": "timestamp",
    "memory_type": "CASE event_type WHEN 'user_message' THEN CASE k % 4 WHEN 0 THEN 'decision' WHEN 1 THEN 'goal' WHEN 2 THEN 'error' ELSE 'intent' END WHEN 'error' THEN 'error' WHEN 'code_change' THEN 'code_change' WHEN 'tool_call' THEN 'fact' ELSE 'task' END",
    "source_type": "CASE event_type WHEN 'user_message' THEN 'user_message' WHEN 'assistant_response' THEN 'assistant_message' WHEN 'tool_call' THEN 'tool_output' WHEN 'code_change' THEN 'code_diff' ELSE 'runtime_error' END",
    "raw_text": "raw_text",
    "compressed_summary": "substr(raw_text, 1, 40)",
    "semantic_summary": "CASE WHEN k % 3 = 0 THEN NULL ELSE substr(raw_text, 1, 60) END",
    "importance_score": "CAST((k % 10) / 10.0 AS DOUBLE)",
    "confidence_score": "CAST(CASE event_type WHEN 'user_message' THEN 0.9 WHEN 'tool_call' THEN 0.85 WHEN 'error' THEN 0.3 ELSE 0.5 END AS DOUBLE)",
    "recency_score": "CAST(1.0 - (k % 5) / 10.0 AS DOUBLE)",
    "validity": "CASE WHEN k % 11 = 0 THEN 'superseded' WHEN k % 13 = 0 THEN 'proposed' WHEN k % 17 = 0 THEN 'rejected' ELSE 'active' END",
    "stability": "CASE WHEN k % 10 = 1 THEN 'canonical' WHEN k % 10 = 2 THEN 'stable' ELSE 'ephemeral' END",
    "never_delete": "k % 19 = 0",
    "file_ref": "CASE WHEN event_type IN ('code_change', 'error') THEN file_path END",
    "k": "k",
    "m": "m",
}


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())


#: The same views for DuckDB: put in front of an oracle's own common tables.
EV_SQL = f"raw AS (SELECT *, json_extract_string(props, '$.k')::INT AS k, json_extract_string(props, '$.k')::INT % 7 AS m FROM events), ev AS (SELECT {_select(EV)} FROM raw)"
MEM_SQL = f"{EV_SQL}, mem AS (SELECT {_select(MEM)} FROM ev)"
LINKS_SQL = (
    f"{MEM_SQL}, prev AS (SELECT memory_id, k, lag(memory_id) OVER (PARTITION BY session_id ORDER BY timestamp, memory_id) AS target_id FROM mem), "
    "links AS (SELECT memory_id AS source_id, target_id, 'same_session' AS relation_type, 0.9::DOUBLE AS confidence FROM prev WHERE target_id IS NOT NULL AND k % 23 <> 0)"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev_of(events: DataFrame) -> DataFrame:
    """The event log of an ``events`` table or stream."""
    raw = events.withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("m", F.col("k") % 7)
    return raw.selectExpr(*[f"{sql} AS {name}" for name, sql in EV.items()])


def mem_of(log: DataFrame) -> DataFrame:
    rows = log.selectExpr(*[f"{sql} AS {name}" for name, sql in MEM.items()])
    return rows.withColumn("file_references", F.when(F.col("file_ref").isNull(), F.expr("CAST(array() AS array<string>)")).otherwise(F.array("file_ref"))).drop("file_ref")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev_of(table(spark, sf_dir, "events"))


def mem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mem_of(ev(spark, sf_dir))


def mem_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mem`` derived once, for queries that read it often, from events dealt over tasks: a file of few row groups would else be derived by as few, each time."""
    return written(mem_of(ev_of(dealt(table(spark, sf_dir, "events"), "event_id"))))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    previous = F.lag("memory_id").over(Window.partitionBy("session_id").orderBy("timestamp", "memory_id"))
    rows = mem(spark, sf_dir).select("memory_id", "k", previous.alias("target_id")).where("target_id is not null and k % 23 <> 0")
    return rows.select(F.col("memory_id").alias("source_id"), "target_id", F.lit("same_session").alias("relation_type"), F.lit(0.9).alias("confidence"))


CORRECTIONS_SQL = (
    f"{MEM_SQL}, corrections AS (SELECT memory_id, project_id, CASE k % 7 WHEN 0 THEN 'stale' WHEN 1 THEN 'incorrect' WHEN 2 THEN 'important' WHEN 3 THEN 'duplicate' WHEN 4 THEN 'pin' WHEN 5 THEN 'unpin' ELSE 'delete' END AS action, "
    "timestamp + INTERVAL 1 DAY AS at FROM mem WHERE k % 5 = 0)"
)


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.expr("CASE k % 7 WHEN 0 THEN 'stale' WHEN 1 THEN 'incorrect' WHEN 2 THEN 'important' WHEN 3 THEN 'duplicate' WHEN 4 THEN 'pin' WHEN 5 THEN 'unpin' ELSE 'delete' END")
    return mem(spark, sf_dir).where("k % 5 = 0").select("memory_id", "project_id", action.alias("action"), F.expr("timestamp + INTERVAL 1 DAY").alias("at"))
