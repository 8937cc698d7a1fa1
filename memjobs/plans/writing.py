"""Queries over the write path: redaction, extraction, scoring, compression, symbols; with their oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from memjobs.functions import text as T
from memjobs.functions.sessions import extract_errors, extract_goals
from memjobs.operators import extract
from memjobs.plans.registry import registry
from memjobs.sources import views
from memjobs.sources.views import EV_SQL, MEM_SQL

QUERIES, ORACLES, query = registry()


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


def _redacted(column: str) -> str:
    def one(inner: str, rule) -> str:
        _, pattern, replacement = rule
        return f"regexp_replace({inner}, '{_sql(pattern)}', '{replacement.replace('$', chr(92))}', 'g')"

    return reduce(one, T.SECRETS, column)


@query("c1_redact_secrets", f"SELECT doc_id, {_redacted('text')} AS text FROM documents")
def _(spark, d):
    return views.table(spark, d, "documents").select("doc_id", T.redact_secrets(F.col("text")).alias("text"))


_TYPES = "concat_ws('|', " + ", ".join(f"CASE WHEN regexp_matches(text, '{_sql(p)}') THEN '{n}' END" for n, p, _ in T.SECRETS) + ")"


@query("c2_secret_types", f"SELECT doc_id, {_TYPES} AS types, {_TYPES} <> '' AS has_secrets FROM documents")
def _(spark, d):
    text = F.col("text")
    return views.table(spark, d, "documents").select("doc_id", F.array_join(T.secret_types(text), "|").alias("types"), T.has_secrets(text).alias("has_secrets"))


# What the rules give on the derived event texts, told from their templates.
_ROWS = f"""{EV_SQL}, found AS (
SELECT *, 'event' AS memory_type, CASE WHEN event_type = 'tool_call' THEN 'tool_output' ELSE 'user_message' END AS source_type, raw_text AS summary FROM ev
UNION ALL SELECT *, 'intent', 'user_message', 'User intent: ' || raw_text FROM ev WHERE event_type = 'user_message'
UNION ALL SELECT *, 'decision', 'user_message', raw_text FROM ev WHERE event_type = 'user_message' AND k % 4 = 0
UNION ALL SELECT *, 'goal', 'user_message', 'Goal: ' || regexp_extract(raw_text, '^We (need to|must) (.*)$', 2) FROM ev WHERE event_type = 'user_message' AND k % 4 IN (1, 3)
UNION ALL SELECT *, 'requirement', 'user_message', 'Requirement: ' || raw_text FROM ev WHERE event_type = 'user_message' AND k % 4 IN (1, 3)
UNION ALL SELECT *, 'error', 'user_message', 'Error: ' || substr(raw_text, 12) FROM ev WHERE event_type = 'user_message' AND k % 4 = 2
UNION ALL SELECT *, 'task', 'user_message', 'Task: ' || raw_text FROM ev WHERE event_type = 'user_message' AND k % 4 = 3
UNION ALL SELECT *, 'task', 'assistant_message', 'Assistant plan: ' || raw_text FROM ev WHERE event_type = 'assistant_response'
UNION ALL SELECT *, 'decision', 'assistant_message', 'Proposed decision: ' || raw_text FROM ev WHERE event_type = 'assistant_response' AND k % 4 = 0
UNION ALL SELECT *, 'error', 'assistant_message', 'Error fix: ' || raw_text FROM ev WHERE event_type = 'assistant_response' AND k % 4 = 1
UNION ALL SELECT *, 'uncertainty', 'assistant_message', NULL FROM ev WHERE event_type = 'assistant_response' AND k % 4 = 2
UNION ALL SELECT *, 'fact', 'test_result', 'Test result (pytest): ' || raw_text FROM ev WHERE event_type = 'tool_call' AND k % 4 = 0
UNION ALL SELECT *, 'error', 'tool_output', 'Error: ' || raw_text FROM ev WHERE event_type = 'tool_call' AND k % 4 < 2
UNION ALL SELECT *, 'code_change', 'code_diff', raw_text FROM ev WHERE event_type = 'code_change'
UNION ALL SELECT *, 'error', 'runtime_error', 'Error (' || error_kind || '): ' || raw_text FROM ev WHERE event_type = 'error')"""


def _found(spark, d):
    return extract.extract_memories(views.ev(spark, d))


@query("c3_extract_memories", f"WITH {_ROWS} SELECT event_id, memory_type, source_type, summary FROM found")
def _(spark, d):
    return _found(spark, d).select("event_id", "memory_type", "source_type", F.col("compressed_summary").alias("summary"))


@query("c4_user_message_rules", f"WITH {_ROWS} SELECT event_id, memory_type, summary FROM found WHERE event_type = 'user_message' AND memory_type <> 'event'")
def _(spark, d):
    rows = extract.extract_memories(views.ev(spark, d).where("event_type = 'user_message'"))
    return rows.where("memory_type <> 'event'").select("event_id", "memory_type", F.col("compressed_summary").alias("summary"))


@query(
    "c5_assistant_rules",
    f"""WITH {_ROWS} SELECT event_id, memory_type, CASE WHEN memory_type IN ('task', 'decision') THEN 'proposed' ELSE 'active' END AS validity,
 CASE WHEN memory_type = 'error' THEN 'pool too small/raise limit to ' || k || '/load test ok' END AS fields FROM found WHERE event_type = 'assistant_response' AND memory_type <> 'event'""",
)
def _(spark, d):
    rows = extract.extract_memories(views.ev(spark, d).where("event_type = 'assistant_response'")).where("memory_type <> 'event'")
    e = F.get("errors_found", F.lit(0))
    fields = F.when(F.size("errors_found") > 0, F.concat_ws("/", e["root_cause"], e["fix_attempt"], e["verified_fix"]))
    return rows.select("event_id", "memory_type", "validity", fields.alias("fields"))


@query("c6_code_and_error_events", f"WITH {_ROWS} SELECT event_id, summary, CASE WHEN memory_type = 'code_change' THEN file_path END AS file, CASE WHEN memory_type = 'error' THEN error_kind END AS kind FROM found WHERE event_type IN ('code_change', 'error') AND memory_type <> 'event'")
def _(spark, d):
    rows = extract.extract_memories(views.ev(spark, d).where("event_type in ('code_change', 'error')")).where("memory_type <> 'event'")
    return rows.select("event_id", F.col("compressed_summary").alias("summary"), F.get("file_references", F.lit(0)).alias("file"), F.get("errors_found", F.lit(0))["kind"].alias("kind"))


@query("c9_extract_goals_errors")
def _(spark, d):
    text = F.col("text")
    rows = views.table(spark, d, "conversations").select("conv_id", "turn", extract_goals(text).alias("goals"), extract_errors(text).alias("errors"))
    return rows.select("conv_id", "turn", F.array_join("goals", "|").alias("goals"), F.array_join("errors", "|").alias("errors"))


@query(
    "c9_session_goals_errors",
    f"""WITH {EV_SQL} SELECT event_id, CASE WHEN event_type <> 'user_message' THEN NULL WHEN k % 4 = 1 THEN substr(raw_text, 12) || '|' || substr(raw_text, 16) WHEN k % 4 = 3 THEN substr(raw_text, 9) ELSE '' END AS goals,
 CASE WHEN event_type <> 'user_message' THEN NULL WHEN k % 4 = 2 THEN substr(raw_text, 12) ELSE '' END AS errors FROM ev WHERE event_type = 'user_message'""",
)
def _(spark, d):
    text = F.col("raw_text")
    rows = views.ev(spark, d).where("event_type = 'user_message'").select("event_id", F.coalesce(extract_goals(text), F.array()).alias("goals"), F.coalesce(extract_errors(text), F.array()).alias("errors"))
    return rows.select("event_id", F.array_join("goals", "|").alias("goals"), F.array_join("errors", "|").alias("errors"))


@query(
    "c10_extract_fields",
    f"""WITH {EV_SQL} SELECT event_id, trim(regexp_extract(raw_text, '(?i)(?:Rationale|Because|Reason)[\\s:—]+([^\\n.]{{10,200}})', 1)) AS rationale,
 CASE WHEN event_type = 'assistant_response' AND k % 4 = 1 THEN 'pool too small' WHEN event_type = 'user_message' AND k % 4 = 0 THEN 'it is faster' ELSE '' END AS root_cause, regexp_extract(raw_text, '[a-zA-Z0-9_/-]+\\.py') AS files FROM ev""",
)
def _(spark, d):
    t = F.col("raw_text")
    return views.ev(spark, d).select("event_id", T.field(t, "rationale").alias("rationale"), T.field(t, "root_cause").alias("root_cause"), F.array_join(T.file_refs(t), "|").alias("files"))


_SCORED = f"""{_ROWS}, scored AS (SELECT *, least(1.0, 0.5 + CASE memory_type WHEN 'decision' THEN 0.3 WHEN 'error' THEN 0.25 ELSE 0 END + CASE WHEN source_type = 'user_message' THEN 0.1 ELSE 0 END
 + CASE WHEN memory_type = 'code_change' OR (event_type = 'user_message' AND k % 4 = 1 AND memory_type <> 'event') THEN 0.05 ELSE 0 END + CASE WHEN memory_type = 'decision' THEN 0.1 ELSE 0 END) AS importance,
 CASE source_type WHEN 'user_message' THEN 0.9 WHEN 'tool_output' THEN 0.85 ELSE 0.5 END AS confidence FROM found)"""


@query("c12_score_memories", f"WITH {_SCORED} SELECT event_id, memory_type, round(importance, 6)::DOUBLE AS importance, confidence::DOUBLE AS confidence FROM scored")
def _(spark, d):
    rows = extract.score_memories(_found(spark, d))
    return rows.select("event_id", "memory_type", F.round("importance_score", 6).alias("importance"), F.col("confidence_score").alias("confidence"))


@query(
    "c13_write_memories",
    f"WITH {_SCORED} SELECT event_id, memory_type, project_id, round(importance, 6)::DOUBLE AS importance FROM scored QUALIFY row_number() OVER (PARTITION BY project_id, session_id, memory_type, lower(raw_text) ORDER BY timestamp, event_id) = 1",
)
def _(spark, d):
    rows = extract.write_memories(views.ev(spark, d))
    return rows.select("event_id", "memory_type", "project_id", F.round("importance_score", 6).alias("importance"))


def _matches(column: str, patterns) -> str:
    return "list_concat(" + ", ".join(f"regexp_extract_all({column}, '{_sql(p)}', {g})" for p, g in patterns) + ")"


def _joined_terms(column: str) -> str:
    parts = [f"regexp_extract_all({column}, '{_sql(p)}', 0)" for p in T.TERMS]
    camel = f"list_filter(regexp_extract_all({column}, '{T.CAMEL}', 0), lambda w: length(w) > 5 AND w NOT IN {T.PLAIN})"
    whole = reduce(lambda a, b: f"list_concat({a}, {b})", [*parts, camel])
    return f"array_to_string(list_sort(list_distinct({whole})), '|')"


@query("c14_protected_terms", f"WITH {EV_SQL} SELECT event_id, {_joined_terms('raw_text')} AS terms FROM ev")
def _(spark, d):
    return views.ev(spark, d).select("event_id", F.array_join(T.protected_terms(F.col("raw_text")), "|").alias("terms"))


_KEYS = reduce(lambda a, b: f"list_concat({a}, {b})", [f"regexp_extract_all(raw_text, '{_sql(p)}', {g})" for p, g in T.KEYWORDS])


@query("c15_protected_keywords", f"WITH {EV_SQL} SELECT event_id, array_to_string(list_sort(list_distinct({_KEYS}))[1:15], '|') AS keywords FROM ev")
def _(spark, d):
    return views.ev(spark, d).select("event_id", F.array_join(T.protected_keywords(F.col("raw_text")), "|").alias("keywords"))


@query(
    "c16_compress",
    f"""WITH {_ROWS} SELECT event_id, memory_type, '[' || upper(memory_type) || ']' || CASE WHEN memory_type = 'code_change' THEN ' Files: ' || file_path ELSE '' END
 || CASE WHEN memory_type = 'error' THEN ' Error (' || error_kind || '): ' || raw_text ELSE '' END || ' Summary: ' || left(summary, 150) AS body
FROM found WHERE event_type IN ('code_change', 'error')""",
)
def _(spark, d):
    rows = extract.extract_memories(views.ev(spark, d).where("event_type in ('code_change', 'error')"))
    return rows.select("event_id", "memory_type", extract.compress(2).alias("body"))


@query("c16_compress_plain", f"WITH {_ROWS} SELECT event_id, memory_type, raw_text AS whole, left(raw_text, 400) AS head FROM found")
def _(spark, d):
    return _found(spark, d).select("event_id", "memory_type", extract.compress(0).alias("whole"), extract.compress(1).alias("head"))


@query("c16_compress_semantic")
def _(spark, d):
    return _found(spark, d).select("event_id", "memory_type", extract.compress(3).alias("body"))


def _symbol(rank: int, kind: str, pattern: str) -> str:
    return f"SELECT project_id, memory_id, {rank} AS rank, '{kind}' AS symbol_type, unnest(regexp_extract_all(t, '{pattern}', 1)) AS symbol FROM src"


_SYMBOLS = " UNION ALL ".join(_symbol(i, k, p) for i, (k, p) in enumerate(extract.SYMBOLS.items()))


@query(
    "c17_extract_symbols",
    f"""WITH {MEM_SQL}, src AS (SELECT *, raw_text || ' ' || compressed_summary AS t FROM mem), s AS ({_SYMBOLS} UNION ALL SELECT project_id, memory_id, 5, 'file_path', file_ref FROM mem WHERE file_ref IS NOT NULL)
SELECT project_id, symbol, arg_min(symbol_type, (memory_id, rank)) AS symbol_type, count(DISTINCT memory_id) AS n_sources FROM s GROUP BY ALL""",
)
def _(spark, d):
    return extract.extract_symbols(views.mem(spark, d))
