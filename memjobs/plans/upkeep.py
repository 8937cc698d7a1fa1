"""Queries over ledgers, lifecycle and health, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from memjobs.operators import health, ledger, lifecycle
from memjobs.plans import writing
from memjobs.plans.registry import registry
from memjobs.sources import tables, views
from memjobs.sources.views import AS_OF, CORRECTIONS_SQL, EV_SQL, LINKS_SQL, MEM_SQL

QUERIES, ORACLES, query = registry()
_RANK = "ORDER BY recency_score DESC, importance_score DESC, timestamp DESC, memory_id"


@query("a2_events_for", f"WITH {EV_SQL} SELECT event_id, project_id, raw_text FROM ev WHERE project_id = 'proj_3' ORDER BY timestamp DESC, event_id DESC LIMIT 40")
def _(spark, d):
    return ledger.events_for(views.ev(spark, d), project_id="proj_3", limit=40).select("event_id", "project_id", "raw_text")


@query("a3_upsert", f"WITH {EV_SQL} SELECT session_id, project_id, max_by(event_type, (timestamp, event_id)) AS event_type, left(max(timestamp)::VARCHAR, 19) AS at FROM ev GROUP BY ALL")
def _(spark, d):
    rows = views.ev(spark, d).select("session_id", "project_id", "event_type", F.struct("timestamp", "event_id").alias("at"))
    base, updates = rows.where("day(at.timestamp) < 15"), rows.where("day(at.timestamp) >= 15")
    return ledger.upsert(base, updates, ["session_id", "project_id"], "at").select("session_id", "project_id", "event_type", F.date_format("at.timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("a4_delete_memories", f"WITH {LINKS_SQL}, gone AS (SELECT memory_id FROM mem WHERE k % 9 = 0) SELECT source_id, target_id FROM links WHERE source_id NOT IN (FROM gone) AND target_id NOT IN (FROM gone)")
def _(spark, d):
    memories = views.mem(spark, d)
    return ledger.delete_memories(memories, views.links(spark, d), memories.where("k % 9 = 0"))[1].select("source_id", "target_id")


@query("b1_top_memories", f"WITH {MEM_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY project_id, memory_type {_RANK}) AS rank FROM mem) SELECT project_id, memory_type, memory_id, rank FROM r WHERE rank <= 5")
def _(spark, d):
    return ledger.top_memories(views.mem(spark, d), ("project_id", "memory_type"), k=5).select("project_id", "memory_type", "memory_id", F.col("rank").cast("long").alias("rank"))


@query("b2_decision_ledger", f"WITH {MEM_SQL} SELECT project_id, memory_id FROM mem WHERE memory_type = 'decision' AND validity = 'proposed' QUALIFY row_number() OVER (PARTITION BY project_id {_RANK}) <= 50")
def _(spark, d):
    return ledger.decision_ledger(views.mem(spark, d), "proposed").select("project_id", "memory_id")


@query("b3_error_ledger", f"WITH {MEM_SQL}, t AS (SELECT * FROM mem WHERE memory_type = 'error' QUALIFY row_number() OVER (PARTITION BY project_id {_RANK}) <= 100) SELECT memory_id FROM t WHERE k % 2 = 0")
def _(spark, d):
    kind = F.when(F.col("k") % 2 == 0, "test_failure").otherwise("runtime_error")
    rows = views.mem(spark, d).withColumn("errors_found", F.array(F.struct(kind.alias("kind"))))
    return ledger.error_ledger(rows, "test_failure").select("memory_id")


@query("b4_search_by_path", f"WITH {MEM_SQL}, t AS (SELECT * FROM mem WHERE memory_type = 'code_change' QUALIFY row_number() OVER (PARTITION BY project_id {_RANK}) <= 200) SELECT memory_id, file_ref FROM t WHERE contains(file_ref, 'mod3/')")
def _(spark, d):
    return ledger.search_by_path(views.mem(spark, d), "mod3/").select("memory_id", F.col("file_references")[0].alias("file_ref"))


@query(
    "b5_project_overview",
    f"""WITH {MEM_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY project_id, memory_type {_RANK}) AS n FROM mem)
SELECT project_id, least(count(*), 10000)::BIGINT AS total, count(*) FILTER (WHERE memory_type = 'decision' AND validity = 'active')::BIGINT AS active_decisions,
 string_agg(compressed_summary, '|' ORDER BY n) FILTER (WHERE memory_type = 'error' AND n <= 10) AS recent_errors,
 string_agg(compressed_summary, '|' ORDER BY n) FILTER (WHERE memory_type = 'goal' AND n <= 20) AS goals FROM r GROUP BY project_id""",
)
def _(spark, d):
    rows = ledger.project_overview(views.mem(spark, d))
    return rows.select("project_id", "total", "active_decisions", F.array_join("recent_errors", "|").alias("recent_errors"), F.array_join("goals", "|").alias("goals"))


_SESSIONS = f"{EV_SQL}, sessions AS (SELECT session_id, project_id, CASE WHEN count(*) % 3 = 0 THEN 'closed' ELSE 'active' END AS status, max(timestamp) AS last_active FROM ev GROUP BY ALL)"


def _sessions(spark, d):
    status = F.when(F.count("*") % 3 == 0, "closed").otherwise("active")
    return views.ev(spark, d).groupBy("session_id", "project_id").agg(status.alias("status"), F.max("timestamp").alias("last_active"))


@query("b6_sessions_by_status", f"WITH {_SESSIONS} SELECT session_id, project_id FROM sessions WHERE status = 'closed'")
def _(spark, d):
    return ledger.sessions_by_status(_sessions(spark, d), "closed").select("session_id", "project_id")


@query("b6_latest_checkpoint", f"WITH {EV_SQL} SELECT session_id, event_id FROM ev WHERE event_type = 'code_change' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY timestamp DESC) = 1")
def _(spark, d):
    return ledger.latest_per(views.ev(spark, d).where("event_type = 'code_change'"), "session_id", "timestamp").select("session_id", "event_id")


@query("b7_marked_stale", f"WITH {MEM_SQL} SELECT memory_id, validity FROM mem WHERE memory_id IN (SELECT memory_id FROM mem WHERE validity = 'superseded' AND k % 2 = 0)")
def _(spark, d):
    rows = views.mem(spark, d)
    return ledger.marked_stale(rows, rows.where("validity = 'superseded' and k % 2 = 0")).select("memory_id", "validity")


_AGE = f"floor((epoch(TIMESTAMP '{AS_OF}') - epoch(timestamp)) / 86400)"


@query(
    "h1_decay",
    f"""WITH {MEM_SQL}, a AS (SELECT *, {_AGE} AS age, coalesce(MAP {{'decision': 90, 'error': 60, 'fact': 30, 'intent': 14, 'code_change': 45, 'task': 30}}[memory_type], 30) AS half FROM mem)
SELECT memory_id, round(power(0.5, age / half), 9) AS factor, CASE WHEN never_delete THEN 'pinned' WHEN validity = 'superseded' THEN CASE WHEN age > 30 THEN 'archived' END
 WHEN importance_score < 0.3 AND age > 14 THEN 'archived' ELSE 'unchanged' END AS fate FROM a""",
)
def _(spark, d):
    return lifecycle.decay(views.mem(spark, d), AS_OF).select("memory_id", F.round("factor", 9).alias("factor"), "fate")


_KEPT = "gone AS (SELECT memory_id FROM mem WHERE NOT never_delete QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY importance_score DESC, recency_score DESC, timestamp DESC, memory_id) > 30)"


@query("h2_retention", f"WITH {LINKS_SQL}, {_KEPT} SELECT source_id, target_id FROM links WHERE source_id NOT IN (FROM gone) AND target_id NOT IN (FROM gone)")
def _(spark, d):
    return lifecycle.retention(views.ev(spark, d), views.mem(spark, d), views.links(spark, d), AS_OF, max_per_project=30)[2].select("source_id", "target_id")


@query("h2_retention_events", f"WITH {EV_SQL} SELECT event_id FROM ev WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY")
def _(spark, d):
    return lifecycle.retention(views.ev(spark, d), views.mem(spark, d), views.links(spark, d), AS_OF, max_age_days=30)[0].select("event_id")


@query(
    "h3_apply_corrections",
    f"""WITH {CORRECTIONS_SQL} SELECT m.memory_id,
 CASE action WHEN 'stale' THEN 'superseded' WHEN 'incorrect' THEN 'disputed' WHEN 'duplicate' THEN 'archived' ELSE validity END AS validity,
 round(CASE WHEN action = 'important' THEN least(1.0, CASE WHEN importance_score = 0 THEN 0.5 ELSE importance_score END + 0.2) ELSE importance_score END, 6) AS importance_score,
 CASE WHEN action IN ('important', 'pin') THEN true WHEN action = 'unpin' THEN false ELSE never_delete END AS never_delete
FROM mem m LEFT JOIN corrections c ON m.memory_id = c.memory_id WHERE coalesce(action, '') <> 'delete'""",
)
def _(spark, d):
    out = lifecycle.apply_corrections(views.mem(spark, d), views.corrections(spark, d))
    return out.select("memory_id", "validity", F.round("importance_score", 6).alias("importance_score"), "never_delete")


@query("h4_correction_stats", f"WITH {CORRECTIONS_SQL} SELECT project_id, action, count(*) AS n FROM corrections GROUP BY ROLLUP (project_id, action) HAVING project_id IS NOT NULL")
def _(spark, d):
    return lifecycle.correction_stats(views.corrections(spark, d), views.mem(spark, d))


@query("h4_correction_history", f"WITH {CORRECTIONS_SQL} SELECT project_id, memory_id, action, row_number() OVER (PARTITION BY project_id ORDER BY \"at\" DESC, memory_id) AS place FROM corrections")
def _(spark, d):
    return lifecycle.correction_history(views.corrections(spark, d), views.mem(spark, d)).select("project_id", "memory_id", "action", F.col("place").cast("long").alias("place"))


@query(
    "h5_review_queue",
    f"""WITH {CORRECTIONS_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY project_id {_RANK}) AS rank FROM mem),
q AS (SELECT * FROM t WHERE rank <= 200 AND confidence_score > 0 AND confidence_score < 0.5 AND memory_id NOT IN (SELECT memory_id FROM corrections))
SELECT memory_id, row_number() OVER (PARTITION BY project_id ORDER BY rank) AS place FROM q QUALIFY place <= 20""",
)
def _(spark, d):
    return lifecycle.review_queue(views.mem(spark, d), views.corrections(spark, d)).select("memory_id", F.col("place").cast("long").alias("place"))


@query("h6_stale_files", f"WITH {MEM_SQL} SELECT memory_id, file_ref AS file FROM mem WHERE memory_type = 'code_change' AND file_ref NOT IN (SELECT file_ref FROM mem WHERE file_ref IS NOT NULL AND m < 4)")
def _(spark, d):
    rows = views.mem(spark, d)
    return lifecycle.stale_files(rows, rows.where("m < 4").select(F.explode("file_references").alias("file")))


@query("h7_old_decisions", f"WITH {MEM_SQL} SELECT memory_id, {_AGE}::BIGINT AS age_days FROM mem WHERE memory_type = 'decision' AND validity = 'active' AND {_AGE} > 30")
def _(spark, d):
    return lifecycle.old_decisions(views.mem(spark, d), AS_OF).select("memory_id", "age_days")


_ACTIONS = """dec AS (SELECT *, lead(memory_id) OVER (PARTITION BY project_id ORDER BY timestamp, memory_id) AS next FROM mem WHERE memory_type = 'decision'),
act AS (SELECT memory_id, CASE WHEN k % 3 = 0 AND next IS NOT NULL THEN 'supersede' WHEN k % 3 = 1 THEN 'reject' ELSE 'confirm' END AS action, CASE WHEN k % 3 = 0 THEN next END AS other_id FROM dec)"""


@query(
    "h8_decision_actions",
    f"""WITH {MEM_SQL}, {_ACTIONS} SELECT m.memory_id, CASE action WHEN 'supersede' THEN 'superseded' WHEN 'reject' THEN 'rejected' ELSE CASE WHEN validity = 'proposed' THEN 'active' ELSE validity END END AS validity,
 CASE WHEN action = 'supersede' THEN a.other_id END AS child_id, p.parent_id FROM dec m JOIN act a ON m.memory_id = a.memory_id
 LEFT JOIN (SELECT other_id, min(memory_id) AS parent_id FROM act WHERE action = 'supersede' GROUP BY other_id) p ON m.memory_id = p.other_id""",
)
def _(spark, d):
    from pyspark.sql import Window

    decisions = views.mem(spark, d).where("memory_type = 'decision'").withColumn("next", F.lead("memory_id").over(Window.partitionBy("project_id").orderBy("timestamp", "memory_id")))
    action = F.expr("CASE WHEN k % 3 = 0 AND next IS NOT NULL THEN 'supersede' WHEN k % 3 = 1 THEN 'reject' ELSE 'confirm' END")
    actions = decisions.select("memory_id", action.alias("action"), F.expr("CASE WHEN k % 3 = 0 THEN next END").alias("other_id"))
    return lifecycle.decision_actions(decisions, actions).select("memory_id", "validity", "child_id", "parent_id")


@query(
    "h8_add_verified_fix",
    f"""WITH {writing._ROWS} SELECT event_id, source_type, CASE WHEN event_type = 'assistant_response' THEN 'load test ok' ELSE 'patch ' || event_id END AS verified, 'Verified fix: patch ' || event_id AS lesson FROM found WHERE memory_type = 'error'""",
)
def _(spark, d):
    from memjobs.operators import extract

    rows = tables.written(extract.extract_memories(views.ev(spark, d)).where("memory_type = 'error'"))  # read by the fixes too
    fixes = rows.select("memory_id", F.concat(F.lit("patch "), "event_id").alias("fix"))
    out = lifecycle.add_verified_fix(rows, fixes)
    return out.select("event_id", "source_type", F.get("errors_found", F.lit(0))["verified_fix"].alias("verified"), F.array_join("lessons_learned", "|").alias("lesson"))


@query("d7_orphans", f"WITH {LINKS_SQL} SELECT memory_id FROM mem WHERE memory_id NOT IN (SELECT source_id FROM links UNION SELECT target_id FROM links)")
def _(spark, d):
    return health.orphans(views.mem(spark, d), views.links(spark, d)).select("memory_id")


@query(
    "k1_store_stats",
    f"WITH {MEM_SQL} SELECT (SELECT count(*) FROM ev) AS events, count(*) AS memories, count(DISTINCT project_id) AS projects, count(DISTINCT session_id) AS sessions, count(*) FILTER (WHERE validity = 'superseded') AS superseded, count(*) FILTER (WHERE validity = 'stale') AS stale FROM mem",
)
def _(spark, d):
    return health.store_stats(views.ev(spark, d), views.mem(spark, d))


@query("k1_type_counts", f"WITH {MEM_SQL} SELECT memory_type, count(*) AS n FROM mem GROUP BY 1")
def _(spark, d):
    return health.type_counts(views.mem(spark, d))


_NORM = "lower(trim(regexp_replace(raw_text, '\\s+', ' ', 'g')))"


@query(
    "k2_health_snapshot",
    f"""WITH {LINKS_SQL}, a AS (SELECT *, (epoch(TIMESTAMP '{AS_OF}') - epoch(timestamp)) / 86400 AS age FROM mem),
g AS (SELECT count(*) AS n FROM mem GROUP BY {_NORM} HAVING count(*) > 1),
s AS (SELECT count(*) AS memories, count(*) FILTER (WHERE validity = 'active') AS active, count(*) FILTER (WHERE validity = 'superseded') AS superseded, count(*) FILTER (WHERE validity = 'proposed') AS proposed, count(*) FILTER (WHERE validity = 'rejected') AS rejected,
 round(avg(age), 2) AS avg_days, round(max(age), 2) AS max_days, round(min(age), 2) AS min_days, count(*) FILTER (WHERE memory_type = 'error') AS errors, count(*) FILTER (WHERE memory_type = 'error' AND age < 7) AS errors_7d,
 count(*) FILTER (WHERE memory_type = 'decision' AND validity = 'active') AS active_decisions,
 (SELECT count(*) FROM ev WHERE (epoch(TIMESTAMP '{AS_OF}') - epoch(timestamp)) / 86400 < 1) AS events_1d, (SELECT count(*) FROM ev WHERE (epoch(TIMESTAMP '{AS_OF}') - epoch(timestamp)) / 86400 < 30) AS events_30d,
 (SELECT count(*) FROM mem WHERE memory_id NOT IN (SELECT source_id FROM links UNION SELECT target_id FROM links)) AS orphans,
 (SELECT count(*) FROM g) AS duplicate_groups, (SELECT coalesce(sum(n), 0)::BIGINT FROM g) AS duplicate_memories FROM a)
SELECT *, round(orphans / memories, 3) AS orphan_ratio, greatest(0.0, round(1.0 - CASE WHEN orphans / memories > 0.5 THEN 0.2 WHEN orphans / memories > 0.2 THEN 0.1 ELSE 0 END - CASE WHEN duplicate_groups > 0 THEN 0.1 ELSE 0 END - CASE WHEN superseded / memories > 0.3 THEN 0.1 ELSE 0 END, 2))::DOUBLE AS score FROM s""",
)
def _(spark, d):
    row = health.health_snapshot(views.ev(spark, d), views.mem(spark, d), views.links(spark, d), AS_OF)
    return row.select("memories", "active", "superseded", "proposed", "rejected", "avg_days", "max_days", "min_days", "errors", "errors_7d", "active_decisions", "events_1d", "events_30d", "orphans", "duplicate_groups", "duplicate_memories", "orphan_ratio", "score")


@query("k2_largest_projects", f"WITH {MEM_SQL} SELECT project_id, count(*) AS n FROM mem GROUP BY 1 ORDER BY n DESC, project_id LIMIT 20")
def _(spark, d):
    return health.largest_projects(views.mem(spark, d))


_HOURS = "(epoch(TIMESTAMP '2024-01-29 12:00:00') - epoch(timestamp)) / 3600"


@query(
    "k3_dashboard_metrics",
    f"""WITH {LINKS_SQL} SELECT (SELECT count(*) FROM ev WHERE {_HOURS} < 1) AS events_hour, count(*) FILTER (WHERE {_HOURS} < 1) AS memories_hour, count(*) AS memories, count(*) FILTER (WHERE memory_type = 'error' AND {_HOURS} < 24) AS errors_day,
 count(*) FILTER (WHERE validity = 'disputed') AS disputed, count(*) FILTER (WHERE validity = 'superseded') AS stale, (SELECT count(DISTINCT source_id) FROM links) AS linked, count(*) FILTER (WHERE k % 5 = 0) AS corrections,
 round((SELECT count(DISTINCT source_id) FROM links) / count(*), 3) AS link_ratio FROM mem""",
)
def _(spark, d):
    return health.dashboard_metrics(views.ev(spark, d), views.mem(spark, d), views.links(spark, d), views.corrections(spark, d), "2024-01-29 12:00:00")


@query("k4_project_breakdown", f"WITH {MEM_SQL} SELECT project_id, memory_type, validity, count(*) AS n FROM mem GROUP BY GROUPING SETS ((project_id), (project_id, memory_type), (project_id, validity))")
def _(spark, d):
    return health.project_breakdown(views.mem(spark, d))


@query("k4_symbols_by_type", f"{writing.ORACLES['c17_extract_symbols'].rsplit('SELECT project_id', 1)[0]}, x AS (SELECT project_id, symbol, arg_min(symbol_type, (memory_id, rank)) AS symbol_type FROM s GROUP BY ALL) SELECT project_id, symbol_type, count(*) AS n FROM x GROUP BY ALL")
def _(spark, d):
    from memjobs.operators import extract

    return health.symbol_breakdown(extract.extract_symbols(views.mem(spark, d)))


@query("k4_newest_events", f"WITH {EV_SQL} SELECT project_id, event_id, row_number() OVER (PARTITION BY project_id ORDER BY timestamp DESC, event_id DESC) AS place FROM ev QUALIFY place <= 5")
def _(spark, d):
    return health.newest_events(views.ev(spark, d)).select("project_id", "event_id", F.col("place").cast("long").alias("place"))


@query("k5_duplicate_report", f"WITH {MEM_SQL} SELECT {_NORM} AS text, count(*) AS n, string_agg(DISTINCT memory_type, '|' ORDER BY memory_type) AS types, min(memory_id) AS first_id FROM mem GROUP BY 1 HAVING n > 1 ORDER BY n DESC, text LIMIT 10")
def _(spark, d):
    return health.duplicate_groups(views.mem(spark, d))


@query("k5_duplicate_members", f"WITH {MEM_SQL}, g AS (SELECT {_NORM} AS text, count(*) AS n FROM mem GROUP BY 1 HAVING n > 1 ORDER BY n DESC, text LIMIT 10) SELECT text, memory_id, memory_type FROM (SELECT {_NORM} AS text, memory_id, memory_type FROM mem) SEMI JOIN g USING (text)")
def _(spark, d):
    return health.duplicate_members(views.mem(spark, d))


@query("k5_busy_events", f"WITH {writing._ROWS} SELECT event_id, count(*) AS n, string_agg(DISTINCT memory_type, '|' ORDER BY memory_type) AS types FROM found GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    from memjobs.operators import extract

    return health.busy_events(extract.extract_memories(views.ev(spark, d)))


@query("k5_duplicate_documents", "WITH g AS (SELECT lower(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS t, count(*) AS n FROM documents GROUP BY 1) SELECT count(*) AS unique_texts, sum(n - 1)::BIGINT AS surplus FROM g")
def _(spark, d):
    return health.duplicate_totals(views.table(spark, d, "documents").select(F.col("text").alias("raw_text")))
