"""Queries over restored sessions, expanded packs and field coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from memjobs.operators import extract, packs, sessions, state
from memjobs.plans import evaluating, projects, relating
from memjobs.plans.registry import registry
from memjobs.plans.writing import _ROWS
from memjobs.sources import views
from memjobs.sources.tables import written

QUERIES, ORACLES, query = registry()


@query("f7_auto_expand")
def _(spark, d):
    return packs.flat_packs(sessions.auto_expand(written(relating._asks(spark, d)), views.mem_table(spark, d)))


@query("f10_restore_sessions")
def _(spark, d):
    memories = views.mem_table(spark, d)
    rows = written(memories.select("session_id", "project_id").distinct())
    return packs.flat_packs(sessions.restore_sessions(rows, memories))


@query(
    "m13_state_field_coverage",
    f"""WITH {projects._STATE}, {evaluating._SUMMARY.replace('o AS (', 'oo AS (', 1).replace('FROM o ', 'FROM oo ')}, w AS (SELECT project_id, lower(content) AS text FROM sp),
s AS (SELECT project_id, unnest([coalesce(ph, ''), coalesce(br, ''), coalesce(ts, ''), coalesce(ds, '')]) AS v FROM (SELECT project_id, arg_max(ph, ord) FILTER (WHERE ph IS NOT NULL) AS ph, arg_max(br, ord) FILTER (WHERE br IS NOT NULL) AS br, arg_max(ts, ord) FILTER (WHERE ts IS NOT NULL) AS ts, arg_max(ds, ord) FILTER (WHERE ds IS NOT NULL) AS ds FROM g GROUP BY 1)),
h AS (SELECT project_id, sum((lower(v) <> '' AND (contains(text, lower(v)) OR len(list_filter(string_split(lower(v), ' '), lambda x: length(x) > 4 AND contains(text, x))) > 0))::INT) AS n FROM s JOIN w USING (project_id) GROUP BY 1)
SELECT project_id, round(n / 8, 6) AS coverage FROM h""",
)
def _(spark, d):
    rows = views.mem(spark, d)
    text = packs.summary_packs(rows).select("project_id", F.lower("content").alias("text"))
    return sessions.state_field_coverage(state.project_state(rows), text).withColumn("coverage", F.round("coverage", 6))


@query(
    "m13_entry_field_coverage",
    f"""WITH {_ROWS} SELECT project_id, round(max((memory_type = 'decision' AND event_type = 'user_message')::INT) / 3, 6) AS decision_fields,
 round((2 * max((event_type = 'assistant_response' AND memory_type = 'error')::INT) + max((event_type = 'assistant_response' AND memory_type = 'error')::INT)) / 5, 6) AS error_fields FROM found GROUP BY project_id""",
)
def _(spark, d):
    rows = sessions.entry_field_coverage(extract.extract_memories(views.ev(spark, d)))
    return rows.select("project_id", F.round("decision_fields", 6).alias("decision_fields"), F.round("error_fields", 6).alias("error_fields"))
