"""Queries over packs and their evaluation, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memjobs.operators import evals, packs, retrieve, sessions, state
from memjobs.plans import relating
from memjobs.plans.registry import registry
from memjobs.sources import views
from memjobs.sources.tables import written
from memjobs.sources.views import MEM_SQL

QUERIES, ORACLES, query = registry()
_RANK = "ORDER BY recency_score DESC, importance_score DESC, timestamp DESC, memory_id"


def _requests(spark, d, tokens: int = 65, budget: int = 2000):
    asks = retrieve.make_plan(relating._asks(spark, d))
    return written(asks.withColumns({"token_budget": F.lit(budget), "max_pack_tokens": F.lit(tokens)}))


def _packs(spark, d, **options):
    memories, requests = views.mem_table(spark, d), _requests(spark, d)
    found = retrieve.retrieve(requests, memories)
    return packs.build_packs(requests, found, memories, states=state.state_slot(state.project_state(memories)), **options)


@query("f1_build_packs")
def _(spark, d):
    return packs.flat_packs(_packs(spark, d))


@query("f2_build_compact_packs")
def _(spark, d):
    return packs.flat_packs(_packs(spark, d, compact=True))


@query("f3_rescue_terms")
def _(spark, d):
    memories = views.mem_table(spark, d)
    requests = _requests(spark, d).withColumn("required_terms", F.array(F.lit("CACHE_TTL_7"), F.lit("field3")))
    return packs.flat_packs(packs.build_packs(requests, retrieve.retrieve(requests, memories), memories)).where("section = 'protected_evidence'")


# Packs that SQL can make too: the ten first rows of each request, in two sections.
_SECTIONED = f"""{relating._LISTS}, pr AS (SELECT request_id, memory_id, place, CASE WHEN place <= 5 THEN 'first_rows' ELSE 'rest' END AS section, raw_text, memory_type FROM fused JOIN mem USING (memory_id) WHERE place <= 10),
ps AS (SELECT request_id, section, string_agg(raw_text, chr(10) ORDER BY place) AS content FROM pr GROUP BY ALL)"""


def _sectioned(spark, d):
    rows = relating._fused(spark, d).where("place <= 10").join(views.mem(spark, d).select("memory_id", "raw_text"), "memory_id").withColumn("section", F.when(F.col("place") <= 5, "first_rows").otherwise("rest"))
    parts = rows.groupBy("request_id", "section").agg(F.array_sort(F.collect_list(F.struct("place", "memory_id", "raw_text"))).alias("r"))
    section = F.struct(F.col("section").alias("name"), F.array_join(F.transform("r", lambda x: x["raw_text"]), "\n").alias("content"), F.transform("r", lambda x: x["memory_id"]).alias("memory_ids"), F.lit(1).alias("tokens"))
    made = parts.groupBy("request_id").agg(F.array_sort(F.collect_list(section)).alias("sections"))
    return made.join(relating._asks(spark, d).select("request_id", "project_id"), "request_id").withColumn("warnings", F.array(F.lit("one"), F.concat(F.lit("two of "), "project_id")))


@query("f8_compose_prompts")
def _(spark, d):
    return packs.compose_prompts(_packs(spark, d), _requests(spark, d))


_DUTIES = "'## ANSWER REQUIREMENTS' || " + " || ".join(f"chr(10) || '- {w}'" for w in packs.DUTIES)


@query(
    "f8_prompts_of_sections",
    f"""WITH {_SECTIONED}, b AS (SELECT request_id, string_agg('## ' || upper(replace(section, '_', ' ')) || chr(10) || content, chr(10) || chr(10) ORDER BY section) AS body FROM ps GROUP BY 1)
SELECT request_id, body || chr(10) || chr(10) || '## WARNINGS' || chr(10) || '- one' || chr(10) || '- two of ' || project_id || chr(10) || chr(10) || '## FORBIDDEN CONTEXT' || chr(10) || '- Scope:' || project_id || chr(10) || chr(10) || '## USER QUERY' || chr(10) || query || chr(10) || chr(10) || {_DUTIES} AS prompt FROM b JOIN reqs USING (request_id)""",
)
def _(spark, d):
    return packs.compose_prompts(_sectioned(spark, d), relating._asks(spark, d))


@query("f9_rag_packs")
def _(spark, d):
    requests = relating._with_vectors(spark, d, _requests(spark, d))
    return packs.flat_packs(packs.rag_packs(requests, views.mem(spark, d), relating._vectors(spark, d)))


@query("f11_pack_trace")
def _(spark, d):
    memories, requests = views.mem_table(spark, d), _requests(spark, d)
    found = written(retrieve.retrieve(requests, memories))
    built = packs.build_packs(requests, found, memories)
    return packs.pack_trace(found.join(memories.select("memory_id", "validity"), "memory_id"), built)


@query(
    "f11_trace_of_sections",
    f"WITH {_SECTIONED} SELECT f.request_id, f.memory_id, coalesce(section, CASE WHEN validity IN ('superseded', 'rejected') THEN 'dropped: ' || validity ELSE 'dropped: budget' END) AS fate FROM fused f JOIN mem USING (memory_id) LEFT JOIN pr ON pr.request_id = f.request_id AND pr.memory_id = f.memory_id",
)
def _(spark, d):
    found = relating._fused(spark, d).join(views.mem(spark, d).select("memory_id", "validity"), "memory_id")
    return packs.pack_trace(found, _sectioned(spark, d))


@query(
    "m10_content_success_rates",
    f"""WITH {_SECTIONED}, sc AS (SELECT request_id, least(1.0, count(*) FILTER (WHERE memory_type = 'error') / 3) >= 0.67 AS ok FROM pr GROUP BY 1)
SELECT 'section' AS kind, section AS value, count(*) AS n, round(avg(ok::INT), 6) AS rate FROM ps JOIN sc USING (request_id) GROUP BY 2 UNION ALL SELECT 'memory_type', memory_type, count(*), round(avg(ok::INT), 6) FROM pr JOIN sc USING (request_id) GROUP BY 2""",
)
def _(spark, d):
    made, memories = _sectioned(spark, d), views.mem(spark, d)
    held = made.select("request_id", F.explode(F.flatten(F.transform("sections", lambda s: s["memory_ids"]))).alias("memory_id")).join(memories.select("memory_id", "memory_type"), "memory_id")
    scores = held.groupBy("request_id").agg(F.least(F.lit(1.0), F.count_if(F.col("memory_type") == "error") / 3).alias("restore"))
    return _rounded(evals.content_success_rates(scores, made, memories), "rate")


@query("m11_budget_curve")
def _(spark, d):
    requests = relating._asks(spark, d).withColumn("expected", F.array(F.lit("Engine3"), F.lit("module store"), F.lit("parser")))
    out = sessions.budget_curve(written(requests), views.mem_table(spark, d), [40, 70, 150, 500])
    return out.select("budget", *[F.round(n, 6).alias(n) for n in ("recall", "passed", "score", "tokens", "sections")], "n")


# Summary and full packs of each project, in SQL.
_SUMMARY = f"""o AS (SELECT *, row_number() OVER (PARTITION BY project_id, memory_type {_RANK}) AS n, row_number() OVER (PARTITION BY project_id {_RANK}) AS ord FROM mem),
sp AS (SELECT project_id, string_agg(array_to_string(regexp_extract_all(compressed_summary, '\\S+')[1:CASE memory_type WHEN 'decision' THEN 10 ELSE 8 END], ' '), chr(10) ORDER BY memory_type, n) AS content FROM o WHERE (memory_type = 'decision' AND n <= 20) OR (memory_type = 'error' AND n <= 10) GROUP BY project_id),
fp0 AS (SELECT project_id, string_agg('[' || memory_type || '] ' || compressed_summary, chr(10) || chr(10) ORDER BY ord) AS c FROM o GROUP BY project_id),
fp AS (SELECT project_id, CASE WHEN length(c) > 1500 THEN left(c, 1500) || chr(10) || '...[truncated]' ELSE c END AS content FROM fp0)"""


@query("f9_summary_packs", f"WITH {MEM_SQL}, {_SUMMARY} SELECT project_id, content, (length(content) // 4)::INT AS tokens FROM sp")
def _(spark, d):
    return packs.summary_packs(views.mem(spark, d)).select("project_id", "content", "tokens")


@query("f9_full_packs", f"WITH {MEM_SQL}, {_SUMMARY} SELECT project_id, content, (length(content) // 4)::INT AS tokens FROM fp")
def _(spark, d):
    return packs.full_packs(views.mem(spark, d), 500).select("project_id", "content", "tokens")


_RUN = "SELECT *, sum(greatest(1, length({text}) // 4)) OVER (PARTITION BY request_id ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS used FROM x"


@query(
    "f9_raw_verbatim_packs",
    f"""WITH {relating._LISTS}, x AS (SELECT * FROM fused JOIN mem USING (memory_id) WHERE place <= 20 QUALIFY row_number() OVER (PARTITION BY request_id, left(raw_text, 200) ORDER BY place) = 1), y AS ({_RUN.format(text='raw_text', order='timestamp, memory_id')})
SELECT request_id, string_agg('[' || memory_type || '] ' || raw_text, chr(10) ORDER BY used, memory_id) AS content, max(used)::INT AS tokens FROM y WHERE used <= 120 GROUP BY request_id""",
)
def _(spark, d):
    return packs.raw_verbatim_packs(relating._fused(spark, d), views.mem(spark, d), 120).select("request_id", "content", "tokens")


@query(
    "f9_strong_rag_packs",
    f"""WITH {relating._LISTS}, x AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY place) AS n FROM fused JOIN mem USING (memory_id) WHERE validity NOT IN ('superseded', 'rejected') QUALIFY n <= 15), y AS ({_RUN.format(text='compressed_summary', order='n')})
SELECT request_id, string_agg('[' || memory_type || '] ' || compressed_summary, chr(10) ORDER BY used, memory_id) AS content, max(used)::INT AS tokens FROM y WHERE used <= 120 GROUP BY request_id""",
)
def _(spark, d):
    return packs.strong_rag_packs(relating._fused(spark, d), views.mem(spark, d), 120).select("request_id", "content", "tokens")


_ASKED = ", ".join(f"CASE WHEN contains(query, '{w}') THEN {list(t)} ELSE [] END" for w, t in packs.ASKS.items())
_QUIET = ", ".join(f"'{w}'" for w in packs.QUIET)


@query(
    "f5_pack_sufficiency",
    f"""WITH {relating._REQS}, {_SUMMARY}, x AS (SELECT request_id, r.project_id, list_filter(regexp_extract_all(query, '\\b[a-z]{{4,}}\\b'), lambda w: w NOT IN ({_QUIET})) AS words, list_distinct(flatten([{_ASKED}])) AS wanted, lower(content) AS text FROM reqs r JOIN sp USING (project_id)),
h AS (SELECT project_id, list(DISTINCT memory_type) AS types, count(DISTINCT source_type) AS sources, count(*) AS n, list(DISTINCT lower(raw_text)) FILTER (WHERE memory_type = 'decision' AND validity = 'active') AS active, list(DISTINCT lower(raw_text)) FILTER (WHERE memory_type = 'decision' AND validity = 'rejected') AS rejected FROM mem GROUP BY 1),
c AS (SELECT request_id, len(list_filter(words, lambda w: NOT contains(text, w))) AS gap, len(list_filter(wanted, lambda w: NOT list_contains(types, w))) AS missing, sources < 2 AND n > 3 AS one,
 len(coalesce(active, [])) > 0 AND len(coalesce(rejected, [])) > 0 AS clash, contains(text, 'passed') AND contains(text, 'failed') AND len(regexp_extract_all(text, 'test')) IN (1, 2) AS mixed, length(text) < 100 AS short FROM x JOIN h USING (project_id)),
s AS (SELECT *, 1.0 - CASE WHEN gap > 0 THEN least(0.3, gap * 0.05) ELSE 0 END - missing * 0.15 - CASE WHEN one THEN 0.1 ELSE 0 END - CASE WHEN clash OR mixed THEN 0.2 ELSE 0 END - CASE WHEN short THEN 0.3 ELSE 0 END - 0.05 AS raw FROM c)
SELECT request_id, greatest(0, round(raw, 2))::DOUBLE AS score, round(raw, 6) >= 0.7 AND missing = 0 AND NOT (clash OR mixed) AS sufficient FROM s""",
)
def _(spark, d):
    memories, requests = views.mem(spark, d), relating._asks(spark, d)
    text = requests.join(packs.summary_packs(memories), "project_id").select("request_id", F.lower("content").alias("text"))
    statement = F.when(F.col("memory_type") == "decision", F.col("raw_text"))
    held = memories.join(requests.select("project_id", "request_id"), "project_id").withColumn("statement", statement)
    return packs.pack_sufficiency(requests, text, held).select("request_id", "score", "sufficient")


@query(
    "f6_query_coverage",
    f"WITH {relating._REQS}, {_SUMMARY}, x AS (SELECT request_id, list_distinct(string_split(query, ' ')) AS w, lower(content) AS text FROM reqs JOIN sp USING (project_id)), s AS (SELECT request_id, least(1.0, len(list_filter(w, lambda q: contains(text, q))) / len(w) * 1.5) AS raw FROM x) SELECT request_id, round(raw, 6)::DOUBLE AS score, raw > 0.5 AS sufficient FROM s",
)
def _(spark, d):
    requests = relating._asks(spark, d)
    text = requests.join(packs.summary_packs(views.mem(spark, d)), "project_id").select("request_id", F.lower("content").alias("text"))
    return packs.query_coverage(requests, text).withColumn("score", F.round("score", 6))


# One scenario for each project, told from its number.
_LABELS = {
    "expected_goals": ["'fix src/mod' || a", "'add endpoint'"], "expected_decisions": ["'use engine' || a", "'module store'"], "expected_errors": ["'parser' || a", "'connection refused'", "'test failed'"], "stale_facts": ["'engine' || b", "'step'"],
    "keywords": ["'engine'", "'parser'", "'release'"], "exact_symbols": ["'engine' || a", "'parser' || b"], "rejected": ["'engine3'"], "expected_files": ["'api.py'"],
    "expected_tasks": ["'step'", "'refactor parser' || a"], "constraints": ["'must'"], "dependencies": ["'parser' || b", "'field' || a"], "root_causes": ["'pool too small'"], "fixes": ["'raise limit'", "'build failed'"], "functions": ["'assertion'"],
}
_SCENARIOS = f"""{MEM_SQL}, {_SUMMARY}, ids AS (SELECT DISTINCT project_id AS name, substr(project_id, 6)::INT % 7 AS a, (substr(project_id, 6)::INT + 1) % 7 AS b FROM mem),
sc AS (SELECT name, {', '.join(f'[{", ".join(v)}] AS {k}' for k, v in _LABELS.items())} FROM ids),
pk AS (SELECT project_id AS name, 'summary' AS method, lower(content) AS text, left(lower(content), 60) AS state_text, length(content) // 4 AS tokens FROM sp UNION ALL SELECT project_id, 'full', lower(content), left(lower(content), 60), length(content) // 4 FROM fp), j AS (SELECT * FROM pk JOIN sc USING (name))"""


def _scenarios(spark, d):
    number = F.substring("project_id", 6, 10).cast("int")
    ids = views.mem(spark, d).select("project_id").distinct().select(F.col("project_id").alias("name"), (number % 7).alias("a"), ((number + 1) % 7).alias("b"))
    return ids.select("name", *[F.expr(f"array({', '.join(v)})").alias(k) for k, v in _LABELS.items()])


def _made(spark, d):
    rows = views.mem(spark, d)
    both = packs.summary_packs(rows).withColumn("method", F.lit("summary")).unionByName(packs.full_packs(rows, 500).withColumn("method", F.lit("full")))
    return both.select(F.col("project_id").alias("name"), "method", F.lower("content").alias("text"), F.substring(F.lower("content"), 1, 60).alias("state_text"), "tokens")


def _hit(terms: str, text: str = "text") -> str:
    return f"len(list_filter({terms}, lambda x: contains({text}, lower(x))))"


def _share(terms: str) -> str:
    return f"{_hit(terms)} / len({terms})"


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(
    "m1_restore_metrics",
    f"""WITH {_SCENARIOS}, r AS (SELECT name, method, {_share('expected_goals')} AS g, CASE WHEN {_hit('exact_symbols')} > 0 THEN 1 ELSE {_share('expected_goals')} END AS gx, {_share('expected_decisions')} AS dr, {_share('expected_errors')} AS er,
 ({_hit('expected_goals', 'state_text')} + {_hit('expected_decisions', 'state_text')} + {_hit('expected_errors', 'state_text')}) / 7 AS ps FROM j)
SELECT name, method, round(g, 6) AS goal_verbatim, round(gx, 6)::DOUBLE AS goal_exact, round(dr, 6) AS decision, round(er, 6) AS error, round(ps, 6) AS project_state, round((g + dr + er) / 3, 6) AS overall_verbatim, round((gx + dr + er) / 3, 6) AS overall_exact FROM r""",
)
def _(spark, d):
    names = ("goal_verbatim", "goal_exact", "decision", "error", "project_state", "overall_verbatim", "overall_exact")
    return _rounded(evals.restore_metrics(_made(spark, d), _scenarios(spark, d)), *names).select("name", "method", *names)


_COMPONENTS = f"""{_SCENARIOS}, w AS (SELECT *, CASE WHEN {' OR '.join(f"contains(text, '{x}')" for x in evals.WHY)} THEN 1.0 ELSE 0.0 END AS rationale FROM j),
cm AS (SELECT name, method, {_share('exact_symbols')} AS exact_symbol, {_share('expected_decisions')} AS decision, greatest(0, {_share('expected_decisions')} - {_share('rejected')}) AS decision_correctness, 0.3 * {_share('expected_goals')} + 0.3 * {_share('expected_tasks')} + 0.2 * {_share('constraints')} + 0.2 * {_share('dependencies')} AS project_state, {_share('expected_tasks')} AS open_task,
 0.4 * {_share('expected_errors')} + 0.35 * {_share('root_causes')} + 0.25 * {_share('fixes')} AS error_bug, 0.5 * {_share('expected_files')} + 0.5 * {_share('functions')} AS file_function, 1 - {_share('stale_facts')} AS stale_suppression, rationale, ({_share('expected_goals')} + {_share('expected_decisions')} + {_share('expected_errors')}) / 3 * (1 - tokens / 306.0) AS token_efficiency FROM w)"""


@query("m2_component_metrics", f"WITH {_COMPONENTS} SELECT name, method, round(decision_correctness, 6) AS decision_correctness, round(project_state, 6) AS project_state, round(error_bug, 6) AS error_bug, round(file_function, 6) AS file_function, round(stale_suppression, 6) AS stale_suppression, round(token_efficiency, 6) AS token_efficiency FROM cm")
def _(spark, d):
    names = ("decision_correctness", "project_state", "error_bug", "file_function", "stale_suppression", "token_efficiency")
    return _rounded(evals.component_metrics(_made(spark, d), _scenarios(spark, d)), *names).select("name", "method", *names)


@query(
    "m3_quality",
    f"WITH {_COMPONENTS} SELECT name, method, round(0.15 * exact_symbol + 0.15 * decision + 0.15 * project_state + 0.1 * open_task + 0.1 * error_bug + 0.1 * file_function + 0.1 * stale_suppression + 0.05 + 0.05 * token_efficiency, 6) AS quality_7, round(0.15 * exact_symbol + 0.15 * decision + 0.15 * project_state + 0.1 * open_task + 0.1 * error_bug + 0.1 * file_function + 0.1 * stale_suppression + 0.05 * rationale + 0.1 * token_efficiency, 6) AS quality_9 FROM cm",
)
def _(spark, d):
    return _rounded(evals.quality(evals.component_metrics(_made(spark, d), _scenarios(spark, d))), "quality_7", "quality_9")


_EXCUSED = " OR ".join(f"contains(substr(text, greatest(instr(text, x) - 60, 1)::BIGINT, (least(instr(text, x) - 1, 60) + length(x) + 60)::BIGINT), '{w}')" for w in evals.EXCUSES)
_STALE = f"len(list_filter(stale_facts, lambda x: regexp_matches(text, '\\b' || x || '\\b') AND NOT ({_EXCUSED}))) / len(stale_facts)"
_SCORED = f"""{_SCENARIOS}, ps AS (SELECT name, method, tokens, ({_share('expected_goals')} + {_share('expected_decisions')} + {_share('expected_errors')}) / 3 AS restore, {_share('keywords')} AS keyword_coverage, {_STALE} AS stale_penalty, {_share('exact_symbols')} AS critical_survival FROM j),
pq AS (SELECT *, restore + keyword_coverage - stale_penalty AS quality FROM ps)"""


def _scored(spark, d):
    return evals.score_packs(_made(spark, d), _scenarios(spark, d))


@query("m4_score_packs", f"WITH {_SCORED} SELECT name, method, round(restore, 6) AS restore, round(keyword_coverage, 6) AS keyword_coverage, round(stale_penalty, 6) AS stale_penalty, round(critical_survival, 6) AS critical_survival, round(quality, 6) AS quality FROM pq")
def _(spark, d):
    names = ("restore", "keyword_coverage", "stale_penalty", "critical_survival", "quality")
    return _rounded(_scored(spark, d), *names).select("name", "method", *names)


@query(
    "m5_ranking_metrics",
    f"""WITH {relating._LISTS}, gold AS (SELECT request_id, memory_id FROM mem JOIN reqs USING (project_id) WHERE memory_type = 'error' AND m = 2), h AS (SELECT gold.*, place FROM gold LEFT JOIN fused USING (request_id, memory_id))
SELECT request_id, round(count(*) FILTER (WHERE place <= 5) / count(*), 6) AS recall_5, round(count(*) FILTER (WHERE place <= 20) / count(*), 6) AS recall_20, round(coalesce(1 / min(place), 0), 6) AS reciprocal_rank, count(*) AS n_gold FROM h GROUP BY request_id""",
)
def _(spark, d):
    gold = views.mem(spark, d).where("memory_type = 'error' and m = 2").join(relating._asks(spark, d), "project_id").select("request_id", "memory_id")
    out = evals.ranking_metrics(relating._fused(spark, d).withColumnRenamed("place", "rank"), gold, (5, 20))
    return _rounded(out, "recall_5", "recall_20", "reciprocal_rank")


@query("m5_unique_to", f"WITH {relating._LISTS} SELECT request_id, memory_id FROM imp WHERE rank <= 10 EXCEPT SELECT request_id, memory_id FROM meta WHERE position <= 10")
def _(spark, d):
    rows, requests = views.mem(spark, d), relating._asks(spark, d)
    important = rows.join(requests, "project_id").withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("importance_score"), "memory_id"))).where("rank <= 50")
    meta = retrieve.metadata_candidates(retrieve.make_plan(requests), rows).withColumnRenamed("position", "rank")
    return evals.unique_to(important, meta, 10)


_VECS = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


@query("m6_semantic_match", f"WITH {_VECS}, b AS (SELECT q.label AS name, q.vec_id, max(list_cosine_similarity(q.e, v.e)) AS best FROM v q JOIN v ON q.label = v.label AND q.vec_id % 10 = 0 AND v.vec_id % 10 <> 0 GROUP BY ALL) SELECT name, round(avg((best >= 0.3)::INT), 6) AS recall, round(avg(best), 6) AS mean_best FROM b GROUP BY name")
def _(spark, d):
    rows = views.table(spark, d, "embeddings").select(F.col("label").alias("name"), F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("vector"))
    return _rounded(evals.semantic_match(rows.where("item % 10 = 0"), rows.where("item % 10 <> 0"), 0.3), "recall", "mean_best")


@query(
    "m7_threshold_sweep",
    f"""WITH {MEM_SQL}, x AS (SELECT (memory_type = 'error')::INT AS label, importance_score AS s, unnest([0.2::DOUBLE, 0.4::DOUBLE, 0.6::DOUBLE]) AS threshold FROM mem), c AS (SELECT threshold, count(*) FILTER (WHERE s >= threshold AND label = 1) AS tp, count(*) FILTER (WHERE s >= threshold AND label = 0) AS fp, count(*) FILTER (WHERE s < threshold AND label = 1) AS fn FROM x GROUP BY 1)
SELECT threshold, tp, fp, fn, round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
)
def _(spark, d):
    scores = views.mem(spark, d).select((F.col("memory_type") == "error").cast("int").alias("label"), F.col("importance_score").alias("score"))
    return _rounded(evals.threshold_sweep(scores, [0.2, 0.4, 0.6]), "precision", "recall", "f1")


@query("m8_contamination", f"WITH {MEM_SQL} SELECT 'proj_' || (k % 5) AS request_id, count(*) FILTER (WHERE project_id <> 'proj_' || (k % 5)) AS n_foreign, round(count(*) FILTER (WHERE project_id <> 'proj_' || (k % 5)) / 50, 6) AS rate FROM mem GROUP BY 1")
def _(spark, d):
    rows = views.mem(spark, d)
    owner = F.concat(F.lit("proj_"), (F.col("k") % 5).cast("string"))
    return _rounded(evals.contamination(rows.select(owner.alias("request_id"), owner.alias("project_id"), "memory_id"), rows), "rate")


@query("m8_false_memory_rate", f"WITH {MEM_SQL} SELECT count(*) AS decisions, count(*) FILTER (WHERE contains(lower(raw_text), 'engine6')) AS planted, round(count(*) FILTER (WHERE contains(lower(raw_text), 'engine6')) / count(*), 6) AS rate FROM mem WHERE memory_type = 'decision'")
def _(spark, d):
    return _rounded(evals.false_memory_rate(views.mem(spark, d), ["Engine6"]), "rate")


@query("m9_compare_methods", f"WITH {_SCORED} SELECT method, round(avg(restore), 6) AS mean_restore, round(avg(tokens), 6) AS mean_tokens, round(avg(quality), 6) AS mean_quality, round(median(quality), 6) AS median_quality, round(min(quality), 6) AS min_quality, round(max(quality), 6) AS max_quality FROM pq GROUP BY method")
def _(spark, d):
    names = ("mean_restore", "mean_tokens", "mean_quality", "median_quality", "min_quality", "max_quality")
    return _rounded(evals.compare_methods(_scored(spark, d)), *names).select("method", *names)


@query("m9_ablation_deltas", f"WITH {_SCORED} SELECT 'summary' AS method, round(avg(quality) FILTER (WHERE method = 'summary') - avg(quality) FILTER (WHERE method = 'full'), 6) AS delta FROM pq")
def _(spark, d):
    return _rounded(evals.ablation_deltas(evals.compare_methods(_scored(spark, d)), "full"), "delta")


@query("m10_pack_success_rates", f"WITH {_SCORED}, t AS (SELECT *, (ascii(right(name, 1)) % 3)::VARCHAR AS task FROM pq) SELECT task, method, count(*) AS n, round(avg((restore >= 0.67)::INT), 6) AS rate FROM t GROUP BY GROUPING SETS ((task), (method), ())")
def _(spark, d):
    rows = _scored(spark, d).withColumn("task", (F.ascii(F.right("name", F.lit(1))) % 3).cast("string"))
    return _rounded(evals.pack_success_rates(rows), "rate")


@query(
    "m14_task_scores",
    f"""WITH {_SCENARIOS}, s AS (SELECT ascii(right(name, 1)) % 3 AS category, greatest(0, {_share('keywords')} - 0.5 * {_share('stale_facts')} - CASE WHEN tokens % 2 = 0 THEN 0 ELSE 0.2 END) AS s FROM j WHERE method = 'full')
SELECT category, round(avg(s), 6) AS mean_score, round(avg((s >= 0.8)::INT), 6) AS share_passed, count(*) AS n FROM s GROUP BY 1""",
)
def _(spark, d):
    made = _made(spark, d).where("method = 'full'").select("name", "text", (F.col("tokens") % 2 == 0).alias("verified"))
    tasks = _scenarios(spark, d).select("name", (F.ascii(F.right("name", F.lit(1))) % 3).alias("category"), F.col("keywords").alias("expected"), F.col("stale_facts").alias("forbidden"))
    return _rounded(evals.task_scores(made, tasks), "mean_score", "share_passed")


@query(
    "m14_task_scores_second",
    f"""WITH {_SCENARIOS}, s AS (SELECT ascii(right(name, 1)) % 3 AS category, {_share('keywords')} - CASE WHEN tokens % 2 = 0 THEN 0 ELSE 0.1 END AS s FROM j WHERE method = 'full')
SELECT category, round(avg(s), 6) AS mean_score, round(avg((s >= 0.8)::INT), 6) AS share_passed, count(*) AS n FROM s GROUP BY 1""",
)
def _(spark, d):
    made = _made(spark, d).where("method = 'full'").select("name", "text", (F.col("tokens") % 2 == 0).alias("verified"))
    tasks = _scenarios(spark, d).select("name", (F.ascii(F.right("name", F.lit(1))) % 3).alias("category"), F.col("keywords").alias("expected"), F.col("stale_facts").alias("forbidden"))
    return _rounded(evals.task_scores(made, tasks, second=True), "mean_score", "share_passed")


_NUMBER = "substr(name, 6)::INT"


@query(
    "m12_audit_scenarios",
    f"""WITH {_SCENARIOS}, n AS (SELECT name, {_NUMBER} AS i FROM sc), c AS (SELECT 0::BIGINT AS missing, count(*) FILTER (WHERE i % 7 = 0) AS extra, count(*) FILTER (WHERE i % 7 > 0 AND i % 10 = 0) AS unlocked, count(*) FILTER (WHERE i % 7 > 0 AND i % 11 = 0) AS changed, count(*) FILTER (WHERE i % 20 = 3) AS overlap FROM n)
SELECT *, extra + unlocked + changed + overlap = 0 AS ok FROM c""",
)
def _(spark, d):
    run = _scenarios(spark, d)
    i = F.substring("name", 6, 10).cast("int")
    content = F.sha2(F.to_json(F.struct(*[c for c in run.columns if c != "name"])), 256)
    manifest = run.where(i % 7 > 0).select("name", F.when(i % 11 == 0, "another").otherwise(content).alias("hash"), (i % 10 > 0).alias("locked"))
    return evals.audit_scenarios(run, manifest, run.where(i % 20 == 3))
