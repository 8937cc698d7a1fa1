"""Queries over links, graphs, retrieval and ranking, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memjobs.functions import text as T
from memjobs.operators import links, retrieve, vectors
from memjobs.plans.registry import registry
from memjobs.sources import views
from memjobs.sources.views import LINKS_SQL, MEM_SQL

QUERIES, ORACLES, query = registry()
_RANK = "ORDER BY recency_score DESC, importance_score DESC, timestamp DESC, memory_id"

_STOP = ", ".join(f"'{w}'" for w in links.STOP_WORDS)
_WORDS = f"list_filter(list_distinct(regexp_extract_all(lower(concat_ws(' ', raw_text, compressed_summary, semantic_summary)), '\\b[a-z]{{4,}}\\b')), lambda w: w NOT IN ({_STOP}))"
_RELATION = "CASE " + " ".join(f"WHEN (a.memory_type, b.memory_type) IN (('{x}', '{y}'), ('{y}', '{x}')) THEN '{r}'" for (x, y), r in links.RELATIONS.items()) + " END"


def _linked(targets: str) -> str:
    return f"""WITH {MEM_SQL}, w AS (SELECT *, {_WORDS} AS words FROM mem), t AS (SELECT * FROM w {targets}),
p AS (SELECT a.memory_id AS source_id, b.memory_id AS target_id, a.session_id = b.session_id AS same, {_RELATION} AS relation, a.file_ref = b.file_ref AS file, len(list_intersect(a.words, b.words)) AS n, abs(epoch(a.timestamp) - epoch(b.timestamp)) < 300 AS near
 FROM w a JOIN t b ON a.project_id = b.project_id AND (b.timestamp, b.memory_id) < (a.timestamp, a.memory_id))
SELECT source_id, target_id, CASE WHEN same THEN 'same_session' WHEN relation IS NOT NULL THEN relation WHEN file THEN 'shared_file' WHEN n >= 3 THEN 'keyword_overlap' WHEN near THEN 'temporal_proximity' END AS relation_type,
 CASE WHEN same THEN 0.9 WHEN relation IS NOT NULL THEN 0.7 WHEN file THEN 0.8 WHEN n >= 3 THEN round(least(0.8, 0.5 + n * 0.05), 6) ELSE 0.5 END::DOUBLE AS confidence FROM p WHERE relation_type IS NOT NULL"""


@query("d1_auto_link", _linked(f"QUALIFY row_number() OVER (PARTITION BY project_id {_RANK}) <= 100"))
def _(spark, d):
    return links.auto_link(views.mem(spark, d), 100).withColumn("confidence", F.round("confidence", 6))


@query("d1_auto_link_uncapped", _linked(""))
def _(spark, d):
    return links.auto_link(views.mem(spark, d), None).withColumn("confidence", F.round("confidence", 6))


@query("d2_shared_file_links", f"WITH {MEM_SQL} SELECT a.memory_id AS source_id, b.memory_id AS target_id FROM mem a JOIN mem b ON a.project_id = b.project_id AND a.file_ref = b.file_ref AND (b.timestamp, b.memory_id) < (a.timestamp, a.memory_id)")
def _(spark, d):
    return links.shared_file_links(views.mem(spark, d)).select("source_id", "target_id")


@query(
    "d3_supersede_decisions",
    f"""WITH {MEM_SQL}, s AS (SELECT *, lower(raw_text) AS said, list_distinct(string_split(lower(raw_text), ' ')) AS w FROM mem WHERE memory_type = 'decision' AND validity = 'active')
SELECT b.memory_id, arg_min(a.memory_id, (a.timestamp, a.memory_id)) AS superseded_by FROM s a JOIN s b ON a.project_id = b.project_id AND b.timestamp < a.timestamp AND a.said <> b.said AND len(list_intersect(a.w, b.w)) >= 2 GROUP BY b.memory_id""",
)
def _(spark, d):
    return links.supersede_decisions(views.mem(spark, d).where("memory_type = 'decision'").withColumn("statement", F.col("raw_text")))


_J = "coalesce(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)"
_BEST = "greatest(" + ", ".join(f"CASE WHEN len(a.w{i}) > 0 AND len(b.w{j}) > 0 THEN {_J.format(a=f'a.w{i}', b=f'b.w{j}')} ELSE 0 END" for i in range(3) for j in range(3)) + ")"


@query(
    "d4_detect_contradictions",
    f"""WITH {MEM_SQL}, s AS (SELECT *, list_distinct(regexp_extract_all(lower(raw_text), '\\S+')) AS w0, list_distinct(regexp_extract_all(lower(compressed_summary), '\\S+')) AS w1, list_distinct(regexp_extract_all(lower(coalesce(semantic_summary, '')), '\\S+')) AS w2
 FROM mem WHERE memory_type IN ('decision', 'fact') AND validity = 'active'),
p AS (SELECT a.memory_id AS a_id, b.memory_id AS b_id, {_BEST} AS sim FROM s a JOIN s b ON a.project_id = b.project_id AND a.memory_type = b.memory_type AND a.memory_id < b.memory_id)
SELECT a_id, b_id, round(least(1.0, sim + 0.2), 6) AS confidence FROM p WHERE sim > 0.3 AND least(1.0, sim + 0.2) > 0.5""",
)
def _(spark, d):
    return links.detect_contradictions(views.mem(spark, d)).select("a_id", "b_id", F.round("confidence", 6).alias("confidence"))


_EDGES = f"{LINKS_SQL}, e AS (SELECT source_id AS x, target_id AS y FROM links UNION SELECT target_id, source_id FROM links)"


# Memories with links of their own, next to the link table.
_STORED = "st AS (SELECT memory_id AS x, 'mem_' || (substr(memory_id, 5)::INT + 7) AS y FROM mem WHERE k % 6 = 0 UNION SELECT memory_id, 'mem_' || (substr(memory_id, 5)::INT + 11) FROM mem WHERE k % 9 = 0)"


def _linked_memories(spark, d):
    other = lambda step: F.array(F.concat(F.lit("mem_"), (F.substring("memory_id", 5, 20).cast("int") + step).cast("string")))
    none = F.array().cast("array<string>")
    return views.mem(spark, d).withColumn("dependency_links", F.when(F.col("k") % 6 == 0, other(7)).otherwise(none)).withColumn("contradiction_links", F.when(F.col("k") % 9 == 0, other(11)).otherwise(none))


@query(
    "d5_expand_graph",
    f"""WITH {_EDGES}, {_STORED}, h0 AS (SELECT project_id AS g, memory_id AS x FROM mem WHERE k % 20 = 0), h1 AS (SELECT g, y AS x FROM h0 JOIN e USING (x) UNION FROM h0), h2 AS (SELECT g, y AS x FROM h1 JOIN e USING (x) UNION FROM h1)
SELECT g AS group_id, x AS memory_id FROM h2 UNION SELECT g, y FROM h2 JOIN st USING (x) WHERE y IN (SELECT memory_id FROM mem)""",
)
def _(spark, d):
    seeds = views.mem(spark, d).where("k % 20 = 0").select(F.col("project_id").alias("group_id"), "memory_id")
    return links.expand_graph(seeds, views.links(spark, d), 3, memories=_linked_memories(spark, d))


@query("d6_neighbors", f"WITH {_EDGES}, {_STORED} SELECT x AS memory_id, y AS neighbor_id FROM e UNION SELECT x, y FROM st WHERE y IN (SELECT memory_id FROM mem)")
def _(spark, d):
    return links.neighbors(_linked_memories(spark, d), views.links(spark, d))


@query(
    "d8_link_quality",
    f"""WITH {LINKS_SQL}, w AS (SELECT *, {_WORDS} AS words FROM mem)
SELECT relation_type, count(*) AS n, count(*) FILTER (WHERE (a.session_id = b.session_id)::INT + coalesce(a.file_ref = b.file_ref, false)::INT + (len(list_intersect(a.words, b.words)) >= 2)::INT + 1 >= 2) AS n_good
FROM links JOIN w a ON source_id = a.memory_id JOIN w b ON target_id = b.memory_id GROUP BY 1""",
)
def _(spark, d):
    return links.link_quality(views.mem(spark, d), views.links(spark, d))


@query(
    "d8_link_recall",
    f"""WITH {LINKS_SQL}, p AS (SELECT a.memory_id AS x, b.memory_id AS y FROM mem a JOIN mem b ON a.project_id = b.project_id AND a.session_id = b.session_id AND a.memory_id < b.memory_id),
l AS (SELECT DISTINCT least(source_id, target_id) AS x, greatest(source_id, target_id) AS y, 1 AS linked FROM links) SELECT count(*) AS expected, count(linked) AS found FROM p LEFT JOIN l USING (x, y)""",
)
def _(spark, d):
    return links.link_recall(views.mem(spark, d), views.links(spark, d))


# Documents as memories, benchmark items as requests.
_TOKENS = """d AS (SELECT doc_id AS memory_id, source AS project_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{2,}') AS tokens FROM documents),
r AS (SELECT item_id AS request_id, 'src' || (item_id % 20) AS project_id, text AS query FROM benchmark),
p AS (SELECT memory_id, project_id, len(tokens) AS length, unnest(tokens) AS term FROM d), ix AS (SELECT memory_id, project_id, length, term, count(*) AS tf FROM p GROUP BY ALL),
s AS (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM d) - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM ix GROUP BY term),
st AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM s) ELSE raw END AS idf FROM s)"""
_SCORES = f"""{_TOKENS}, a AS (SELECT (SELECT sum(len(tokens)) FROM d) / (SELECT count(*) FROM d) AS avgdl), rt AS (SELECT request_id, project_id, unnest(regexp_extract_all(lower(query), '[a-z0-9_]{{2,}}')) AS term FROM r),
q AS (SELECT request_id, project_id, term, count(*) AS qtf FROM rt GROUP BY ALL),
sc AS (SELECT q.request_id, ix.memory_id, ix.project_id AS mp, q.project_id AS qp, qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl)) AS x FROM ix JOIN st USING (term) JOIN q USING (term), a)"""


def _docs(spark, d):
    return views.table(spark, d, "documents").select(F.col("doc_id").alias("memory_id"), F.col("source").alias("project_id"), F.col("text").alias("raw_text"))


def _requests(spark, d):
    return views.table(spark, d, "benchmark").select(F.col("item_id").alias("request_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("project_id"), F.col("text").alias("query"))


@query("e1_tokenize", "SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{2,}'))::INT AS n, regexp_extract(lower(coalesce(text, '')), '[a-z0-9_]{2,}') AS first FROM documents")
def _(spark, d):
    tokens = T.tokenize(F.col("text"))
    return views.table(spark, d, "documents").select("doc_id", F.size(tokens).alias("n"), F.coalesce(F.get(tokens, F.lit(0)), F.lit("")).alias("first"))


@query("e2_bm25_index", f"WITH {_TOKENS} SELECT term, df, round(idf, 6) AS idf FROM st")
def _(spark, d):
    docs = _docs(spark, d)
    return retrieve.term_stats(retrieve.postings(docs), docs.count()).withColumn("idf", F.round("idf", 6))


_GLOBAL = f"WITH {_SCORES}, t AS (SELECT request_id, memory_id, round(sum(x), 6) AS score FROM sc GROUP BY ALL HAVING score > 0) SELECT request_id, memory_id, score FROM t QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, memory_id) <= 10"


@query("e3_bm25_search", _GLOBAL)
def _(spark, d):
    return retrieve.bm25_search(_docs(spark, d), _requests(spark, d), 10, "global").select("request_id", "memory_id", "score")


@query("e3_bm25_pruned", _GLOBAL)
def _(spark, d):
    return retrieve.bm25_pruned(retrieve.bm25_index(_docs(spark, d)), _requests(spark, d), 10).found.select("request_id", "memory_id", "score")


@query("e3_postings_read")
def _(spark, d):
    return retrieve.bm25_pruned(retrieve.bm25_index(_docs(spark, d)), _requests(spark, d), 10).read


@query("e3_bm25_search_project", f"WITH {_SCORES}, t AS (SELECT request_id, memory_id, round(sum(x), 6) AS score FROM sc WHERE mp = qp GROUP BY ALL HAVING score > 0) SELECT request_id, memory_id, score FROM t QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, memory_id) <= 50")
def _(spark, d):
    return retrieve.bm25_search(_docs(spark, d), _requests(spark, d), 50).select("request_id", "memory_id", "score")


_EXACT = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS request_id, v.vec_id AS memory_id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v q JOIN v ON q.vec_id % 20 = 0)
SELECT request_id, memory_id, score FROM s QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, memory_id) <= 10"""


def _embeddings(spark, d):
    rows = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("memory_id"), F.col("embedding").alias("vector"))
    return rows, rows.where("memory_id % 20 = 0").withColumnRenamed("memory_id", "request_id")


@query("e4_vector_search", _EXACT)
def _(spark, d):
    return vectors.vector_search(*_embeddings(spark, d), 10).select("request_id", "memory_id", F.round("score", 6).alias("score"))


@query("e4_ivf_search")
def _(spark, d):
    rows, asked = _embeddings(spark, d)
    return vectors.ivf_search(vectors.ivf_index(rows), asked, 10).select("request_id", "memory_id", F.round("score", 6).alias("score"))


@query("e4_ivf_every_cell", _EXACT)
def _(spark, d):
    rows, asked = _embeddings(spark, d)
    index = vectors.ivf_index(rows)
    return vectors.ivf_search(index, asked, 10, probes=len(index.centroids)).select("request_id", "memory_id", F.round("score", 6).alias("score"))


_TASK = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(q, '{w}')" for w in words) + f" THEN '{t}'" for t, words in retrieve.TASK_WORDS.items()) + " ELSE 'general' END"
# One request for each project, on four subjects.
_ASKS = ("fix error in parser", "design of the module store", "add endpoint items", "compare engine releases")
_REQS = f"{MEM_SQL}, reqs AS (SELECT DISTINCT project_id, 'req_' || project_id AS request_id, [{', '.join(repr(a) for a in _ASKS)}][substr(project_id, 6)::INT % 4 + 1] AS query FROM mem)"


def _asks(spark, d):
    subject = F.element_at(F.array(*map(F.lit, _ASKS)), (F.substring("project_id", 6, 10).cast("int") % 4 + 1))
    requests = views.mem(spark, d).select("project_id").distinct().select("project_id", F.concat(F.lit("req_"), "project_id").alias("request_id"), subject.alias("query"))
    return requests.withColumn("requirements", F.expr("CAST(map() AS map<string, boolean>)"))


@query("e5_classify_task", f"WITH c AS (SELECT conv_id, turn, lower(text) AS q FROM conversations) SELECT conv_id, turn, {_TASK} AS task FROM c")
def _(spark, d):
    return views.table(spark, d, "conversations").select("conv_id", "turn", retrieve.classify_task(F.col("text")).alias("task"))


@query(
    "e6_make_plan",
    f"""WITH {_REQS}, t AS (SELECT *, query AS q, {_TASK} AS task FROM (SELECT request_id, query, query AS q FROM reqs))
SELECT request_id, task, true AS needs_errors, true AS needs_decisions, task NOT IN ('architecture', 'research') AS needs_code, false AS needs_graph FROM t""".replace("SELECT *, query AS q,", "SELECT *,"),
)
def _(spark, d):
    return retrieve.make_plan(_asks(spark, d)).select("request_id", "task", "needs_errors", "needs_decisions", "needs_code", "needs_graph")


# Requests with sessions, vectors and requirements of their own.
_OWN = f"""{_REQS}, nums AS (SELECT *, query AS q, substr(project_id, 6)::INT AS i FROM reqs), own AS (SELECT *, {_TASK} AS task, i % 5 <> 0 AS asks_errors, i % 4 <> 1 AS asks_decisions, i % 3 = 0 AS needs_graph, 1 + i % 3 AS hops, 'sess_' || i || '_' || (i % 4) AS session_id FROM nums),
plan AS (SELECT *, asks_errors OR task = 'debugging' AS needs_errors, asks_decisions OR task IN ('debugging', 'architecture', 'feature') AS needs_decisions, task NOT IN ('architecture', 'research') AS needs_code FROM own)"""


def _own_asks(spark, d):
    i = F.substring("project_id", 6, 10).cast("int")
    told = F.create_map(F.lit("include_errors"), i % 5 != 0, F.lit("include_decisions"), i % 4 != 1, F.lit("include_graph"), i % 3 == 0)
    session = F.concat_ws("_", F.lit("sess"), i.cast("string"), (i % 4).cast("string"))
    return _asks(spark, d).withColumns({"requirements": told, "max_graph_hops": 1 + i % 3, "session_id": session})


@query("e6_make_plan_overrides", f"WITH {_OWN} SELECT request_id, task, needs_errors, needs_decisions, needs_code, needs_graph, hops FROM plan")
def _(spark, d):
    return retrieve.make_plan(_own_asks(spark, d)).select("request_id", "task", "needs_errors", "needs_decisions", "needs_code", "needs_graph", "hops")


_STATES = """ses AS (SELECT session_id, memory_id, memory_type, row_number() OVER (PARTITION BY session_id, memory_type ORDER BY timestamp DESC, memory_id DESC) AS back FROM mem WHERE memory_type IN ('decision', 'error') QUALIFY back <= 5),
sn AS (SELECT session_id, memory_id, CASE memory_type WHEN 'decision' THEN -2 ELSE -1 END AS l, max(back) OVER (PARTITION BY session_id, memory_type) - back + 1 AS n FROM ses)"""


def _states(spark, d):
    def ids(kind: str):
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("memory_type") == kind, F.struct("timestamp", "memory_id")))), lambda x: x["memory_id"])

    return views.mem(spark, d).groupBy("session_id").agg(ids("decision").alias("recent_decisions"), ids("error").alias("recent_errors"))


_SESSION_META = f"""{_OWN}, {_STATES}, sm AS (SELECT session_id, memory_id, 0 AS l, row_number() OVER (PARTITION BY session_id {_RANK}) AS n FROM mem QUALIFY n <= 20),
best AS (SELECT project_id, memory_id, CASE memory_type WHEN 'decision' THEN 1 WHEN 'error' THEN 2 WHEN 'intent' THEN 3 WHEN 'code_change' THEN 5 END AS l, row_number() OVER (PARTITION BY project_id, memory_type {_RANK}) AS n FROM mem WHERE memory_type IN ('decision', 'error', 'intent', 'code_change')),
listed AS (SELECT request_id, memory_id, l, n FROM plan JOIN sn USING (session_id) UNION ALL SELECT request_id, memory_id, l, n FROM plan JOIN sm USING (session_id) UNION ALL
 SELECT request_id, memory_id, l, n FROM best JOIN plan USING (project_id) WHERE n <= CASE l WHEN 1 THEN 30 WHEN 2 THEN 30 WHEN 3 THEN 20 ELSE 15 END AND (l <> 1 OR needs_decisions) AND (l <> 2 OR needs_errors) AND (l <> 5 OR needs_code)),
smeta AS (SELECT request_id, memory_id, row_number() OVER (PARTITION BY request_id ORDER BY l, n) AS position FROM listed)"""


@query("e7_session_candidates", f"WITH {_SESSION_META} SELECT request_id, memory_id, position FROM smeta")
def _(spark, d):
    out = retrieve.metadata_candidates(retrieve.make_plan(_own_asks(spark, d)), views.mem(spark, d), _states(spark, d))
    return out.select("request_id", "memory_id", F.col("position").cast("long").alias("position"))


_META = f"""{_REQS}, tk AS (SELECT *, {_TASK} AS task FROM (SELECT *, query AS q FROM reqs)),
best AS (SELECT project_id, memory_id, CASE memory_type WHEN 'decision' THEN 1 WHEN 'error' THEN 2 WHEN 'intent' THEN 3 WHEN 'code_change' THEN 5 END AS l, row_number() OVER (PARTITION BY project_id, memory_type {_RANK}) AS n FROM mem WHERE memory_type IN ('decision', 'error', 'intent', 'code_change')),
meta AS (SELECT request_id, memory_id, row_number() OVER (PARTITION BY request_id ORDER BY l, n) AS position FROM best JOIN tk USING (project_id)
 WHERE n <= CASE l WHEN 1 THEN 30 WHEN 2 THEN 30 WHEN 3 THEN 20 ELSE 15 END AND (l <> 5 OR task NOT IN ('architecture', 'research')))"""


@query("e7_metadata_candidates", f"WITH {_META} SELECT request_id, memory_id, position FROM meta")
def _(spark, d):
    out = retrieve.metadata_candidates(retrieve.make_plan(_asks(spark, d)), views.mem(spark, d))
    return out.select("request_id", "memory_id", F.col("position").cast("long").alias("position"))


_LISTS = f"""{_META}, imp AS (SELECT request_id, memory_id, row_number() OVER (PARTITION BY request_id ORDER BY importance_score DESC, memory_id) AS rank FROM mem JOIN reqs USING (project_id) QUALIFY rank <= 50),
both_ AS (SELECT request_id, memory_id, 1 AS list, position AS rank FROM meta UNION ALL SELECT request_id, memory_id, 0, rank FROM imp),
rr AS (SELECT request_id, memory_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min((list, rank)) AS f FROM both_ GROUP BY ALL),
fused AS (SELECT request_id, memory_id, score, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 12) DESC, f, memory_id) AS place FROM rr QUALIFY place <= 100)"""


def _fused(spark, d):
    memories, requests = views.mem(spark, d), _asks(spark, d)
    important = Window.partitionBy("request_id").orderBy(F.desc("importance_score"), "memory_id")
    first = memories.join(requests, "project_id").withColumn("rank", F.row_number().over(important)).where("rank <= 50").select("request_id", "memory_id", F.lit(0).alias("list"), "rank")
    meta = retrieve.metadata_candidates(retrieve.make_plan(requests), memories)
    return retrieve.rrf(first.union(meta.select("request_id", "memory_id", F.lit(1), F.col("position"))))


@query("e8_rrf", f"WITH {_LISTS} SELECT request_id, memory_id, round(score, 9) AS score, place FROM fused")
def _(spark, d):
    return _fused(spark, d).select("request_id", "memory_id", F.round("score", 9).alias("score"), F.col("place").cast("long").alias("place"))


_BOOST = "CASE " + " ".join(f"WHEN task = '{t}' AND memory_type = '{k}' THEN {x}" for (t, k), x in retrieve.BOOSTS.items()) + " ELSE 0 END"


@query(
    "e9_rerank_recency_importance",
    f"""WITH {_LISTS} SELECT f.request_id, f.memory_id, round(greatest(0, 0.35 * score + 0.15 * recency_score + 0.2 * importance_score + 0.1 * confidence_score + {_BOOST} + CASE stability WHEN 'canonical' THEN 0.1 WHEN 'stable' THEN 0.05 ELSE 0 END
 - CASE validity WHEN 'superseded' THEN 0.5 WHEN 'rejected' THEN 0.8 ELSE 0 END), 6)::DOUBLE AS score FROM fused f JOIN mem USING (memory_id) JOIN tk USING (request_id)""",
)
def _(spark, d):
    tasks = retrieve.make_plan(_asks(spark, d)).select("request_id", "task")
    found = _fused(spark, d).withColumnRenamed("score", "base").join(views.mem(spark, d), "memory_id").join(tasks, "request_id")
    return retrieve.rerank_recency_importance(found).select("request_id", "memory_id", F.round("score", 6).alias("score"))


@query(
    "e10_rerank_score",
    f"""WITH {_LISTS}, c AS (SELECT *, list_distinct(string_split(query, ' ')) AS qw, list_distinct(regexp_extract_all(lower(coalesce(semantic_summary, compressed_summary)), '\\S+')) AS tw FROM fused JOIN mem USING (memory_id) JOIN tk USING (request_id))
SELECT request_id, memory_id, round(greatest(0, 0.25 * len(list_intersect(qw, tw)) / len(qw) + 0.15 * importance_score + 0.1 * recency_score + 0.15 * CASE stability WHEN 'canonical' THEN 1 WHEN 'stable' THEN 0.7 ELSE 0.3 END + 0.1 * confidence_score
 + 0.1 * CASE WHEN task = 'debugging' AND memory_type IN ('error', 'decision') THEN 1 ELSE 0.5 END + 0.05 - CASE WHEN validity = 'superseded' THEN 0.1 ELSE 0 END), 6)::DOUBLE AS score FROM c""",
)
def _(spark, d):
    tasks = retrieve.make_plan(_asks(spark, d)).select("request_id", "task", "query")
    found = _fused(spark, d).drop("score").join(views.mem(spark, d), "memory_id").join(tasks, "request_id")
    return retrieve.rerank_score(found).select("request_id", "memory_id", F.round("score", 6).alias("score"))


_INDEX = """mt AS (SELECT memory_id, project_id, regexp_extract_all(lower(coalesce(nullif(semantic_summary, ''), nullif(compressed_summary, ''), raw_text)), '[a-z0-9_]{2,}') AS tokens FROM mem),
mp AS (SELECT memory_id, project_id, len(tokens) AS length, unnest(tokens) AS term FROM mt), mi AS (SELECT memory_id, project_id, length, term, count(*) AS tf FROM mp GROUP BY ALL),
ms AS (SELECT term, ln(((SELECT count(*) FROM mem) - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM mi GROUP BY term), mf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM ms) ELSE raw END AS idf FROM ms),
ma AS (SELECT (SELECT sum(len(tokens)) FROM mt) / (SELECT count(*) FROM mem) AS avgdl), mq0 AS (SELECT request_id, project_id, unnest(regexp_extract_all(query, '[a-z0-9_]{2,}')) AS term FROM reqs), mq AS (SELECT request_id, project_id, term, count(*) AS qtf FROM mq0 GROUP BY ALL),
mb AS (SELECT mq.request_id, mi.memory_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))), 6) AS score FROM mi JOIN mf USING (term) JOIN mq ON mq.term = mi.term AND mq.project_id = mi.project_id, ma GROUP BY ALL HAVING score > 0),
bm AS (SELECT request_id, memory_id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, memory_id) AS rank FROM mb QUALIFY rank <= 50),
lists AS (SELECT request_id, memory_id, 0 AS list, rank FROM bm UNION ALL SELECT request_id, memory_id, 1, position FROM meta), rf AS (SELECT request_id, memory_id, sum(1.0::DOUBLE / (60 + rank)) AS base, min((list, rank)) AS f FROM lists GROUP BY ALL),
top AS (SELECT request_id, memory_id, base FROM rf QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY round(base, 12) DESC, f, memory_id) <= 100)"""


@query(
    "e11_retrieve",
    f"""WITH {_META}, {_INDEX}, fin AS (SELECT top.request_id, top.memory_id, round(greatest(0, 0.35 * base + 0.15 * recency_score + 0.2 * importance_score + 0.1 * confidence_score + {_BOOST} + CASE stability WHEN 'canonical' THEN 0.1 WHEN 'stable' THEN 0.05 ELSE 0 END), 9)::DOUBLE AS score
 FROM top JOIN mem USING (memory_id) JOIN tk USING (request_id) WHERE validity NOT IN ('superseded', 'rejected')) SELECT request_id, memory_id, round(score, 6) AS score FROM fin QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, memory_id) <= 50""",
)
def _(spark, d):
    return retrieve.retrieve(_asks(spark, d), views.mem(spark, d)).select("request_id", "memory_id", F.round("score", 6).alias("score"))


_RANKED_BM = "bm AS (SELECT request_id, memory_id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, memory_id) AS rank FROM mb QUALIFY rank <= 50)"
_ALL_INDEX = _INDEX.replace("ON mq.term = mi.term AND mq.project_id = mi.project_id", "ON mq.term = mi.term").replace(
    _RANKED_BM, f"{_RANKED_BM.replace('bm AS', 'b0 AS')}, bm AS (SELECT request_id, memory_id, row_number() OVER (PARTITION BY request_id ORDER BY rank) AS rank FROM b0 JOIN mem USING (memory_id) JOIN reqs USING (request_id, project_id))"
)


@query(
    "e11_global_retrieve",
    f"""WITH {_META}, {_ALL_INDEX}, fin AS (SELECT top.request_id, top.memory_id, round(greatest(0, 0.35 * base + 0.15 * recency_score + 0.2 * importance_score + 0.1 * confidence_score + {_BOOST} + CASE stability WHEN 'canonical' THEN 0.1 WHEN 'stable' THEN 0.05 ELSE 0 END), 9)::DOUBLE AS score
 FROM top JOIN mem USING (memory_id) JOIN tk USING (request_id) WHERE validity NOT IN ('superseded', 'rejected')) SELECT request_id, memory_id, round(score, 6) AS score FROM fin QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, memory_id) <= 50""",
)
def _(spark, d):
    return retrieve.retrieve(_asks(spark, d), views.mem(spark, d), scope="global").select("request_id", "memory_id", F.round("score", 6).alias("score"))


# Vectors of memories and of requests, from the embeddings by number.
_VECTORS = "mv AS (SELECT memory_id, project_id, embedding::DOUBLE[] AS e FROM mem JOIN embeddings ON memory_id = 'mem_' || vec_id), qv AS (SELECT request_id, project_id, embedding::DOUBLE[] AS q FROM reqs JOIN embeddings ON vec_id = substr(project_id, 6)::INT)"
_NEAREST = "vs AS (SELECT request_id, memory_id, round(list_cosine_similarity(q, e), 9) AS score FROM qv JOIN mv USING (project_id)), vl AS (SELECT request_id, memory_id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, memory_id) AS rank FROM vs QUALIFY rank <= 50)"


def _vectors(spark, d):
    rows = views.table(spark, d, "embeddings").select(F.concat(F.lit("mem_"), F.col("vec_id").cast("string")).alias("memory_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return rows.join(views.mem(spark, d).select("memory_id", "project_id"), "memory_id")


def _with_vectors(spark, d, requests):
    own = views.table(spark, d, "embeddings").select(F.concat(F.lit("proj_"), F.col("vec_id").cast("string")).alias("project_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return requests.join(own, "project_id", "left")


@query("e4_project_vectors", f"WITH {_REQS}, {_VECTORS}, {_NEAREST} SELECT request_id, memory_id, rank FROM vl")
def _(spark, d):
    return vectors.vector_candidates(_vectors(spark, d), _with_vectors(spark, d, _asks(spark, d)), 50).select("request_id", "memory_id", F.col("rank").cast("long").alias("rank"))


# Three lists, session rows, and a walk over links for the requests that want one.
_HYBRID_INDEX = _INDEX[: _INDEX.index("lists AS (")]
_HYBRID = f"""{_SESSION_META}, {_VECTORS}, {_NEAREST}, {_HYBRID_INDEX}lists AS (SELECT request_id, memory_id, 0 AS list, rank FROM bm UNION ALL SELECT request_id, memory_id, -1, rank FROM vl UNION ALL SELECT request_id, memory_id, 1, position FROM smeta),
rf AS (SELECT request_id, memory_id, sum(1.0::DOUBLE / (60 + rank)) AS base, min((list, rank)) AS f FROM lists GROUP BY ALL),
top AS (SELECT request_id, memory_id, base, row_number() OVER (PARTITION BY request_id ORDER BY round(base, 12) DESC, f, memory_id) AS place FROM rf QUALIFY place <= 100),
{LINKS_SQL[len(MEM_SQL) + 2:]}, e AS (SELECT source_id AS x, target_id AS y FROM links UNION SELECT target_id, source_id FROM links), {_STORED},
g0 AS (SELECT request_id AS g, memory_id AS x, hops FROM top JOIN plan USING (request_id) WHERE needs_graph AND place <= 10), g1 AS (SELECT g, y AS x, hops FROM g0 JOIN e USING (x) WHERE hops > 1 UNION FROM g0), g2 AS (SELECT g, y AS x, hops FROM g1 JOIN e USING (x) WHERE hops > 2 UNION FROM g1),
walked AS (SELECT g AS request_id, x AS memory_id FROM g2 UNION SELECT g, y FROM g2 JOIN st USING (x) WHERE y IN (SELECT memory_id FROM mem)),
every AS (SELECT request_id, memory_id, base FROM top UNION ALL SELECT request_id, memory_id, 0.5 FROM walked ANTI JOIN top USING (request_id, memory_id))"""


@query(
    "e11_hybrid_retrieve",
    f"""WITH {_HYBRID}, fin AS (SELECT every.request_id, every.memory_id, round(greatest(0, 0.35 * base + 0.15 * recency_score + 0.2 * importance_score + 0.1 * confidence_score + {_BOOST} + CASE stability WHEN 'canonical' THEN 0.1 WHEN 'stable' THEN 0.05 ELSE 0 END), 9)::DOUBLE AS score
 FROM every JOIN mem USING (memory_id) JOIN plan ON every.request_id = plan.request_id WHERE validity NOT IN ('superseded', 'rejected')) SELECT request_id, memory_id, round(score, 6) AS score FROM fin QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, memory_id) <= 50""",
)
def _(spark, d):
    requests = _with_vectors(spark, d, _own_asks(spark, d))
    found = retrieve.retrieve(requests, _linked_memories(spark, d), views.links(spark, d), vectors=_vectors(spark, d), states=_states(spark, d))
    return found.select("request_id", "memory_id", F.round("score", 6).alias("score"))


@query("e12_suppress_stale_facts", f"WITH {_LISTS} SELECT request_id, memory_id FROM fused JOIN mem USING (memory_id) WHERE NOT contains(lower(raw_text), 'engine3') AND NOT contains(lower(raw_text), 'step')")
def _(spark, d):
    facts = _asks(spark, d).select("request_id", F.explode(F.array(F.lit("ENGINE3"), F.lit("step"))).alias("fact"))
    found = _fused(spark, d).join(views.mem(spark, d), "memory_id")
    return retrieve.suppress_stale_facts(found, facts).select("request_id", "memory_id")


@query(
    "e13_expand_query",
    f"""WITH {_REQS}, v AS (SELECT request_id, unnest([query] || CASE substr(project_id, 6)::INT % 4 WHEN 0 THEN ['error bug fix ' || query, 'traceback exception ' || query] WHEN 1 THEN ['design decision ADR ' || query] WHEN 2 THEN ['implement requirement ' || query] ELSE [] END) AS query FROM reqs) SELECT * FROM v""",
)
def _(spark, d):
    return retrieve.expand_query(_asks(spark, d)).select("request_id", "query")


def _section_sql(name: str, place: int) -> str:
    share = "CASE task " + " ".join(f"WHEN '{t}' THEN {x[place]}" for t, x in retrieve.SHARES.items()) + f" ELSE {retrieve.SHARES['feature'][place]} END"
    learned = retrieve.LEARNED.get(name, 1.0)
    factor = f"CASE task WHEN 'debugging' THEN 1.0 ELSE {learned} END" if name == "errors" else str(learned)
    return f"floor(floor(b * {share}) * {factor})::BIGINT AS {name}"


_SECTIONS = [n for n in retrieve.SECTIONS if n != "buffer"]


@query(
    "e14_token_budget",
    f"""WITH {_REQS}, t AS (SELECT request_id, {_TASK} AS task, 1000 + substr(project_id, 6)::INT * 37 AS b FROM (SELECT *, CASE WHEN substr(project_id, 6)::INT % 5 = 0 THEN 'research ' || query ELSE query END AS q FROM reqs)),
s AS (SELECT request_id, b, {", ".join(_section_sql(n, i) for i, n in enumerate(_SECTIONS))} FROM t) SELECT * EXCLUDE (b), (b - ({" + ".join(_SECTIONS)}))::BIGINT AS buffer FROM s""",
)
def _(spark, d):
    i = F.substring("project_id", 6, 10).cast("int")
    asks = _asks(spark, d).withColumn("query", F.when(i % 5 == 0, F.concat(F.lit("research "), "query")).otherwise(F.col("query")))
    return retrieve.token_budget(retrieve.make_plan(asks).withColumn("token_budget", 1000 + i * 37)).select("request_id", *[F.col(n).cast("long").alias(n) for n in (*_SECTIONS, "buffer")])


@query("e15_estimate_tokens", "SELECT doc_id, CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END::INT AS tokens FROM documents")
def _(spark, d):
    return views.table(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("e16_conversation_requests", "SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'user'), '') AS query FROM conversations GROUP BY conv_id")
def _(spark, d):
    return retrieve.conversation_requests(views.table(spark, d, "conversations"))


@query("e16_inject_packs", "SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, -1, 'system', '[context, sufficiency 0.75]' || chr(10) || arg_min(text, turn) FROM conversations GROUP BY conv_id")
def _(spark, d):
    talk = views.table(spark, d, "conversations")
    packs = talk.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text")).withColumn("sufficiency", F.lit(0.75))
    return retrieve.inject_packs(talk, packs)
