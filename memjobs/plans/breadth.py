"""Queries over sources, tool output, code, verification and streams, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memjobs.operators import code, tools, verify
from memjobs.plans import projects, writing
from memjobs.plans.registry import registry
from memjobs.sources import readers, tables, views
from memjobs.sources.views import EV_SQL, MEM_SQL
from memjobs.streaming import jobs

QUERIES, ORACLES, query = registry()

_COMMITS = f"{EV_SQL}, commits AS (SELECT project_id AS repo, row_number() OVER (PARTITION BY project_id ORDER BY timestamp, event_id) - 1 AS i, raw_text AS subject, CASE WHEN event_type = 'code_change' THEN [file_path] ELSE [] END AS files FROM ev)"


def _commits(spark, d):
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("timestamp", "event_id")) - 1
    files = F.when(F.col("event_type") == "code_change", F.array("file_path")).otherwise(F.array().cast("array<string>"))
    return views.ev(spark, d).select(F.col("project_id").alias("repo"), place.alias("i"), F.col("raw_text").alias("subject"), files.alias("files"), F.lit(None).cast("string").alias("stat"), F.lit("2024-03-01").cast("timestamp").alias("base"))


@query(
    "a5_commits_to_events",
    f"""WITH {_COMMITS} SELECT repo, i::INT AS i, 'user_message' AS event_type, subject AS raw_text, i * 60 AS seconds FROM commits
UNION ALL SELECT repo, i::INT, 'code_change', 'Changed files: ' || files[1] || chr(10), i * 60 + 30 FROM commits WHERE len(files) > 0""",
)
def _(spark, d):
    seconds = F.col("timestamp").cast("long") - F.lit("2024-03-01").cast("timestamp").cast("long")
    return readers.commits_to_events(_commits(spark, d)).select("repo", "i", "event_type", "raw_text", seconds.alias("seconds"))


@query(
    "a6_commit_windows",
    f"""WITH {_COMMITS}, n AS (SELECT repo, count(*) AS n FROM commits GROUP BY 1), w AS (SELECT repo, unnest(range(0, n - 5, 3)) AS start FROM n WHERE n >= 6), s AS (SELECT w.repo, start, list(subject ORDER BY i) AS subjects FROM w JOIN commits c ON c.repo = w.repo AND i >= start AND i < start + 6 GROUP BY ALL),
x AS (SELECT repo, start, unnest(list_filter(string_split(lower(array_to_string(subjects, ' ')), ' '), lambda q: length(q) > 3)) AS word FROM s), c AS (SELECT repo, start, word, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY repo, start ORDER BY n DESC, word) AS r FROM c QUALIFY r <= 3),
q AS (SELECT repo, start, string_agg(word, ' ' ORDER BY r) AS query FROM t GROUP BY ALL) SELECT repo, start, array_to_string(subjects[1:3], '|') AS goals, coalesce(query, '') AS query FROM s LEFT JOIN q USING (repo, start)""",
)
def _(spark, d):
    return readers.commit_windows(_commits(spark, d), 6).select("repo", F.col("start").cast("long").alias("start"), F.array_join("goals", "|").alias("goals"), "query")


@query(
    "c11_parse_tool_output",
    f"""WITH {EV_SQL}, c AS (SELECT *, 200 + 4 * k AS code FROM ev WHERE event_type = 'tool_call')
SELECT event_id, 'fact' AS memory_type, 'pytest: ' || CASE WHEN m > 0 THEN 'failing' WHEN k > 0 THEN 'passing' ELSE 'unknown' END || ', ' || k || ' passed, ' || m || ' failed' AS summary FROM c WHERE k % 4 = 0
UNION ALL SELECT event_id, 'error', 'mypy: 1 issues' FROM c WHERE k % 4 = 1
UNION ALL SELECT event_id, 'fact', 'API ' || CASE WHEN code < 400 THEN 'success' ELSE 'error' END || ': HTTP ' || code FROM c WHERE k % 4 = 2
UNION ALL SELECT event_id, 'error', 'API error: HTTP ' || code FROM c WHERE k % 4 = 2 AND code >= 400
UNION ALL SELECT event_id, 'fact', 'Coverage: ' || k || '.0%' FROM c WHERE k % 4 = 3
UNION ALL SELECT event_id, 'error', 'Low coverage: ' || k || '.0%' FROM c WHERE k % 4 = 3 AND k < 50""",
)
def _(spark, d):
    return tools.parse_tool_output(views.ev(spark, d).withColumn("content", F.col("raw_text"))).select("event_id", "memory_type", "summary")


# Output of the other families of tools, with and without what each looks for; plain SQL that Spark and DuckDB read alike.
_TOOL = "CASE n % 8 WHEN 0 THEN 'git_diff' WHEN 1 THEN 'ripgrep' WHEN 2 THEN 'docker' WHEN 3 THEN 'terraform' WHEN 4 THEN 'kubectl' WHEN 5 THEN 'pip' WHEN 6 THEN 'bandit' ELSE 'jest' END"
_OUTPUT = """CASE n % 8
 WHEN 0 THEN 'diff --git a/src/f' || m || '.py b/src/f' || m || '.py' || chr(10) || '+  def new_' || k || '():' || chr(10) || CASE WHEN k % 2 = 0 THEN '-def old_' || m || '():' ELSE ' same' END
 WHEN 1 THEN CASE WHEN k % 2 = 0 THEN 'src/a' || m || '.py:' || k || ': x' || chr(10) || 'src/b' || m || '.py:3: y' || chr(10) || 'src/a' || m || '.py:9: z' ELSE 'nothing found' END
 WHEN 2 THEN CASE WHEN k % 2 = 0 THEN 'Step 1' || chr(10) || 'Successfully built abcdef01234' || m ELSE 'build failed at step ' || k END
 WHEN 3 THEN CASE WHEN k % 2 = 0 THEN 'Plan: ' || k || ' to add, ' || m || ' to change, 0 to destroy.' ELSE 'Error: no provider ' || m END
 WHEN 4 THEN 'NAME READY' || chr(10) || 'web-' || m || ' 1/1 Running' || chr(10) || 'job-' || k || ' 0/1 ' || CASE WHEN k % 2 = 0 THEN 'Pending' ELSE 'CrashLoopBackOff' END
 WHEN 5 THEN CASE k % 3 WHEN 0 THEN 'Successfully installed lib-' || k WHEN 1 THEN 'found ' || k || ' vulnerabilities' ELSE 'up to date' END
 WHEN 6 THEN CASE WHEN k % 2 = 0 THEN 'High severity: 1' || chr(10) || 'Low severity: 2' || chr(10) || 'high severity' ELSE 'No issues' END
 ELSE CASE WHEN k % 2 = 0 THEN 'FAILED tests/t_' || m || '.py::test_' || k || ' - boom' || chr(10) || 'assert ' || k || chr(10) || '= 1 passed, 2 failed' ELSE k || ' passed' END END"""


@query(
    "c11_other_tools",
    f"""WITH {EV_SQL}, c AS (SELECT *, substr(event_id, 5)::INT AS n FROM ev WHERE event_type = 'tool_call'), o AS (SELECT event_id, n, k, m, {_OUTPUT} AS t FROM c)
SELECT event_id, 'code_change' AS memory_type, 'Diff: src/f' || m || '.py' AS summary FROM o WHERE n % 8 = 0
UNION ALL SELECT event_id, 'fact', 'Changes: +new_' || k || CASE WHEN k % 2 = 0 THEN ' -old_' || m ELSE '' END FROM o WHERE n % 8 = 0
UNION ALL SELECT event_id, 'fact', 'Search found: src/a' || m || '.py, src/b' || m || '.py' FROM o WHERE n % 8 = 1 AND k % 2 = 0
UNION ALL SELECT event_id, 'fact', 'docker: ' || t FROM o WHERE n % 8 = 2 AND k % 2 = 0
UNION ALL SELECT event_id, 'fact', 'Docker image built: abcdef01234' || m FROM o WHERE n % 8 = 2 AND k % 2 = 0
UNION ALL SELECT event_id, 'error', 'docker build failed: ' || t FROM o WHERE n % 8 = 2 AND k % 2 = 1
UNION ALL SELECT event_id, 'fact', CASE WHEN k % 2 = 0 THEN 'Terraform plan: +' || k || ' ~' || m || ' -0' ELSE 'terraform: ' || t END FROM o WHERE n % 8 = 3
UNION ALL SELECT event_id, 'error', 'Terraform error: ' || t FROM o WHERE n % 8 = 3 AND k % 2 = 1
UNION ALL SELECT event_id, 'fact', 'K8s status: web-' || m || ':Running job-' || k || CASE WHEN k % 2 = 0 THEN ':Pending' ELSE ':CrashLoopBackOff' END FROM o WHERE n % 8 = 4
UNION ALL SELECT event_id, 'error', 'K8s pod error detected' FROM o WHERE n % 8 = 4 AND k % 2 = 1
UNION ALL SELECT event_id, CASE k % 3 WHEN 1 THEN 'error' ELSE 'fact' END, CASE k % 3 WHEN 0 THEN 'Installed: lib-' || k WHEN 1 THEN 'Package vulnerabilities found: ' || k ELSE 'pip: up to date' END FROM o WHERE n % 8 = 5
UNION ALL SELECT event_id, CASE k % 2 WHEN 0 THEN 'error' ELSE 'fact' END, CASE k % 2 WHEN 0 THEN 'bandit security: high:2, low:1' ELSE 'bandit: No issues' END FROM o WHERE n % 8 = 6
UNION ALL SELECT event_id, 'fact', 'jest: ' || CASE WHEN k % 2 = 0 THEN 'failing, 1 passed, 2 failed' ELSE 'passing, ' || k || ' passed' END FROM o WHERE n % 8 = 7
UNION ALL SELECT event_id, 'error', 'Test fail: test_' || k || ' in tests/t_' || m || '.py' FROM o WHERE n % 8 = 7 AND k % 2 = 0""",
)
def _(spark, d):
    calls = views.ev(spark, d).where("event_type = 'tool_call'").withColumn("n", F.substring("event_id", 5, 20).cast("int"))
    made = calls.selectExpr("event_id", "event_type", f"{_TOOL} AS tool_name", f"{_OUTPUT} AS content")
    return tools.parse_tool_output(made).select("event_id", "memory_type", "summary")


@query("c7_tool_call_rules", f"WITH {writing._ROWS} SELECT event_id, memory_type, source_type, summary FROM found WHERE event_type = 'tool_call' AND memory_type <> 'event'")
def _(spark, d):
    from memjobs.operators import extract

    rows = extract.extract_memories(views.ev(spark, d).where("event_type = 'tool_call'")).where("memory_type <> 'event'")
    return rows.select("event_id", "memory_type", "source_type", F.col("compressed_summary").alias("summary"))


@query(
    "c8_from_precomputed",
    f"""WITH {EV_SQL} SELECT event_id, 'decision' AS memory_type, 'use engine' || m AS summary, 'proposed' AS decision_status, NULL AS error_kind, 0.5::DOUBLE AS importance FROM ev
UNION ALL SELECT event_id, 'fact', raw_text, NULL, 'crash', 0.75 FROM ev""",
)
def _(spark, d):
    item = lambda **x: F.struct(*[v.alias(n) for n, v in x.items()])
    none = F.lit(None).cast("string")
    made = F.array(
        item(memory_type=F.lit("decision"), summary=F.concat(F.lit("use engine"), F.col("m").cast("string")), status=F.lit("proposed"), error_kind=none, importance=F.lit(None).cast("double")),
        item(memory_type=F.lit("strange"), summary=F.col("raw_text"), status=none, error_kind=F.lit("crash"), importance=F.lit(0.75)),
    )
    rows = tools.from_precomputed(views.ev(spark, d).withColumn("llm_extracted", F.to_json(made)))
    return rows.select("event_id", "memory_type", "summary", "decision_status", "error_kind", "importance")


# A Python file for each session, in a folder for each project: a function of two lines for each event.
_FN = f"{EV_SQL}, fn AS (SELECT project_id, 'src/' || project_id || '/' || session_id || '.py' AS file_path, 'fn_' || k AS name, m, row_number() OVER (PARTITION BY project_id, session_id ORDER BY timestamp, event_id) - 1 AS i FROM ev)"


def _path():
    return F.concat(F.lit("src/"), "project_id", F.lit("/"), "session_id", F.lit(".py")).alias("file_path")


def _files(spark, d):
    body = F.concat(F.lit("def fn_"), F.col("k").cast("string"), F.lit("(x):\n    return helper_"), F.col("m").cast("string"), F.lit("(x)\n"))
    rows = views.ev(spark, d).groupBy("project_id", "session_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "event_id", body.alias("body")))).alias("b"))
    return rows.select(_path(), F.array_join(F.transform("b", lambda x: x["body"]), "").alias("content"))


@query("a1_read_session_logs", f"WITH {EV_SQL} SELECT 'evt_log_' || lpad((row_number() OVER (PARTITION BY project_id ORDER BY timestamp, event_id) - 1)::VARCHAR, 3, '0') AS event_id, event_type, raw_text, tool_name FROM ev")
def _(spark, d):
    folder = tables.shared_folder(spark, "logs")
    line = F.concat(F.to_json(F.struct("event_type", F.col("timestamp"), "raw_text", "tool_name")), F.lit("\n"))
    tables.write_files(views.ev(spark, d).select(F.concat(F.coalesce("project_id", F.lit("none")), F.lit(".json")).alias("path"), line.alias("content"), "timestamp", "event_id"), folder, ("timestamp", "event_id"))
    return readers.read_session_logs(spark, folder, "all", "log").select("event_id", "event_type", "raw_text", F.col("payload")["tool_name"].alias("tool_name"))


# A source tree: each project's first text as a file, some of them in skipped folders, with other endings or without UTF-8.
_TREE = f"{EV_SQL}, told AS (SELECT project_id, arg_min(raw_text, (timestamp, event_id)) AS content, substr(project_id, 6)::INT AS i FROM ev GROUP BY project_id)"
_TREE_PATH = "'src/' || CASE WHEN i % 5 = 0 THEN 'node_modules/' WHEN i % 7 = 0 THEN 'lib/__pycache__/' ELSE 'lib' || i % 3 || '/' END || project_id || CASE i % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.rs' WHEN 2 THEN '.md' ELSE '.hpp' END"


def _tree(spark, d) -> str:
    """The folder of the tree, whose files tasks write."""
    told = views.ev(spark, d).groupBy("project_id").agg(F.min_by("raw_text", F.struct("timestamp", "event_id")).alias("content")).withColumn("i", F.substring("project_id", 6, 10).cast("int"))
    folder = tables.shared_folder(spark, "tree")
    tables.write_files(told.selectExpr(f"{_TREE_PATH} AS path", "coalesce(content, '') || '\\n' AS content"), folder)
    return folder


@query("a7_read_source_files", f"WITH {_TREE}, f AS (SELECT {_TREE_PATH} AS file_path, content FROM told) SELECT file_path, content || chr(10) AS content FROM f WHERE NOT regexp_matches(file_path, 'node_modules|__pycache__') AND NOT ends_with(file_path, '.md')")
def _(spark, d):
    folder = _tree(spark, d)
    rows = readers.read_source_files(spark, folder)
    return rows.select(F.regexp_extract("file_path", "/(src/.*)$", 1).alias("file_path"), "content")


@query("l1_index_code_regex", f"WITH {_FN} SELECT file_path, name, 'function' AS symbol_type, (2 * i + 1)::INT AS line_start FROM fn")
def _(spark, d):
    return code.index_code_regex(_files(spark, d)).select("file_path", "name", "symbol_type", "line_start")


@query("l2_index_code_python", f"WITH {_FN} SELECT file_path, name, 'def ' || name || '(x)' AS signature, (2 * i + 1)::INT AS line_start, (2 * i + 2)::INT AS line_end, 'helper_' || m AS calls FROM fn")
def _(spark, d):
    rows = code.index_code_python(_files(spark, d))
    return rows.select("file_path", "name", "signature", "line_start", "line_end", F.array_join("calls", "|").alias("calls"))


@query("l3_search_symbols", f"WITH {_FN} SELECT file_path, name, needle FROM fn JOIN (SELECT unnest(['fn_7', '_3']) AS needle) ON contains(name, needle)")
def _(spark, d):
    return code.search_symbols(code.index_code_python(_files(spark, d)), ["fn_7", "_3"]).select("file_path", "name", "needle")


# A name called in one file is defined in any of the project's.
_EDGES = f"""{_FN}, called AS (SELECT DISTINCT a.project_id, a.file_path, a.name AS caller, b.name AS callee FROM fn a JOIN fn b ON a.file_path = b.file_path AND b.i IN (a.i + 1, a.i + 2) AND a.name <> b.name),
ed AS (SELECT DISTINCT c.file_path, caller, f.file_path AS callee_path, callee FROM called c JOIN fn f ON c.project_id = f.project_id AND callee = f.name)"""


def _edges(spark, d):
    return _edges_of(code.index_code_regex(_files(spark, d)))


def _edges_of(symbols):
    return code.call_edges(symbols, F.regexp_extract("file_path", "^src/([^/]+)/", 1))


@query("l4_call_edges", f"WITH {_EDGES} SELECT file_path, caller, callee_path, callee FROM ed")
def _(spark, d):
    return _edges(spark, d)


@query("l4_callers_callees", f"WITH {_EDGES} SELECT 'caller' AS kind, callee AS name, file_path, caller AS other FROM ed WHERE callee IN ('fn_7', 'fn_12') UNION SELECT 'callee', caller, callee_path, callee FROM ed WHERE caller IN ('fn_7', 'fn_12')")
def _(spark, d):
    edges = _edges_of(tables.written(code.index_code_regex(_files(spark, d))))
    names = spark.range(1).select(F.explode(F.array(F.lit("fn_7"), F.lit("fn_12"))).alias("callee"))  # stated, so no edge is made to find them
    up = code.callers(edges, names).select(F.lit("caller").alias("kind"), F.col("callee").alias("name"), "file_path", F.col("caller").alias("other"))
    down = code.callees(edges, names.withColumnRenamed("callee", "caller"))
    return up.union(down.select(F.lit("callee"), "caller", "callee_path", "callee"))


_CHANGES = f"{_EDGES}, ch AS (SELECT DISTINCT 'src/' || project_id || '/' || session_id || '.py' AS file_path, k % 12 + 1 AS line FROM ev WHERE event_type = 'code_change' AND k % 3 = 0), hit AS (SELECT DISTINCT fn.file_path, name FROM fn JOIN ch ON fn.file_path = ch.file_path AND line BETWEEN 2 * i + 1 AND 2 * i + 2)"


def _changes(spark, d):
    return views.ev(spark, d).where("event_type = 'code_change' and k % 3 = 0").select(_path(), (F.col("k") % 12 + 1).alias("line"))


@query("l5_affected_symbols", f"WITH {_CHANGES} SELECT file_path, name FROM hit")
def _(spark, d):
    return code.affected_symbols(code.index_code_python(_files(spark, d)), _changes(spark, d))


@query(
    "l6_transitive_affected",
    f"""WITH {_CHANGES}, e AS (SELECT file_path AS fx, caller AS x, callee_path AS fy, callee AS y FROM ed UNION SELECT callee_path, callee, file_path, caller FROM ed), h1 AS (SELECT fy AS file_path, y AS name FROM hit JOIN e ON hit.file_path = fx AND hit.name = x UNION FROM hit)
SELECT fy AS file_path, y AS name FROM h1 JOIN e ON h1.file_path = fx AND h1.name = x UNION SELECT file_path, name FROM h1""",
)
def _(spark, d):
    seeds = code.affected_symbols(code.index_code_python(_files(spark, d)), _changes(spark, d))
    return code.transitive_affected(seeds, _edges(spark, d), 3)


@query("l7_dependency_chain", f"WITH {_EDGES}, u AS (SELECT callee_path AS file_path, callee AS name, string_agg(DISTINCT caller, '|' ORDER BY caller) AS upstream FROM ed GROUP BY ALL), w AS (SELECT file_path, caller AS name, string_agg(DISTINCT callee, '|' ORDER BY callee) AS downstream FROM ed GROUP BY ALL) SELECT file_path, name, upstream, downstream FROM u FULL JOIN w USING (file_path, name)")
def _(spark, d):
    rows = code.dependency_chain(_edges(spark, d))
    return rows.select("file_path", "name", F.array_join("upstream", "|").alias("upstream"), F.array_join("downstream", "|").alias("downstream"))


@query("l8_symbols_to_memories", f"WITH {_FN} SELECT 'function ' || name || ' in ' || file_path || ':' || (2 * i + 1) AS raw_text FROM fn")
def _(spark, d):
    return code.symbols_to_memories(code.index_code_python(_files(spark, d))).select("raw_text")


# Answers: each project's newest tool call speaks of a file, a test and a rejected decision.
_ANSWERS = f"""{MEM_SQL}, ans AS (SELECT DISTINCT project_id AS response_id, project_id, 'We must keep src/mod1/file1.py. Tests failed. ' || CASE WHEN substr(project_id, 6)::INT % 2 = 0 THEN 'See mem_12. ' ELSE '' END || 'Refactor module store' AS text FROM mem),
r AS (SELECT response_id, m.*, text FROM ans JOIN mem m USING (project_id))"""


def _answers(spark, d):
    even = F.substring("project_id", 6, 10).cast("int") % 2 == 0
    text = F.concat(F.lit("We must keep src/mod1/file1.py. Tests failed. "), F.when(even, "See mem_12. ").otherwise(""), F.lit("Refactor module store"))
    return views.mem(spark, d).select("project_id").distinct().select(F.col("project_id").alias("response_id"), "project_id", text.alias("text"))


def _verified(spark, d):
    answers = _answers(spark, d)
    held = views.mem(spark, d).join(answers.select("response_id", "project_id"), "project_id").withColumn("statement", F.when(F.col("memory_type") == "decision", F.col("raw_text")))
    return verify.verify_responses(answers, held)


_VERIFIED = f"""{_ANSWERS}, v AS (SELECT response_id, count(*) FILTER (WHERE validity = 'superseded' AND length(compressed_summary) > 10 AND contains(lower(text), lower(compressed_summary))) AS stale,
 count(*) FILTER (WHERE file_ref = 'src/mod1/file1.py') = 0 AS no_file, any_value(text) AS text FROM r GROUP BY 1),
s AS (SELECT response_id, stale AS n_violations, no_file::INT + CASE WHEN contains(text, 'mem_') THEN 0 ELSE 1 END AS n_warnings FROM v)"""


@query("i1_verify_responses", f"WITH {_VERIFIED} SELECT response_id, n_violations, n_warnings::BIGINT AS n_warnings, greatest(0, round(1 - 0.3 * n_violations - 0.05 * n_warnings, 6))::DOUBLE AS score, n_violations = 0 AS passed FROM s")
def _(spark, d):
    return _verified(spark, d).select("response_id", "n_violations", "n_warnings", "score", "passed")


@query("i3_repair_actions", f"WITH {_VERIFIED} SELECT response_id, CASE WHEN n_violations = 0 THEN 'pass' ELSE 'stale_flagged' END AS actions FROM s")
def _(spark, d):
    return verify.repair_actions(_verified(spark, d)).select("response_id", F.array_join("actions", "|").alias("actions"))


# One answer a project: ten forms, each with one finding, and one with two, over four memories of its own (of another project's in one form).
_FORMS = (
    ("rejected_decision_revival", "'Let us use the old engine ' || m || ' again. See mem_1'"), ("stale_usage", "'Right: cache is on node ' || k || ' now. See mem_1'"),
    ("tool_evidence_mismatch", "'The test run failed on ' || k || ', see mem_1'"), ("active_decision_contradiction", "'We do not adopt the new store ' || m || ', see mem_1'"),
    ("unverified_file", "'Look into src/lost' || k || '.py, see mem_1'"), ("unverified_symbol", "'The OrderLedger is fine, see mem_1'"), ("no_citations", "repeat('all is well ', 20)"),
    ("missing_citation_on_claim", "'the error is parser' || m"), ("unsupported_strong_claim", "'you must restart ' || m"), ("cross_project_leakage", "'fine, see mem_1'"),
    ("", "'Right: cache is on node ' || k || repeat(' all is well', 20)"),
)
_SAID = "CASE i % 11 " + " ".join(f"WHEN {n} THEN {text}" for n, (_, text) in enumerate(_FORMS)) + " END"
_HELD = (
    ("decision", "rejected", "user_message", "'use the old engine ' || m"), ("fact", "superseded", "user_message", "'cache is on node ' || k"),
    ("fact", "active", "tool_output", "'tests passed on ' || k"), ("decision", "active", "user_message", "'adopt the new store ' || m"),
)
_FORMED = f"{EV_SQL}, f AS (SELECT project_id, arg_min(k, (timestamp, event_id)) AS k, arg_min(m, (timestamp, event_id)) AS m, substr(project_id, 6)::INT AS i FROM ev GROUP BY project_id)"


def _formed(spark, d):
    rows = _firsts(spark, d)
    answers = rows.selectExpr("project_id AS response_id", "project_id", f"{_SAID} AS text")
    held = None
    for kind, validity, source, text in _HELD:
        own = "CASE i % 11 WHEN 9 THEN 'another' ELSE project_id END AS project_id"
        part = rows.selectExpr("project_id AS response_id", own, f"'{kind}' AS memory_type", f"'{validity}' AS validity", f"'{source}' AS source_type", f"{text} AS raw_text", f"CASE '{kind}' WHEN 'decision' THEN {text} END AS statement")
        held = part if held is None else held.unionAll(part)
    return verify.verify_responses(answers, held.withColumns({"compressed_summary": F.col("raw_text"), "file_references": F.array().cast("array<string>")}))


def _told(kinds: range, both: str) -> str:
    return "CASE i % 11 " + " ".join(f"WHEN {n} THEN '{_FORMS[n][0]}'" for n in kinds) + f" WHEN 10 THEN '{both}' ELSE '' END"


@query(
    "i1_every_kind",
    f"WITH {_FORMED} SELECT project_id AS response_id, {_told(range(4), 'stale_usage')} AS violations, {_told(range(4, 10), 'no_citations')} AS warnings, CASE WHEN i % 11 < 4 THEN 0.7 WHEN i % 11 < 10 THEN 0.95 ELSE 0.65 END::DOUBLE AS score, i % 11 BETWEEN 4 AND 9 AS passed FROM f",
)
def _(spark, d):
    return _formed(spark, d).select("response_id", F.array_join("violations", "|").alias("violations"), F.array_join("warnings", "|").alias("warnings"), "score", "passed")


@query("i3_every_action", f"WITH {_FORMED} SELECT project_id AS response_id, CASE i % 11 WHEN 0 THEN '' WHEN 1 THEN 'stale_flagged' WHEN 2 THEN '' WHEN 3 THEN 'contradiction_warning' WHEN 10 THEN 'stale_flagged|citation_requested' ELSE 'pass' END AS actions FROM f")
def _(spark, d):
    return verify.repair_actions(_formed(spark, d)).select("response_id", F.array_join("actions", "|").alias("actions"))


@query(
    "i2_verify_citations",
    f"""WITH {MEM_SQL}, a AS (SELECT memory_id AS answer_id, project_id AS own, [memory_id, 'mem_' || (substr(memory_id, 5)::INT + 1), 'mem_fff'] AS ids FROM mem WHERE k % 10 = 0), x AS (SELECT answer_id, own, unnest(ids) AS id FROM a),
c AS (SELECT answer_id, count(*) FILTER (WHERE m.memory_id IS NULL) AS missing, count(*) FILTER (WHERE validity IN ('superseded', 'rejected')) AS unusable, count(*) FILTER (WHERE project_id <> own) AS f FROM x LEFT JOIN mem m ON id = m.memory_id GROUP BY 1)
SELECT answer_id, missing, unusable, f AS foreign_, round(greatest(0, 1 - 0.25 * (missing + unusable + (f > 0)::INT)), 6)::DOUBLE AS score FROM c""",
)
def _(spark, d):
    rows = views.mem(spark, d)
    after = (F.substring("memory_id", 5, 20).cast("int") + 1).cast("string")
    answers = rows.where("k % 10 = 0").select(F.col("memory_id").alias("answer_id"), "project_id", F.concat(F.lit("see "), "memory_id", F.lit(" and mem_"), after, F.lit(", mem_fff")).alias("text"))
    return verify.verify_citations(answers, rows).select("answer_id", "missing", "unusable", F.col("foreign").alias("foreign_"), F.round("score", 6).alias("score"))


# Answers that deny and claim; packs of each project's first rows, and of another project's for some.
_CONSISTENT = f"""{MEM_SQL}, a AS (SELECT DISTINCT project_id AS answer_id, project_id, substr(project_id, 6)::INT AS i FROM mem), an AS (SELECT *, CASE WHEN i % 2 = 0 THEN 'We do not use engine' || i % 7 || ' here' ELSE 'All fine' END || CASE WHEN i % 3 = 0 THEN ' and changed a file' ELSE '' END AS text FROM a),
o AS (SELECT *, row_number() OVER (PARTITION BY project_id, memory_type, validity ORDER BY recency_score DESC, importance_score DESC, timestamp DESC, memory_id) AS n FROM mem), de AS (SELECT * FROM o WHERE memory_type = 'decision' AND validity = 'active' AND n <= 50),
co AS (SELECT answer_id, count(*) AS c FROM an JOIN de USING (project_id) WHERE i % 2 = 0 AND len(list_intersect(string_split(lower(text), ' '), string_split(lower(raw_text), ' '))) > 0 GROUP BY 1),
x AS (SELECT answer_id, coalesce(c, 0) AS contradicted, (i % 4 = 0)::INT AS foreign_, (i % 3 = 0 AND i % 6 <> 0)::INT AS unproved FROM an LEFT JOIN co USING (answer_id))"""


@query("i2_verify_consistency", f"WITH {_CONSISTENT} SELECT answer_id, contradicted::BIGINT AS contradicted, foreign_, unproved, greatest(0, round(1 - 0.25 * (contradicted + foreign_) - 0.1 * unproved, 6))::DOUBLE AS score, contradicted + foreign_ = 0 AS consistent FROM x")
def _(spark, d):
    rows = views.mem(spark, d).withColumn("statement", F.when(F.col("memory_type") == "decision", F.col("raw_text")))
    i = F.substring("project_id", 6, 10).cast("int")
    denies = F.when(i % 2 == 0, F.concat(F.lit("We do not use engine"), (i % 7).cast("string"), F.lit(" here"))).otherwise("All fine")
    text = F.concat(denies, F.when(i % 3 == 0, " and changed a file").otherwise(""))
    answers = rows.select("project_id").distinct().select(F.col("project_id").alias("answer_id"), "project_id", text.alias("text"))
    own = rows.groupBy("project_id").agg(F.min("memory_id").alias("own"))
    other = own.select(F.concat(F.lit("proj_"), (F.substring("project_id", 6, 10).cast("int") - 1).cast("string")).alias("project_id"), F.col("own").alias("other"))
    first = rows.agg(F.min_by("memory_id", "project_id").alias("a"), F.max_by("memory_id", "project_id").alias("b"), F.min("project_id").alias("p"))  # one row
    held = own.join(other, "project_id", "left").join(F.broadcast(first)).withColumn("other", F.coalesce("other", F.when(F.col("project_id") == F.col("p"), F.col("b")).otherwise(F.col("a"))))
    ids = F.when(i % 4 == 0, F.array("own", "other")).otherwise(F.array("own"))
    content = F.when(i % 6 == 0, "a TOOL told").otherwise("text")
    section = F.struct(content.alias("content"), ids.alias("memory_ids"))
    packs = held.select(F.col("project_id").alias("answer_id"), F.array(section).alias("sections"))
    out = verify.verify_consistency(answers, packs, rows)
    return out.select("answer_id", "contradicted", F.col("foreign").alias("foreign_"), "unproved", "score", "consistent")


def _stream(spark, d):
    schema = views.table(spark, d, "events").schema
    return views.ev_of(spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]"))  # a pattern: a stream takes a single file only so


@query("n1_stream_memories", f"WITH {writing._ROWS} SELECT DISTINCT event_id, memory_type FROM found")
def _(spark, d):
    return jobs.run_to_table(jobs.stream_memories(_stream(spark, d))).select("event_id", "memory_type").distinct()


@query("n2_stream_dedupe", f"WITH {MEM_SQL} SELECT project_id, session_id, memory_type, lower(raw_text) AS text, count(*) AS n FROM (SELECT DISTINCT project_id, session_id, memory_type, raw_text FROM mem) GROUP BY ALL")
def _(spark, d):
    rows = jobs.run_to_table(jobs.stream_dedupe(views.mem_of(_stream(spark, d)), "60 days"))
    return rows.groupBy("project_id", "session_id", "memory_type", F.lower("raw_text").alias("text")).agg(F.count("*").alias("n"))


@query("n3_stream_project_state", projects.ORACLES["g1_project_state"])
def _(spark, d):
    rows = jobs.run_to_state(views.mem_of(_stream(spark, d)))
    return rows.select("project_id", "project_phase", "current_branch", "test_status", "deployment_status", *[F.array_join(n, "|").alias(n) for n in ("latest_decisions", "current_bugs", "active_files")])


@query(
    "n4_stream_activity",
    f"""WITH {EV_SQL}, w AS (SELECT project_id, unnest(generate_series(time_bucket(INTERVAL 6 HOUR, timestamp) - INTERVAL 18 HOUR, time_bucket(INTERVAL 6 HOUR, timestamp), INTERVAL 6 HOUR)) AS s FROM ev)
SELECT project_id, epoch(s)::BIGINT AS start, count(*) AS n FROM w GROUP BY ALL""",
)
def _(spark, d):
    rows = jobs.stream_activity(views.ev(spark, d), "24 hours", "6 hours")
    return rows.select("project_id", F.col("start").cast("long").alias("start"), "n")


_PANES = f"{EV_SQL}, panes AS (SELECT project_id, date_trunc('hour', timestamp) AS hour, count(*) AS n FROM ev GROUP BY ALL)"
_ROLLING = ", ".join(f"(sum(n) OVER (PARTITION BY project_id ORDER BY hour RANGE BETWEEN INTERVAL {h - 1} HOUR PRECEDING AND CURRENT ROW))::BIGINT AS {n}" for n, h in jobs.WINDOWS.items())


@query("n4_rolling_activity", f"WITH {_PANES} SELECT project_id, epoch(hour)::BIGINT AS hour, {_ROLLING} FROM panes")
def _(spark, d):
    rows = jobs.rolling_activity(jobs.run_to_panes(_stream(spark, d)))
    return rows.withColumn("hour", F.unix_seconds("hour"))


# A file for each project, of one of seven languages: its ending and lines, and the symbols that stand in them as (type, name, line, calls); plain SQL texts.
_LANGUAGES = (
    (".py", ("'class Box' || k || ':'", "'    def put' || m || '(self):'", "'        go' || k || '(1)'"), (("class", "'Box' || k", 1, "'put' || m || '|go' || k"), ("method", "'put' || m", 2, "'go' || k"))),
    (".js", ("'function run' || k || '() {'", "'  help' || m || '(2)'", "'}'", "'const f' || m || ' = (x) => x'"), (("function", "'run' || k", 1, "'help' || m"), ("arrow_function", "'f' || m", 4, "''"))),
    (".ts", ("'interface I' || k || ' {'", "'}'", "'class C' || m || ' {'"), (("interface", "'I' || k", 1, "''"), ("class", "'C' || m", 3, "''"))),
    (".rs", ("'struct S' || k || ';'", "'fn main' || m || '() {'", "'    work' || k || '();'", "'}'"), (("struct", "'S' || k", 1, "'main' || m || '|work' || k"), ("function", "'main' || m", 2, "'work' || k"))),
    (".go", ("'func Go' || k || '() {'", "'  Stop' || m || '()'", "'}'", "'type T' || m || ' struct {}'"), (("function", "'Go' || k", 1, "'Stop' || m"), ("struct", "'T' || m", 4, "''"))),
    (".java", ("'public class J' || k || ' {'", "'}'", "'interface K' || m || ' {'"), (("class", "'J' || k", 1, "''"), ("interface", "'K' || m", 3, "''"))),
    (".hpp", ("'class D' || k || ' {'", "'int sum' || m || '(int a) {'"), (("class", "'D' || k", 1, "'sum' || m"), ("function", "'sum' || m", 2, "''"))),
)
_CODE_PATH = "'src/' || project_id || CASE i % 7 " + " ".join(f"WHEN {n} THEN '{ending}'" for n, (ending, _, _) in enumerate(_LANGUAGES)) + " END"
_CODE = "CASE i % 7 " + " ".join(f"WHEN {n} THEN " + " || chr(10) || ".join(lines) for n, (_, lines, _) in enumerate(_LANGUAGES)) + " END"
_IN_CODE = " UNION ALL ".join(
    f"SELECT {_CODE_PATH} AS file_path, '{kind}' AS symbol_type, {name} AS name, {line}::INT AS line_start, {calls} AS calls FROM f WHERE i % 7 = {n}" for n, (_, _, symbols) in enumerate(_LANGUAGES) for kind, name, line, calls in symbols
)


def _firsts(spark, d):
    first = F.min_by(F.struct("k", "m"), F.struct("timestamp", "event_id"))
    return views.ev(spark, d).groupBy("project_id").agg(first.alias("f")).selectExpr("project_id", "f.k", "f.m", "CAST(substr(project_id, 6) AS INT) AS i")


@query("l1_every_language", f"WITH {_FORMED} {_IN_CODE}")
def _(spark, d):
    files = _firsts(spark, d).selectExpr(f"{_CODE_PATH} AS file_path", f"{_CODE} AS content")
    return code.index_code_regex(files).select("file_path", "symbol_type", "name", "line_start", F.array_join("calls", "|").alias("calls"))


_MODULE = (
    "'import os'", "'from a.b import c' || m", "''", "'@cache' || m", "'class Box' || k || ':'", "'    \"\"\"Doc ' || k || '\"\"\"'", "'    def put(self, x=1):'", "'        return go' || k || '(os.path.join(x))'",
    "''", "'async def main(*a):'", "'    await run' || m || '()'",
)
_IN_MODULE = (
    ("'os'", "import", 1, 1, "NULL", "NULL", "NULL", "''", "''"), ("'a.b.c' || m", "import", 2, 2, "NULL", "NULL", "NULL", "''", "''"),
    ("'Box' || k", "class", 5, 8, "NULL", "'Doc ' || k", "NULL", "'cache' || m", "'go' || k || '|join'"),
    ("'Box' || k || '.put'", "method", 7, 8, "'def put(self, x=1)'", "NULL", "'Box' || k", "''", "'go' || k || '|join'"),
    ("'main'", "function", 10, 11, "'def main(*a)'", "NULL", "NULL", "''", "'run' || m"),
)
_MODULE_ROWS = " UNION ALL ".join(
    f"SELECT project_id || '.py' AS file_path, {name} AS name, '{kind}' AS symbol_type, {lo}::INT AS line_start, {hi}::INT AS line_end, {signature}::VARCHAR AS signature, {doc}::VARCHAR AS docstring, {parent}::VARCHAR AS parent, {marks} AS decorators, {calls} AS calls FROM f"
    for name, kind, lo, hi, signature, doc, parent, marks, calls in _IN_MODULE
)


@query("l2_classes_imports_calls", f"WITH {_FORMED} {_MODULE_ROWS}")
def _(spark, d):
    files = _firsts(spark, d).selectExpr("project_id || '.py' AS file_path", " || chr(10) || ".join(_MODULE) + " AS content")
    rows = code.index_code_python(files)
    return rows.select("file_path", "name", "symbol_type", "line_start", "line_end", "signature", "docstring", "parent", *[F.array_join(c, "|").alias(c) for c in ("decorators", "calls")])
