"""Operators on small literal fixtures."""

import re

import pytest
from pyspark.sql import functions as F

from memjobs.functions import sessions
from memjobs.functions import text as T
from memjobs.operators import code, extract, ledger, lifecycle, links, packs, retrieve, tools, verify
from memjobs.operators import sessions as session_ops
from memjobs.sources import readers
from memjobs.sources.views import AS_OF
from memjobs.streaming import jobs


def values(df):
    return [tuple(r) for r in df.collect()]


def test_redaction_hides_secrets_and_is_stable(spark):
    # Parts are joined here so that no whole key stands in this file.
    fixtures = {
        "api": "api_key = 'abcd1234" + "efgh5678'", "password": "password: hunter" + "22", "aws": "AKIA" + "ABCDEFGH12345678", "url": "postgres://user:" + "secret_pass@localhost:5432/db", "github": "ghp_" + "a1" * 20, "clean": "Nothing to hide here",
    }
    df = spark.createDataFrame(list(fixtures.items()), "k string, t string")
    got = {k: (a, b, n) for k, a, b, n in values(df.select("k", T.redact_secrets(F.col("t")), T.redact_secrets(T.redact_secrets(F.col("t"))), F.size(T.secret_types(F.col("t")))))}
    assert got["clean"] == (fixtures["clean"], fixtures["clean"], 0)
    assert all("[REDACTED]" in a and a == b and n > 0 for k, (a, b, n) in got.items() if k != "clean")
    assert got["url"][0] == "postgres://user:[REDACTED]@localhost:5432/db"


def test_goals_and_errors():
    assert sessions.goals("We need to fix the login flow. Then rest") == ["fix the login flow. Then rest", "the login flow. Then rest"]
    assert sessions.goals("We should maybe consider it") == [] and sessions.goals(None) == []
    assert sessions.goals("We must add tests! we must ADD TESTS!") == ["add tests! we must ADD TESTS"]
    assert sessions.errors("ValueError: bad input given")[0] == "bad input given"
    trace = 'Traceback (most recent call last):\n  File "a.py", line 1\nKeyError: missing key'
    assert sessions.errors(trace)[0].startswith("Traceback")


def events(spark, *rows):
    return spark.createDataFrame([(f"evt_{i}", "p", "s", kind, text, None, None, None) for i, (kind, text) in enumerate(rows)], "event_id string, project_id string, session_id string, event_type string, raw_text string, tool_name string, file_path string, error_kind string").withColumn("timestamp", F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(mins=F.substring("event_id", 5, 3).cast("int")))


def test_write_path_types_scores_and_first_duplicates(spark):
    rows = extract.write_memories(events(spark, ("user_message", "Decision: use PostgreSQL because it is fast"), ("user_message", "decision: use postgresql  because it is fast"), ("error", None), ("assistant_response", "Which one?")))
    got = {(e, k): s for e, k, s in values(rows.select("event_id", "memory_type", F.round("importance_score", 3)))}
    assert got[("evt_0", "decision")] == 1.0 and ("evt_1", "decision") not in got
    assert got[("evt_2", "error")] == 0.75 and ("evt_3", "uncertainty") in got
    assert len({r.memory_id for r in rows.collect()}) == rows.count()


def test_rrf_adds_reciprocal_ranks(spark):
    lists = [("a", 0, 1), ("b", 0, 2), ("c", 0, 3), ("b", 1, 1), ("c", 1, 2), ("d", 1, 3), ("a", 2, 1), ("d", 2, 2)]
    df = spark.createDataFrame([("r", *x) for x in lists], "request_id string, memory_id string, list int, rank int")
    got = values(retrieve.rrf(df).orderBy("place").select("memory_id", "score"))
    want = {}
    for m, _, rank in lists:
        want[m] = want.get(m, 0) + 1 / (60 + rank)
    assert [m for m, _ in got] == ["a", "b", "c", "d"] and dict(got) == pytest.approx(want)


def decisions(spark, *rows):
    return spark.createDataFrame([(f"m{i}", "p", f"2024-01-0{i + 1}", s, "active", []) for i, s in enumerate(rows)], "memory_id string, project_id string, timestamp string, statement string, validity string, file_references array<string>").withColumn("timestamp", F.to_timestamp("timestamp"))


def test_later_decision_supersedes(spark):
    df = decisions(spark, "use PostgreSQL for main DB.", "write the docs", "use SQLite for main DB.", "use MySQL for main DB.")
    assert sorted(values(links.supersede_decisions(df))) == [("m0", "m2"), ("m2", "m3")]


def test_graph_walk_and_hops(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("c", "d", "y")], "source_id string, target_id string, relation_type string")
    seeds = spark.createDataFrame([("g", "a")], "group_id string, memory_id string")
    reach = lambda **o: sorted(m for _, m in values(links.expand_graph(seeds, edges, **o)))
    assert reach() == ["a", "b"] and reach(max_hops=4) == ["a", "b", "c", "d"] and reach(max_hops=4, relation_types=["x"]) == ["a", "b", "c"]


def test_corrections_fold(spark):
    memories = spark.createDataFrame([(m, 0.5, "active", False) for m in "abcd"], "memory_id string, importance_score double, validity string, never_delete boolean")
    log = [("a", "stale", 1), ("a", "incorrect", 2), ("b", "important", 1), ("b", "important", 2), ("b", "unpin", 3), ("c", "delete", 1), ("d", "nonsense", 1)]
    got = {r.memory_id: (round(r.importance_score, 3), r.validity, r.never_delete) for r in lifecycle.apply_corrections(memories, spark.createDataFrame(log, "memory_id string, action string, at int")).collect()}
    assert got == {"a": (0.5, "disputed", False), "b": (0.9, "active", False), "d": (0.5, "active", False)}


def test_upsert_and_delete_cascade(spark):
    base, new = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, at int, v string"), spark.createDataFrame([("a", 2, "z"), ("c", 0, "w"), ("b", 0, "old")], "k string, at int, v string")
    assert sorted((r.k, r.v) for r in ledger.upsert(base, new, ["k"], "at").collect()) == [("a", "z"), ("b", "y"), ("c", "w")]
    memories = spark.createDataFrame([("a",), ("b",)], "memory_id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "b")], "source_id string, target_id string")
    kept, left = ledger.delete_memories(memories, edges, spark.createDataFrame([("a",)], "memory_id string"))
    assert values(kept) == [("b",)] and values(left) == [("b", "b")]


TOOLS = {
    ("docker", "Step 1 ok\nSuccessfully built abcdef123456"): ["docker: Step 1 ok\nSuccessfully built abcdef123456", "Docker image built: abcdef123456"],
    ("terraform", "Plan: 3 to add, 1 to change, 2 to destroy."): ["Terraform plan: +3 ~1 -2"],
    ("kubectl", "NAME READY STATUS\nweb-1 0/1 CrashLoopBackOff 5"): ["K8s status: web-1:CrashLoopBackOff", "K8s pod error detected"],
    ("curl", "HTTP/1.1 500 Internal"): ["API error: HTTP 500", "API error: HTTP 500"],
    ("trivy", "2 found: high severity, HIGH severity, low severity"): ["trivy security: high:2, low:1"],
    ("coverage", "TOTAL 45%"): ["Coverage: 45.0%", "Low coverage: 45.0%"],
    ("npm", "found 3 vulnerabilities"): ["Package vulnerabilities found: 3"],
    ("pytest", "FAILED tests/test_a.py::test_x - boom\nassert 1 == 2\n====\n1 failed, 2 passed"): ["pytest: failing, 2 passed, 1 failed", "Test fail: test_x in tests/test_a.py"],
    ("git", "diff --git a/x.py b/x.py\n+    def new(\n-def old("): ["Diff: x.py", "Changes: +new -old"],
    ("rg", "a.py:3:hit\nb.py:4:hit"): ["Search found: a.py, b.py"],
    ("other", "hello"): ["other: hello"],
}


def test_tool_families(spark):
    rows = [(str(i), "tool_call", tool, text) for i, (tool, text) in enumerate(TOOLS)]
    df = tools.parse_tool_output(spark.createDataFrame(rows, "event_id string, event_type string, tool_name string, content string"))
    got = {}
    for r in df.orderBy("ordinal").collect():
        got.setdefault(int(r.event_id), []).append(r.summary)
    assert got == dict(enumerate(TOOLS.values()))


FILES = {
    "a.py": "class A:\n    def m(self):\n        go()\n", "a.js": "function run() {\n}\nconst f = (x) => x\n", "a.ts": "interface I {}\n", "a.rs": "struct S;\nfn main() {}\n", "a.go": "func Go() {}\ntype T struct {}\n", "A.java": "public class J {\n}\n", "a.cpp": "class C {\n",
}


def test_code_index(spark):
    df = spark.createDataFrame(list(FILES.items()), "file_path string, content string")
    got = {(r.symbol_type, r.name) for r in code.index_code_regex(df).collect()}
    assert {("class", "A"), ("method", "m"), ("function", "run"), ("arrow_function", "f"), ("interface", "I"), ("struct", "S"), ("function", "main"), ("function", "Go"), ("struct", "T"), ("class", "J"), ("class", "C")} <= got
    tree = code.index_code_python(df.where("file_path = 'a.py'")).collect()
    assert [(r.name, r.symbol_type, r.line_start, r.line_end, r.calls) for r in tree] == [("A", "class", 1, 3, ["go"]), ("A.m", "method", 2, 3, ["go"])]
    assert code.index_code_python(spark.createDataFrame([("x.py", "def (")], "file_path string, content string")).count() == 0


def test_packs_keep_budget_and_add_up(spark):
    memories = spark.createDataFrame(
        [(f"m{i}", kind, v, f"{kind} text number {i} about src/x{i}.py", f"{kind} text {i}", None, 0.1 * (i % 9), 1.0) for i, (kind, v) in enumerate([("decision", "active"), ("error", "active"), ("decision", "superseded"), ("code_change", "active"), ("goal", "active"), ("intent", "active"), ("task", "active")] * 2)],
        "memory_id string, memory_type string, validity string, raw_text string, compressed_summary string, semantic_summary string, importance_score double, recency_score double",
    )
    requests = spark.createDataFrame([("r", "p", "fix error in parser", "debugging", 2000, 65)], "request_id string, project_id string, query string, task string, token_budget int, max_pack_tokens int")
    found = memories.select(F.lit("r").alias("request_id"), "memory_id", F.substring("memory_id", 2, 3).cast("int").alias("rank"))
    pack = packs.build_packs(requests, found, memories).first()
    assert pack.tokens == sum(s.tokens for s in pack.sections) and pack.sections[0].name == "system_task"
    ids = [m for s in pack.sections for m in s.memory_ids]
    assert len(ids) == len(set(ids)) and not {"m2", "m9"} & set(next(s for s in pack.sections if s.name == "decisions").memory_ids)
    compact = packs.build_packs(requests, found, memories, compact=True).first()
    assert [s.name for s in compact.sections] == ["system_task", "state", "context", "code"]


def test_readers(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"event_type": "user_message", "timestamp": "2024-01-01T00:00:00Z", "raw_text": "hi"}\n\n{"event_type": "error", "timestamp": "2024-01-01T00:01:00Z", "raw_text": "bad", "tool_name": "t"}\n')
    assert [(r.event_id, r.payload) for r in readers.read_session_logs(spark, str(log), "p", "s").orderBy("event_id").collect()] == [("evt_s_000", {"content": "hi"}), ("evt_s_001", {"content": "bad", "tool_name": "t"})]
    for path, data in (("a.py", b"x = 1"), ("node_modules/b.js", b"y"), ("c.txt", b"z"), ("sub/d.rs", b"\xff\xfe")):
        (tmp_path / "src" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / path).write_bytes(data)
    assert [re.sub(".*/", "", r.file_path) for r in readers.read_source_files(spark, str(tmp_path / "src")).collect()] == ["a.py"]


def test_decay_fates(spark):
    rows = [("a", "active", False, 0.9, 1), ("b", "active", False, 0.1, 20), ("c", "superseded", False, 0.9, 31), ("d", "superseded", False, 0.9, 5), ("e", "active", True, 0.1, 99)]
    df = spark.createDataFrame(rows, "memory_id string, validity string, never_delete boolean, importance_score double, age int").withColumns({"project_id": F.lit("p"), "memory_type": F.lit("fact"), "timestamp": F.to_timestamp(F.lit(AS_OF)) - F.make_dt_interval(days="age")})
    assert {r.memory_id: r.fate for r in lifecycle.decay(df, AS_OF).collect()} == {"a": "unchanged", "b": "archived", "c": "archived", "d": None, "e": "pinned"}


# --- packs against a plain reading of their rules ---------------------------


def plain_pack(request, rows, budgets, required=(), compact=False):
    """One pack by hand: ``rows`` are dicts in rank order, ``budgets`` tokens by section."""
    task, limit = request["task"], request["max_pack_tokens"]
    size = lambda text: max(1, len(text) // 4) if text else 0
    live = [r for r in rows if r["validity"] not in packs.INACTIVE]
    room = int((limit - 150) / 100) if limit > 150 else 0
    wide = min(5.0, max(1.0, limit / 100))
    plan = [(n, t, budgets[n], items, n != "code_context" or task == "debugging" or any(w in request["query"] for w in packs.BROKEN)) for n, t, items in packs.FIRST.get(task, packs.FIRST[""])]
    plan += [(n, t, min(b, budgets["requirements"]) if n == "requirements" else b, 1, False) for n, t, b in packs.FILLERS]
    if compact:
        plan = [(n, t, b, 3, True) for n, t, b in packs.COMPACT]
    asked = f"p={request['project_id']} q={request['query'][:20]}"
    sections, ids, seen = [["system_task", asked, [], size(asked)]], set(), set()
    for name, types, budget, items, always in plan:
        own = [r for t in types for r in live if r["memory_type"] == t]
        if not own and not always:
            continue
        if types[0] in packs.RANKED_TYPES:
            own = sorted(own, key=lambda r: -(0.6 * r["importance_score"] + 0.4 * r["recency_score"]))
        kept, used = [], 0
        for r in own:
            key = " ".join(r["raw_text"].lower().split())[:120]
            if r["memory_id"] in ids or key in seen:
                continue
            seen.add(key)
            body = r["body"][: 80 if compact else int((100 if r["keywords"] else 72) * wide)]
            if used + size(body) > budget:
                break
            used += size(body)
            kept.append((r["memory_id"], body))
            ids.add(r["memory_id"])
            if len(kept) == items + room:
                break
        sections.append([name, "\n".join(b for _, b in kept), [i for i, _ in kept], used])
    said = " ".join(s[1].lower() for s in sections)
    unused = [r for r in rows if r["memory_id"] not in ids]
    terms = set() if compact else {k.lower() for r in unused for k in r["keywords"]} | {t.lower() for t in required}
    saved, used = [], 0
    for term in sorted(t for t in terms if t not in said):
        holders = sorted((r for r in unused if term in [k.lower() for k in r["keywords"]]), key=lambda r: -r["importance_score"]) or [r for r in unused if term in r["raw_text"].lower()][:1]
        if not holders or holders[0]["memory_id"] in [i for i, _ in saved]:
            continue
        if used + size(holders[0]["body"]) > packs.RESCUE:
            break
        used += size(holders[0]["body"])
        saved.append((holders[0]["memory_id"], holders[0]["body"]))
    if saved:
        sections.append(["protected_evidence", "\n".join(b for _, b in saved), [i for i, _ in saved], used])
    while sum(s[3] for s in sections) > min(limit, request["token_budget"]) and len(sections) > 3:
        spare = [s for s in sections if s[0] in packs.TRIMMED]
        if not spare:
            break
        sections.remove(spare[-1])
    return [tuple(s[:2]) + (tuple(s[2]), s[3]) for s in sections]


def test_packs_match_a_plain_reading(spark):
    import random

    rng = random.Random(4)
    kinds = ("decision", "error", "code_change", "goal", "requirement", "intent", "reflection", "task", "uncertainty")
    words = ("parser", "CACHE_TTL", "src/a.py", "engine", "v1.2.3", "ERR_LIMIT", "store", "run()")
    tasks = ("debugging", "architecture", "feature", "research")
    memories, found, requests = [], [], []
    for q in range(40):
        limit = rng.choice((40, 65, 200, 500))
        requests.append((f"r{q}", "p", rng.choice(("fix the parser", "what is broken", "design it")), rng.choice(tasks), rng.choice((300, 2000)), limit, rng.sample(("field3", "CACHE_TTL", "engine"), 2)))
        for rank in range(rng.randint(0, 25)):
            text = " ".join(rng.choices(words, k=rng.randint(1, 14))) + (f" field{rng.randint(1, 3)}" if rng.random() < 0.2 else "")
            memories.append((f"m{q}_{rank}", rng.choice(kinds), rng.choice(("active", "active", "active", "stale", "superseded")), text, text, None, rng.randint(0, 9) / 10, rng.randint(0, 9) / 10))
            found.append((f"r{q}", f"m{q}_{rank}", rank + 1))
    rows = spark.createDataFrame(memories, "memory_id string, memory_type string, validity string, raw_text string, compressed_summary string, semantic_summary string, importance_score double, recency_score double")
    asked = spark.createDataFrame(requests, "request_id string, project_id string, query string, task string, token_budget int, max_pack_tokens int, required_terms array<string>")
    got = {r.request_id: [(s.name, s.content, tuple(s.memory_ids), s.tokens) for s in r.sections] for r in packs.build_packs(asked, spark.createDataFrame(found, "request_id string, memory_id string, rank int"), rows).collect()}
    keys = {r.memory_id: list(r.k) for r in rows.select("memory_id", T.protected_keywords(F.col("raw_text")).alias("k")).collect()}
    budgets = {r.request_id: r.asDict() for r in retrieve.token_budget(asked).collect()}
    held = {m[0]: dict(zip(rows.columns, m, strict=True)) | {"body": m[3], "keywords": keys[m[0]]} for m in memories}
    for q in requests:
        request = dict(zip(asked.columns, q, strict=True))
        own = [held[m] for r, m, _ in found if r == q[0]]
        assert got[q[0]] == plain_pack(request, own, budgets[q[0]], q[6]), q
    assert any(s[0] == "protected_evidence" for p in got.values() for s in p)
    compact = packs.build_packs(asked, spark.createDataFrame(found, "request_id string, memory_id string, rank int"), rows, compact=True).collect()
    assert len(compact) == 40 and all(sum(s.tokens for s in r.sections) == r.tokens for r in compact)
    for r in compact:
        q = next(q for q in requests if q[0] == r.request_id)
        request = dict(zip(asked.columns, q, strict=True))
        want = plain_pack(request, [held[m] for a, m, _ in found if a == q[0]], budgets[q[0]], q[6], compact=True)
        assert [(s.name, s.content, tuple(s.memory_ids), s.tokens) for s in r.sections] == want, q
    # Packs of the nearest memories alone: the same reading over a ranking by cosine.
    vector = {m[0]: [float((7 * i) % 11 - 5), float((3 * i) % 13 - 6), 1.0] for i, m in enumerate(memories)}
    near = rows.select("memory_id").rdd.map(lambda r: (r.memory_id, "p", vector[r.memory_id])).toDF("memory_id string, project_id string, vector array<double>")
    ask = [0.5, -1.0, 0.25]
    norm = lambda v: sum(x * x for x in v) ** 0.5
    cosine = {m: round(sum(x * y for x, y in zip(v, ask)) / (norm(v) * norm(ask) + 1e-10), 9) for m, v in vector.items()}
    order = sorted(cosine, key=lambda m: (-cosine[m], m))[:20]
    rag = packs.rag_packs(asked.withColumn("vector", F.array(*map(F.lit, ask))), rows.withColumn("project_id", F.lit("p")), near).collect()
    for r in rag:
        q = next(q for q in requests if q[0] == r.request_id)
        want = plain_pack(dict(zip(asked.columns, q, strict=True)), [held[m] for m in order], budgets[q[0]], q[6])
        assert [(s.name, s.content, tuple(s.memory_ids), s.tokens) for s in r.sections] == want, q


def test_expansion_lets_new_candidates_in(spark):
    """The first query finds nothing of the missing type and word; the rewritten one does."""
    rows = [(f"mem_a{i}", "p", "s", "task", "active", "user_message", f"alpha note {i} of the long project text about things", 0.1) for i in range(60)]
    rows += [("mem_b", "p", "s", "requirement", "archived", "user_message", "old", 0.9), ("mem_c", "p", "s", "goal", "active", "tool_output", "recent work on things", 0.9)]
    memories = spark.createDataFrame(rows, "memory_id string, project_id string, session_id string, memory_type string, validity string, source_type string, raw_text string, importance_score double")
    memories = memories.withColumns({"compressed_summary": F.col("raw_text"), "semantic_summary": F.lit(None).cast("string"), "timestamp": F.to_timestamp(F.lit("2024-01-01")), "recency_score": F.lit(1.0), "confidence_score": F.lit(0.5), "stability": F.lit("ephemeral"), "file_references": F.array().cast("array<string>")})
    requests = spark.createDataFrame([("r1", "p", "alpha deploy gamma"), ("r2", "none", "alpha")], "request_id string, project_id string, query string").withColumn("requirements", F.expr("CAST(map() AS map<string, boolean>)"))
    out = session_ops.auto_expand(requests, memories).collect()
    assert sorted(r.request_id for r in out) == ["r1", "r2"]
    asked = next(s.content for r in out if r.request_id == "r1" for s in r.sections if s.name == "system_task")
    assert asked.startswith("p=p q=alpha deploy gamma")
    first = {r.memory_id for r in retrieve.retrieve(requests.where("request_id = 'r1'"), memories).collect()}
    assert len(first) == 50 and "mem_c" not in first
    held = {m for r in out if r.request_id == "r1" for s in r.sections for m in s.memory_ids}
    assert "mem_c" in held  # only the rewritten query asks for recent rows


def test_budget_curve_by_hand(spark):
    """One request: a small pack holds one expected text of two, a large one both; a revived decision fails the verification of both."""
    texts = [("mem_1", "decision", "active", "use the red engine for the store"), ("mem_2", "error", "active", "parser crashed on empty lines"), ("mem_3", "decision", "rejected", "use the blue engine always now")]
    memories = spark.createDataFrame([(*t[:3], t[3], t[3]) for t in texts], "memory_id string, memory_type string, validity string, raw_text string, compressed_summary string")
    memories = memories.withColumns({"project_id": F.lit("p"), "session_id": F.lit("s"), "source_type": F.lit("user_message"), "semantic_summary": F.lit(None).cast("string"), "timestamp": F.to_timestamp(F.lit("2024-01-01")), "importance_score": F.lit(0.5), "recency_score": F.lit(1.0), "confidence_score": F.lit(0.5), "stability": F.lit("ephemeral"), "file_references": F.array().cast("array<string>")})
    requests = spark.createDataFrame([("r1", "p", "what engine", ["RED engine", "parser"]), ("r2", "none", "what engine", ["x"]), ("r3", "p", "what engine", None)], "request_id string, project_id string, query string, expected array<string>").withColumn("requirements", F.expr("CAST(map() AS map<string, boolean>)"))
    got = {r.budget: r for r in session_ops.budget_curve(requests, memories, [70, 400]).collect()}
    for budget in (70, 400):
        plans = retrieve.make_plan(requests).withColumns({"token_budget": F.lit(8192), "max_pack_tokens": F.lit(budget)})
        text = {r.request_id: " ".join(s.content.lower() for s in r.sections) for r in packs.build_packs(plans, retrieve.retrieve(requests, memories), memories).collect()}
        recall = [sum(t in text["r1"] for t in ("red engine", "parser")) / 2, 0.0, 1.0]
        assert got[budget].n == 3 and abs(got[budget].recall - sum(recall) / 3) < 1e-9 and got[budget].passed == 1.0 and abs(got[budget].score - sum(recall) / 3) < 1e-9
    # A decision told next to a denial of it: each answer that holds both fails, and costs a tenth.
    denied = memories.withColumn("validity", F.lit("active")).withColumn("raw_text", F.when(F.col("memory_id") == "mem_3", "do not use it").otherwise(F.col("raw_text"))).withColumn("compressed_summary", F.col("raw_text"))
    low = session_ops.budget_curve(requests.where("request_id = 'r3'"), denied, [400]).first()
    assert (low.recall, low.passed, low.score, low.n) == (1.0, 0.0, 0.9, 1)


def test_entities_are_known_symbols(spark):
    retrieved = spark.createDataFrame([("a", "p", "fact", "active", "user_message", None, "plain", "plain", [], ["OrderBook"])], "response_id string, project_id string, memory_type string, validity string, source_type string, statement string, compressed_summary string, raw_text string, file_references array<string>, entities array<string>")
    said = spark.createDataFrame([("a", "p", "OrderBook and TradeLedger differ")], "response_id string, project_id string, text string")
    assert verify.verify_responses(said, retrieved).first().n_warnings == 1 and verify.verify_responses(said, retrieved.drop("entities")).first().n_warnings == 2


def test_restored_sessions_hold_their_own_rows(spark):
    rows = [(f"mem_{s}{i}", "p", s, ("decision", "error", "intent")[i % 3], "active", f"{s} text {i}", 0.5) for s in ("s1", "s2") for i in range(6)]
    memories = spark.createDataFrame(rows, "memory_id string, project_id string, session_id string, memory_type string, validity string, raw_text string, importance_score double")
    memories = memories.withColumns({"compressed_summary": F.col("raw_text"), "semantic_summary": F.lit(None).cast("string"), "timestamp": F.to_timestamp(F.lit("2024-01-01")), "recency_score": F.lit(1.0), "confidence_score": F.lit(0.5), "stability": F.lit("ephemeral"), "file_references": F.array().cast("array<string>")})
    got = session_ops.restore_sessions(spark.createDataFrame([("s1", "p"), ("s3", "none")], "session_id string, project_id string"), memories).collect()
    assert sorted(r.request_id for r in got) == ["s1", "s3"]
    pack = next(r for r in got if r.request_id == "s1")
    assert pack.sections[0].content == "p=p q=resume work" and any(s.memory_ids for s in pack.sections)
    trace = packs.pack_trace(memories.select(F.lit("s1").alias("request_id"), "memory_id", "validity"), spark.createDataFrame([pack], "request_id string, project_id string, sections " + packs.SECTION + ", tokens int, sufficiency double, warnings array<string>"))
    held = {m for s in pack.sections for m in s.memory_ids}
    assert {r.memory_id for r in trace.collect() if not r.fate.startswith("dropped")} == held and trace.count() == len(rows)


def test_semantic_text_keeps_its_terms(spark):
    error = [("kind", "limit of MAX_ROWS reached in loader", None, None, None, 0, [])]
    rows = spark.createDataFrame([("error", "see src/load.py", None, None, [], [], error, []), ("fact", "plain words", "short", "said so", [], [], [], [])], f"memory_type string, raw_text string, compressed_summary string, semantic_summary string, decisions {extract.DECISION}, file_references array<string>, errors_found {extract.ERROR}, open_questions array<string>")
    assert [r[0] for r in rows.select(extract.compress(3)).collect()] == ["limit of MAX_ROWS reached in loader. Terms: src/load.py", "said so"]


def test_stream_state_goes_on_after_a_restart(spark, tmp_path):
    def run(*names):
        for name, branch in names:
            row = [(name, "p", "code_change", f"Deploy to staging, branch: {branch}", None, "2024-01-01", 1.0, 0.5, [f"src/{name}.py"])]
            df = spark.createDataFrame(row, "memory_id string, project_id string, memory_type string, raw_text string, compressed_summary string, at string, recency_score double, importance_score double, file_references array<string>")
            df.withColumn("timestamp", F.to_timestamp("at")).drop("at").write.mode("append").parquet(f"{tmp_path}/in")
        schema = spark.read.parquet(f"{tmp_path}/in").schema
        return jobs.run_to_state(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out").collect()

    assert [(r.version, r.active_files) for r in run(("a", "one"))] == [(1, ["src/a.py"])]
    assert [(r.version, sorted(r.active_files)) for r in run(("b", "two"))] == [(2, ["src/a.py", "src/b.py"])]


def test_calls_reach_into_other_files(spark):
    files = [("p/a.py", "import os\n\n@cache\ndef run(x: int):\n    return helper(x)\n"), ("p/b.py", "class H:\n    @staticmethod\n    def helper(y):\n        return os.path.join(y)\n"), ("q/c.py", "def helper(z):\n    pass\n")]
    tree = code.index_code_python(spark.createDataFrame(files, "file_path string, content string"))
    assert {(r.name, r.signature, tuple(r.decorators), tuple(r.calls)) for r in tree.where("symbol_type <> 'import'").collect()} == {("run", "def run(x: int)", ("cache",), ("helper",)), ("H", None, (), ("join",)), ("H.helper", "def helper(y)", ("staticmethod",), ("join",)), ("helper", "def helper(z)", (), ())}
    root = F.regexp_extract("file_path", "^([^/]+)/", 1)
    assert values(code.call_edges(tree, root)) == [("p/a.py", "run", "p/b.py", "H.helper")] and code.call_edges(tree).count() == 2


def test_neighbours_of_equal_similarity_are_those_of_lesser_ids(spark):
    vectors = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(20)] + [(50, [0.0, 1.0]), (51, None)], "memory_id bigint, vector array<double>")
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0])], "request_id bigint, vector array<double>")
    assert sorted(values(retrieve.vector_search(vectors.repartition(3), queries, 4).select("request_id", "memory_id"))) == [(1, i) for i in range(4)]


def test_keyed_state_writes_what_a_batch_touched_and_survives_replays(spark, tmp_path):
    store = jobs.KeyedState(spark, f"{tmp_path}/s", "key", buckets=8)
    rows = lambda pairs: spark.createDataFrame(pairs, "key string, v long")
    read = lambda before=None: dict(values(store.load(before)))
    assert store.load() is None
    store.save(rows([(f"k{i}", 0) for i in range(2000)]), 0)
    store.save(rows([("k1", 1), ("new", 5)]), 1)
    size = [store.bytes_of(p) for _, _, p in store.tables()]
    assert size[1] < size[0] / 5 and read()["k1"] == 1 and len(read()) == 2001 and read(1)["k1"] == 0
    store.save(rows([("k1", 7)]), 1)  # replayed with other rows: what it stored before is gone
    assert read()["k1"] == 7 and "new" not in read()
    assert dict(values(store.load(None, rows([("k1", 0), ("k5", 0), ("none", 0)])))) == {"k1": 7, "k5": 0}
    for batch in range(2, 5):
        store.save(rows([(f"k{i}", batch) for i in range(1500)]), batch)
    kinds = [(b, kind) for b, kind, _ in store.tables()]
    assert kinds[0][1] == "full" and len(kinds) <= 3, kinds
    assert read() == {f"k{i}": 4 if i < 1500 else 0 for i in range(2000)}
    assert read(4) == {f"k{i}": 3 if i < 1500 else 0 for i in range(2000)}  # a replay of the last batch still finds what lay before it


def test_panes_take_late_rows_and_go_on_after_a_restart(spark, tmp_path):
    def run(name, *times):
        frame = spark.createDataFrame([("p", t) for t in times], "project_id string, at string").select("project_id", F.to_timestamp("at").alias("timestamp"))
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        panes = jobs.run_to_panes(spark.readStream.schema("project_id string, timestamp timestamp").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", "2 hours")
        return {str(r.hour)[5:16]: tuple(r[2:]) for r in jobs.rolling_activity(panes).collect()}

    assert run("a", "2024-01-01 10:05:00", "2024-01-01 10:59:59", "2024-01-01 11:00:00") == {"01-01 10:00": (2, 2, 2, 2), "01-01 11:00": (1, 3, 3, 3)}
    assert run("b", "2024-01-02 10:30:00", "2024-01-01 10:10:00") == {"01-01 10:00": (3, 3, 3, 3), "01-01 11:00": (1, 4, 4, 4), "01-02 10:00": (1, 2, 5, 5)}
    got = run("c", "2024-01-01 10:20:00", "2024-01-20 00:00:00", "2024-01-02 08:45:00")  # the first is over two hours behind: its hour is closed
    assert got == {"01-01 10:00": (3, 3, 3, 3), "01-01 11:00": (1, 4, 4, 4), "01-02 08:00": (1, 5, 5, 5), "01-02 10:00": (1, 3, 6, 6), "01-20 00:00": (1, 1, 1, 7)}
