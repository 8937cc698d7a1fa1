"""Events to typed memory rows: narrow expressions, one explode, then one shuffle to drop duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memjobs.functions import text as T
from memjobs.functions.sessions import extract_errors, extract_goals
from memjobs.operators.health import normalised
from memjobs.operators.ledger import any_contains

DECISION = "array<struct<statement:string,rationale:string,status:string,alternatives:array<string>,tradeoffs:string>>"
ERROR = "array<struct<kind:string,message:string,root_cause:string,fix_attempt:string,verified_fix:string,recurrence_risk:int,affected_files:array<string>>>"

# Trigger words, held against lower-case text, and file names.
DECIDES_START, DECIDES = ("decision:", "use "), (": decision", ": use ", " decide to ", " will use ", " going with ", " choose ", " decided to ")
FAILS = ("error:", "error ", "bug:", "bug ", "failed", "failure", "exception", "crash", "injection", "leak", "degraded")
REQUIRES = ("must ", "should ", "need to", "requirement", "constraint")
AIMS_START, AIMS = ("goal:", "our goal", "the goal", "objective:", "aim:"), (" our goal is ", " the goal is ", " objective is ", " need to ", " we need to ", " we must ", " target is ")
TASKS_START, TASKS = ("task:",), (": task", " todo ", " implement ", " create ", " add ")
PROPOSES = ("propose", "suggest", "recommend", "should use", "decision:")
REPAIRS = ("fix attempt", "verified fix", "root cause", "recurrence risk", "error:", "bug:")
FILES = r"[\w\-/]+\.(?:py|ts|js|tsx|jsx|rs|go|java|cpp|c|h|yaml|yml|json|toml|md)"
TESTERS = ("test", "pytest", "jest", "mocha")
TOOL_FAILS = ("error", "fail", "traceback")


def _starts(low: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | low.startswith(w)
    return out


def _without(text: Column, prefixes) -> Column:
    """The text without the first prefix that fits, trimmed."""
    out = text
    for p in reversed(prefixes):
        out = F.when(F.lower(text).startswith(p), F.trim(F.substring(text, len(p) + 1, 1 << 30))).otherwise(out)
    return out


def _row(kind: str, source: str | Column, summary: Column | None = None, semantic: Column | None = None, validity: str = "active", decisions: Column | None = None, errors: Column | None = None, files: Column | None = None, questions: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(kind).alias("memory_type"), (F.lit(source) if isinstance(source, str) else source).alias("source_type"),
        (none if summary is None else summary).cast("string").alias("compressed_summary"), (none if semantic is None else semantic).cast("string").alias("semantic_summary"),
        F.lit(validity).alias("validity"), (F.array() if decisions is None else decisions).cast(DECISION).alias("decisions"), (F.array() if errors is None else errors).cast(ERROR).alias("errors_found"),
        (F.array() if files is None else files).cast("array<string>").alias("file_references"), (F.array() if questions is None else questions).cast("array<string>").alias("open_questions"),
    )


def _prefixed(prefix: str, text: Column, n: int) -> Column:
    return F.concat(F.lit(prefix), F.substring(text, 1, n))


def _decision(statement: Column, status: str) -> Column:
    entry = F.struct(F.substring(statement, 1, 400).alias("statement"), F.col("_rationale").alias("rationale"), F.lit(status).alias("status"), F.col("_alternatives").alias("alternatives"), F.col("_tradeoffs").alias("tradeoffs"))
    return F.array(entry)


def _error(kind: str | Column, message: Column, told: bool = False, full: bool = True) -> Column:
    """``told``: with what the text tells of cause, fix and files; ``full``: of verification and risk too."""
    none = F.lit(None).cast("string")
    parts = [F.lit(kind) if isinstance(kind, str) else kind, message]
    parts += [F.col("_root_cause"), F.col("_fix_attempt")] if told else [none, none]
    parts += [F.col("_verified_fix"), F.col("_risk")] if told and full else [none, F.lit(0)]
    parts.append(F.col("_files") if told else F.array().cast("array<string>"))
    names = ("kind", "message", "root_cause", "fix_attempt", "verified_fix", "recurrence_risk", "affected_files")
    return F.array(F.struct(*[p.alias(n) for p, n in zip(parts, names, strict=True)]))


def candidates(events: DataFrame) -> DataFrame:
    """Events with ``rows``: the array of memory rows each gives, in rule order.

    What several rules read (fields, file names, goals, errors) is computed once an event, in columns of its own.
    """
    x = events.withColumn("raw_text", F.coalesce("raw_text", F.lit("")))
    t = F.col("raw_text")
    user = F.col("event_type") == "user_message"
    none = F.array().cast("array<string>")
    x = x.withColumn("_errors", F.coalesce(extract_errors(F.when(user, t)), none)).withColumn("_goals", F.coalesce(extract_goals(F.when(user, t)), none))
    found = F.array_sort(F.array_distinct(T.all_matches(t, FILES)))
    shared = {"_low": F.lower(t), "_refs": F.when(t.contains("."), found).otherwise(none), "_alternatives": T.alternatives(t), "_risk": T.recurrence_risk(t), "_files": T.file_refs(t)}
    x = x.withColumns(shared | {f"_{n}": T.field(t, n) for n in T.FIELDS})
    low, refs = F.col("_low"), F.col("_refs")
    head = F.substring(t, 1, 500)
    first = F.array(_row("event", F.when(F.col("event_type") == "tool_call", "tool_output").otherwise("user_message"), F.when(t != "", head), F.when(t != "", head)))

    stated = _without(t, ("decision:",))
    message = _without(t, ("error:",))
    aim = _without(t, AIMS_START)
    no_error = F.size("_errors") == 0
    of_user = F.concat(
        F.array(_row("intent", "user_message", _prefixed("User intent: ", t, 300), F.substring(t, 1, 400), files=refs)),
        F.array_compact(F.array(F.when(_starts(low, DECIDES_START) | any_contains(low, DECIDES), _row("decision", "user_message", _prefixed("Decision: ", stated, 300), decisions=_decision(stated, "active"), files=refs)))),
        F.transform("_errors", lambda e: _row("error", "user_message", _prefixed("Error: ", e, 300), errors=_error("session_error", F.substring(e, 1, 400), True), files=refs)),
        F.array_compact(F.array(F.when(no_error & any_contains(low, FAILS), _row("error", "user_message", _prefixed("Error: ", message, 300), errors=_error("runtime_error", F.substring(message, 1, 400), True, False), files=refs)))),
        F.transform("_goals", lambda g: _row("goal", "user_message", _prefixed("Goal: ", g, 300), files=refs)),
        F.array_compact(F.array(
            F.when(any_contains(low, REQUIRES), _row("requirement", "user_message", _prefixed("Requirement: ", t, 300), files=refs)),
            F.when(_starts(low, AIMS_START) | any_contains(low, AIMS), _row("goal", "user_message", _prefixed("Goal: ", aim, 60), files=refs)),
            F.when(_starts(low, TASKS_START) | any_contains(low, TASKS), _row("task", "user_message", _prefixed("Task: ", t, 300), files=refs, questions=F.array(F.substring(t, 1, 300)))),
        )),
    )

    questions = F.slice(T.all_matches(t, r"\?[^.!?]*"), 1, 5)
    repaired = (F.col("_root_cause") != "") | (F.col("_fix_attempt") != "") | (F.col("_verified_fix") != "") | (F.col("_risk") > 0)
    of_assistant = F.array_compact(F.array(
        _row("task", "assistant_message", _prefixed("Assistant plan: ", t, 300), F.substring(t, 1, 400), "proposed"),
        F.when(any_contains(low, PROPOSES), _row("decision", "assistant_message", _prefixed("Proposed decision: ", stated, 300), validity="proposed", decisions=_decision(stated, "proposed"))),
        F.when(any_contains(low, REPAIRS) & repaired, _row("error", "assistant_message", _prefixed("Error fix: ", t, 300), errors=_error("session_error", F.substring(t, 1, 400), True))),
        F.when(F.size(questions) > 0, _row("uncertainty", "assistant_message", questions=questions)),
    ))

    tool = F.coalesce(F.col("tool_name"), F.lit("unknown"))
    of_tool = F.array_compact(F.array(
        F.when(any_contains(F.lower(tool), TESTERS), _row("fact", "test_result", F.concat(F.lit("Test result ("), tool, F.lit("): "), F.substring(t, 1, 300)))),
        F.when(any_contains(low, TOOL_FAILS), _row("error", "tool_output", _prefixed("Error: ", t, 300), errors=_error("tool_error", head))),
    ))
    path = F.coalesce(F.col("file_path"), F.lit("unknown"))
    of_change = F.array(_row("code_change", "code_diff", F.substring(t, 1, 120), files=F.array(path)))
    kind = F.coalesce(F.col("error_kind"), F.lit("runtime_error"))
    of_error = F.array(_row("error", "runtime_error", F.concat(F.lit("Error ("), kind, F.lit("): "), F.substring(t, 1, 300)), errors=_error(kind, head)))
    branch = F.when(user, of_user)
    for name, rows in (("assistant_response", of_assistant), ("tool_call", of_tool), ("code_change", of_change), ("error", of_error)):
        branch = branch.when(F.col("event_type") == name, rows)
    nothing = F.filter(first, lambda r: F.lit(False))
    return x.withColumn("rows", F.concat(first, F.coalesce(branch, nothing))).drop("_errors", "_goals", *shared, *(f"_{n}" for n in T.FIELDS))


def extract_memories(events: DataFrame, keep_all: bool = False, told: dict[str, Column] | None = None) -> DataFrame:
    """One memory row for each rule that fires; of one event's rows of a type the first stays, unless ``keep_all``.

    ``told``: columns of the event's own text that its rows get in place of or besides their others, worked out once an event.
    """
    numbered = candidates(events).withColumn("rows", F.transform("rows", lambda r, i: F.struct(i.alias("ordinal"), r.alias("r"))))
    if not keep_all:
        # The rows of an event lie in one array, so the first of a type is found without a shuffle.
        numbered = numbered.withColumn("_kinds", F.transform("rows", lambda x: x["r"]["memory_type"]))
        numbered = numbered.withColumn("rows", F.filter("rows", lambda x: F.array_position("_kinds", x["r"]["memory_type"]) == x["ordinal"] + 1))
    # Every event has a row; the outer form keeps the optimizer from copying the whole expression into a filter on its size.
    of_event = list(dict.fromkeys(["event_id", "project_id", "session_id", "timestamp", "raw_text", *(told or {})]))
    found = numbered.withColumns(told or {}).select(*of_event, F.inline_outer("rows"))
    flat = found.select(*of_event, "ordinal", "r.*")
    key = F.sha2(F.concat_ws("|", "event_id", "memory_type", F.col("ordinal").cast("string")), 256)
    return flat.withColumn("memory_id", F.concat(F.lit("mem_"), F.substring(key, 1, 16)))


def redact_memories(memories: DataFrame, columns: tuple[str, ...] = ("raw_text", "compressed_summary", "semantic_summary")) -> DataFrame:
    return memories.withColumns({c: T.redact_secrets(F.col(c)) for c in columns})


def score_memories(memories: DataFrame) -> DataFrame:
    """Importance by type, source, files and decisions; confidence by source; recency 1."""
    importance = 0.5 + F.when(F.col("memory_type") == "decision", 0.3).when(F.col("memory_type") == "error", 0.25).otherwise(0.0)
    importance = importance + F.when(F.col("source_type") == "user_message", 0.1).otherwise(0.0) + F.when(F.size("file_references") > 0, 0.05).otherwise(0.0) + F.when(F.size("decisions") > 0, 0.1).otherwise(0.0)
    confidence = F.when(F.col("source_type") == "user_message", 0.9).when(F.col("source_type") == "tool_output", 0.85).otherwise(0.5)
    return memories.withColumns({"importance_score": F.least(F.lit(1.0), importance), "confidence_score": confidence, "recency_score": F.lit(1.0)})


def dedupe_memories(memories: DataFrame) -> DataFrame:
    """The first row of each project, session, type and normalised text; keyed by a hash, so evenly dealt."""
    keyed = memories if "content_hash" in memories.columns else memories.withColumn("content_hash", F.sha2(normalised(F.col("raw_text")), 256))
    first = Window.partitionBy("content_hash", "project_id", "session_id", "memory_type").orderBy("timestamp", "event_id", "ordinal")
    return keyed.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def write_memories(events: DataFrame) -> DataFrame:
    """The write path: extract, redact, score, drop duplicates.  The raw text, which all rows of an event share, is redacted and hashed once."""
    clean = events.withColumn("_clean", T.redact_secrets(F.coalesce("raw_text", F.lit("")))).withColumn("_hash", F.sha2(normalised(F.col("_clean")), 256))
    rows = extract_memories(clean, told={"raw_text": F.col("_clean"), "content_hash": F.col("_hash")})
    return dedupe_memories(score_memories(redact_memories(rows, ("compressed_summary", "semantic_summary"))))


def compress(level: int = 2) -> Column:
    """A text for a memory row: 0 raw, 1 the first 400 characters, 2 structured, 3 and more semantic with its protected terms."""
    raw, summary = F.coalesce("raw_text", F.lit("")), F.col("compressed_summary")
    if level <= 0:
        return raw
    if level == 1:
        return F.substring(F.when(raw != "", raw).otherwise(F.coalesce(summary, F.lit(""))), 1, 400)
    if level == 2:
        said = F.flatten(F.transform("decisions", lambda d: F.array_compact(F.array(F.concat(F.lit("Decision: "), d["statement"]), F.when(d["rationale"] != "", F.concat(F.lit("Why: "), d["rationale"]))))))
        failed = F.transform("errors_found", lambda e: F.concat(F.lit("Error ("), e["kind"], F.lit("): "), F.substring(e["message"], 1, 120)))
        rest = F.array_compact(F.array(
            F.when(F.size("file_references") > 0, F.concat(F.lit("Files: "), F.array_join("file_references", ", "))),
            F.when(F.size("open_questions") > 0, F.concat(F.lit("Open: "), F.array_join(F.slice("open_questions", 1, 3), "; "))),
            F.when(summary != "", F.concat(F.lit("Summary: "), F.substring(summary, 1, 150))),
        ))
        return F.array_join(F.concat(F.array(F.concat(F.lit("["), F.upper("memory_type"), F.lit("]"))), said, failed, rest), " ")
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    body = (
        F.when(some(F.col("semantic_summary")), F.col("semantic_summary"))
        .when(some(summary) & (F.col("memory_type") == "code_change"), F.substring(summary, 1, 150))
        .when(F.size("decisions") > 0, F.array_join(F.transform(F.slice("decisions", 1, 2), lambda d: d["statement"]), " "))
        .when(F.size("errors_found") > 0, F.array_join(F.transform(F.slice("errors_found", 1, 2), lambda e: F.substring(e["message"], 1, 80)), " "))
        .when(F.size("file_references") > 0, F.concat(F.lit("Files: "), F.array_join(F.slice("file_references", 1, 3), ", ")))
        .when(some(summary), F.substring(summary, 1, 150)).otherwise(F.substring(raw, 1, 120))
    )
    sources = F.concat_ws("\n", raw, summary, "semantic_summary", F.array_join("file_references", "\n"), F.array_join(F.transform("decisions", lambda d: F.concat_ws("\n", d["statement"], d["rationale"])), "\n"), F.array_join(F.transform("errors_found", lambda e: F.concat_ws("\n", e["message"], e["root_cause"], e["fix_attempt"])), "\n"))
    lost = F.filter(T.protected_terms(sources), lambda t: ~F.lower(body).contains(F.lower(t)))
    trimmed = F.rtrim(body)
    stop = F.when((trimmed != "") & ~trimmed.endswith("."), F.concat(trimmed, F.lit("."))).otherwise(trimmed)
    return F.when(F.size(lost) > 0, F.concat(stop, F.lit(" Terms: "), F.array_join(lost, ", "))).otherwise(body)


# Exact symbols by type.
SYMBOLS = {"env_var": r"\b([A-Z_][A-Z0-9_]{3,})\b", "cve": r"\b(CVE-\d{4}-\d+)\b", "package_version": r"\b([a-zA-Z0-9_-]+>=?[\d.]+)\b", "api_endpoint": r"(/api/[a-zA-Z0-9/_-]+)", "ci_job": r"\b([a-zA-Z0-9_-]+-job)\b"}


def extract_symbols(memories: DataFrame) -> DataFrame:
    """project_id, symbol, symbol_type, n_sources: the first type seen for each symbol of a project."""
    text = F.concat(F.coalesce("raw_text", F.lit("")), F.lit(" "), F.coalesce("compressed_summary", F.lit("")))

    def typed(symbols, rank: int, kind: str) -> Column:
        return F.transform(symbols, lambda s: F.struct(F.lit(rank).alias("rank"), s.alias("symbol"), F.lit(kind).alias("symbol_type")))

    found = [typed(T.all_matches(text, p, 1), i, kind) for i, (kind, p) in enumerate(SYMBOLS.items())]
    files = typed("file_references", len(SYMBOLS), "file_path")
    rows = memories.select("project_id", "memory_id", F.explode(F.concat(*found, files)).alias("s"))
    return rows.groupBy("project_id", "s.symbol").agg(F.min_by("s.symbol_type", F.struct("memory_id", "s.rank")).alias("symbol_type"), F.countDistinct("memory_id").alias("n_sources"))
