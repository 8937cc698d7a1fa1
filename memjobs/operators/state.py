"""Project state: an order-free roll-up of a project's memories, merging, and its text slot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memjobs.operators.ledger import any_contains, rank_order

# Words that tell a phase or a status, in order of use.
PHASES = {
    "planning": ("plan", "design", "architecture", "roadmap"), "development": ("implement", "code", "build", "develop", "feature"), "testing": ("test", "qa", "validate", "verify", "pytest", "jest"),
    "deployment": ("deploy", "release", "staging", "production", "rollout"), "maintenance": ("fix", "patch", "update", "maintain", "refactor"),
}
TESTS = {"passing": ("passed", "green", "all tests pass", "success"), "failing": ("failed", "red", "test failure", "broken"), "partial": ("some tests", "partial", "flaky")}
DEPLOYS = {"staging": ("staging", "preview", "dev"), "production": ("production", "prod", "live"), "rolled_back": ("rollback", "revert", "rolled back")}
BLOCKED = ("blocked", "blocking", "cannot proceed", "waiting for")
RISKY = ("risk", "danger", "critical issue", "concern")
PREFIXES = {
    "decision": ("Proposed decision: ", "Decision: ", "Rejected decision: "), "error": ("Error: ", "Error (test_failure): ", "Error (runtime_error): ", "Error (tool_error): "),
    "requirement": ("Requirement: ", "Goal: ", "Need to "), "task": ("Task: ", "Open task: ", "Assistant plan: "),
}
SCALARS = ("project_phase", "current_branch", "current_milestone", "test_status", "deployment_status")
LISTS = ("active_goals", "open_tasks", "latest_decisions", "current_bugs", "active_files", "blocked_tasks", "active_experiments", "risk_register")


def _detect(low: Column, table: dict) -> Column:
    out = F.lit(None).cast("string")
    for name, words in reversed(table.items()):
        out = F.when(any_contains(low, words), name).otherwise(out)
    return out


def _labelled(text: Column, label: str, stop: str, least: int, most: int) -> Column:
    return F.trim(F.regexp_extract(text, rf"(?i){label}[\s:]+([^{stop}]{{{least},{most}}})", 1))


def _clean(text: Column, kind: str) -> Column:
    """The trimmed text without the first fitting prefix."""
    trimmed = F.trim(text)
    out = trimmed
    for p in reversed(PREFIXES[kind]):
        out = F.when(trimmed.startswith(p), F.trim(F.substring(trimmed, len(p) + 1, 1 << 30))).otherwise(out)
    return out


def project_state(memories: DataFrame, k: int = 500) -> DataFrame:
    """One row per project over its first ``k`` memories in rank order.

    A scalar is the last one told, a list its items by first mention, the
    changed files the last five by first mention.  Each is an aggregate
    (``max_by``, ``min`` and a sort), so no row depends on the one before.
    """
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(*rank_order()))
    rows = memories.withColumn("ord", place).where(F.col("ord") <= k)
    text = F.coalesce(F.nullif("compressed_summary", F.lit("")), "raw_text", F.lit(""))
    low = F.lower(text)
    kind = F.col("memory_type")
    none = F.lit(None).cast("string")
    some = lambda c: F.when(c != "", c)
    milestone = _labelled(text, "milestone", r"\n.", 3, 40)
    phase = _detect(low, PHASES)
    short = F.substring(F.trim(text), 1, 80)
    signals = {
        "project_phase": F.when((kind == "decision") & low.contains("phase"), phase).when(kind.isin("requirement", "intent"), phase),
        "current_branch": F.when(low.contains("branch"), some(_labelled(text, "branch", r"\n.", 3, 40))),
        "current_milestone": F.when(low.contains("milestone"), F.when(kind == "decision", milestone).otherwise(some(milestone))),
        "test_status": F.when(kind == "fact", _detect(low, TESTS)),
        "deployment_status": F.when((kind == "code_change") & any_contains(low, ("deploy", "release")), _detect(low, DEPLOYS)),
    }
    told = F.when(any_contains(low, BLOCKED), some(_labelled(text, "blocked", r"\n", 5, 80)))
    risk = F.when(any_contains(low, RISKY), some(_labelled(text, "risk", r"\n", 5, 80)))
    items = {
        "active_goals": F.array(F.when(kind == "requirement", _clean(text, "requirement"))),
        "open_tasks": F.array(F.when(kind == "task", _clean(text, "task"))),
        "latest_decisions": F.array(F.when(kind == "decision", _clean(text, "decision"))),
        "current_bugs": F.array(F.when(kind == "error", _clean(text, "error"))),
        "active_files": F.when(kind == "code_change", F.col("file_references")).otherwise(F.array().cast("array<string>")),
        "blocked_tasks": F.array(told, F.when((kind == "error") & any_contains(low, BLOCKED[:3]), short).when((kind == "task") & any_contains(low, (*BLOCKED[:2], BLOCKED[3])), short)),
        "active_experiments": F.array(F.when((kind == "intent") & any_contains(low, ("experiment", "spike", "prototype", "poc")), short)),
        "risk_register": F.array(risk, F.when((kind == "error") & any_contains(low, RISKY[:3]), short).when((kind == "uncertainty") & any_contains(low, ("risk", "concern", "uncertain")), short), none),
    }
    told_rows = rows.select("project_id", "memory_id", "ord", *[c.alias(n) for n, c in signals.items()], *[F.array_compact(c).alias(n) for n, c in items.items()])
    scalars = told_rows.groupBy("project_id").agg(*[F.coalesce(F.max_by(n, F.when(F.col(n).isNotNull(), F.col("ord"))), F.lit("")).alias(n) for n in SCALARS], F.count("*").alias("n_sources"))
    entries = F.concat(*map(_entries, LISTS))
    exploded = told_rows.select("project_id", "ord", F.explode(entries).alias("e")).select("project_id", "ord", "e.*")
    firsts = exploded.groupBy("project_id", "name", "item").agg(F.min(F.struct("ord", "i")).alias("at"))
    grouped = firsts.groupBy("project_id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("name") == n, F.struct("at", "item")))), lambda x: x["item"]).alias(n) for n in LISTS])
    out = scalars.join(grouped, "project_id", "left").withColumns({n: F.coalesce(n, F.array().cast("array<string>")) for n in LISTS})
    recent = F.when(F.size("active_files") > 5, F.slice("active_files", -5, 5)).otherwise(F.col("active_files"))
    return out.withColumns({"recently_changed_files": recent, "confidence": F.lit(0.7), "version": F.lit(1)})


def _entries(name: str) -> Column:
    return F.transform(name, lambda x, i: F.struct(F.lit(name).alias("name"), i.alias("i"), x.alias("item")))


def merge_state(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Unseen items appended, newer scalars if told, the mean confidence, the next version; projects of one side stay as they are."""
    o, d = old.alias("o"), delta.alias("d")
    both = F.col("o.project_id").isNotNull() & F.col("d.project_id").isNotNull()
    joined = o.join(d, F.col("o.project_id") == F.col("d.project_id"), "full")
    one = lambda n: F.coalesce(F.col(f"o.{n}"), F.col(f"d.{n}"))
    cols = [F.coalesce("o.project_id", "d.project_id").alias("project_id")]
    cols += [F.when(both & (F.col(f"d.{n}") != ""), F.col(f"d.{n}")).otherwise(one(n)).alias(n) for n in SCALARS]
    cols += [F.when(both, F.concat(f"o.{n}", F.array_except(f"d.{n}", f"o.{n}"))).otherwise(one(n)).alias(n) for n in LISTS]
    files = F.array_distinct(F.concat("o.recently_changed_files", "d.recently_changed_files"))
    last = F.when(F.size(files) > 5, F.slice(files, -5, 5)).otherwise(files)
    cols.append(F.when(both, last).otherwise(one("recently_changed_files")).alias("recently_changed_files"))
    cols.append(F.when(both, (F.col("o.confidence") + F.col("d.confidence")) / 2).otherwise(one("confidence")).alias("confidence"))
    cols.append(F.when(both, F.col("o.version") + 1).otherwise(one("version")).alias("version"))
    return joined.select(*cols)


def _cut(text: Column, n: int = 40) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n - 3), F.lit("...")))


def state_slot(states: DataFrame, stale_terms: list[str] = (), max_items: int = 1) -> DataFrame:
    """project_id, slot: the state as short ``key=value`` text; items with a stale term are left out."""

    def scalar(key: str, name: str, n: int | None = None) -> Column:
        return F.when(F.col(name) != "", F.concat(F.lit(f"{key}="), _cut(F.col(name), n) if n else F.col(name)))

    def items(key: str, name: str, k: int = max_items, filtered: bool = True) -> Column:
        kept = F.col(name)
        if filtered and stale_terms:
            kept = F.filter(kept, lambda x: ~any_contains(F.lower(x), [s.lower() for s in stale_terms]))
        return F.transform(F.slice(kept, 1, k), lambda x: F.concat(F.lit(f"{key}="), _cut(x)))

    head = F.array_compact(F.array(scalar("ph", "project_phase"), scalar("ms", "current_milestone", 30), scalar("br", "current_branch"), scalar("t", "test_status"), scalar("dpl", "deployment_status")))
    files = F.when(F.size("recently_changed_files") > 0, F.array(F.concat(F.lit("f="), F.array_join(F.slice("recently_changed_files", 1, 2), ",")))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(head, items("g", "active_goals"), items("t", "open_tasks"), items("blk", "blocked_tasks"), items("d", "latest_decisions"), items("b", "current_bugs"), files, items("exp", "active_experiments", 1, False), items("risk", "risk_register", 1, False))
    return states.select("project_id", F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise("### Project State").alias("slot"))


def symbol_slot(symbols: DataFrame, requests: DataFrame, k: int = 3) -> DataFrame:
    """request_id, slot: the project's first symbols that the query names or the request requires."""
    required = F.coalesce(F.col("required_terms"), F.array().cast("array<string>")) if "required_terms" in requests.columns else F.array().cast("array<string>")
    asked = requests.select("request_id", "project_id", F.lower("query").alias("q"), F.transform(required, F.lower).alias("required"))
    low = F.lower("symbol")
    named = asked.join(symbols, "project_id").where(F.col("q").contains(low) | F.array_contains("required", low))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("symbol"))
    first = named.withColumn("n", place).where(F.col("n") <= k)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "symbol"))), lambda x: x["symbol"]), ",")
    return first.groupBy("request_id").agg(F.concat(F.lit("s="), joined).alias("slot"))
