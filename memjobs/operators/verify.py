"""Answers checked against memories: one pass over the joined rows of each response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memjobs.functions import text as T
from memjobs.operators.ledger import any_contains, top_memories

# Claims that need a citation, strong words, negations, file endings.
CLAIMS = (r"we decided to \w+", r"the (error|bug|issue) is \w+", r"the (test|deployment|build) (passed|failed|succeeded)", r"we should use \w+", r"the current (phase|status|branch) is \w+")
STRONG = r"\b(never|always|must|impossible|certainly|definitely)\s+\w+"
NEGATIONS = ("not", "no longer", "reversed", "cancelled", "abandoned", "dropped")
FILES = r"(?i)[\w\-_/]+\.(?:py|ts|js|tsx|jsx|rs|go|java|c|cpp|h|yaml|yml|json|toml|md|txt|cfg|ini)"
COSTS = {"violation": 0.3, "warning": 0.05}


def verify_responses(responses: DataFrame, retrieved: DataFrame) -> DataFrame:
    """response_id, violations, warnings, score, passed.

    responses: response_id, project_id, text.  retrieved: response_id and its
    memories' memory_type, validity, source_type, project_id, statement (null
    but for decisions), compressed_summary, raw_text, file_references, and where
    known ``entities``, the names that they tell of.
    """
    entities = F.coalesce("entities", F.array().cast("array<string>")) if "entities" in retrieved.columns else F.array().cast("array<string>")
    m = retrieved.select(
        "response_id", F.col("project_id").alias("m_project"), "memory_type", "validity", "source_type", F.lower("statement").alias("said"),
        F.lower(F.coalesce("compressed_summary", "raw_text", F.lit(""))).alias("summary"), "file_references",
        F.concat(entities, F.filter(F.regexp_extract_all(F.coalesce("compressed_summary", "raw_text", F.lit("")), F.lit(r"\b[a-zA-Z_][a-zA-Z0-9_]*\b"), F.lit(0)), lambda s: (F.length(s) > 5) & s.rlike("[A-Z]"))).alias("names"),
    )
    x = responses.withColumn("low", F.lower("text")).join(m, "response_id", "left")
    low = F.col("low")
    said, summary = F.col("said"), F.col("summary")
    decides = (F.col("memory_type") == "decision") & (F.length(said) > 10)
    at = F.instr(low, F.substring(said, 1, 30))
    around = F.substring(low, F.greatest(at - 30, F.lit(1)), F.least(at - 1, F.lit(30)) + F.length(said) + 30)
    tool = (F.col("source_type") == "tool_output")
    mismatch = (summary.contains("passed") & low.contains("failed") & summary.contains("test")).cast("int") + (summary.contains("success") & summary.contains("deploy") & low.contains("failed")).cast("int") + (summary.contains("0 issues") & summary.contains("lint") & low.contains("error")).cast("int")
    hits = {
        "rejected_decision_revival": (decides & (F.col("validity") == "rejected") & F.contains(low, said)).cast("int"),
        "stale_usage": (F.col("validity").isin("archived", "superseded", "disputed") & (F.length(summary) > 10) & F.contains(low, summary)).cast("int"),
        "tool_evidence_mismatch": F.when(tool, mismatch).otherwise(0),
        "active_decision_contradiction": (decides & (F.col("validity") == "active") & (at > 0) & any_contains(around, NEGATIONS)).cast("int"),
    }
    of_rows = x.groupBy("response_id", "project_id", "text").agg(
        *[F.coalesce(F.sum(h), F.lit(0)).alias(n) for n, h in hits.items()],
        F.array_distinct(F.flatten(F.collect_set(F.transform("file_references", F.lower)))).alias("files"), F.array_distinct(F.flatten(F.collect_set(F.transform("names", F.lower)))).alias("names"), F.collect_set("m_project").alias("projects"),
    )
    text, low = F.col("text"), F.lower("text")
    cited = text.rlike("(?i)mem_[a-z0-9]+")
    mentioned = F.transform(T.all_matches(text, FILES), F.lower)
    symbols = F.filter(T.all_matches(text, r"\b[A-Z][a-zA-Z0-9]*(?:[A-Z][a-zA-Z0-9]*)+\b"), lambda s: F.length(s) > 6)
    claims = F.lit(False)
    for p in CLAIMS:
        claims = claims | low.rlike(p)
    warnings = {
        "unverified_file": F.size(F.filter(mentioned, lambda f: ~F.array_contains("files", f))),
        "unverified_symbol": F.size(F.filter(symbols, lambda s: ~F.array_contains("names", F.lower(s)))),
        "no_citations": (~cited & (F.length(text) > 200)).cast("int"),
        "missing_citation_on_claim": (claims & ~cited).cast("int"),
        "unsupported_strong_claim": (low.rlike(STRONG) & ~cited).cast("int"),
        "cross_project_leakage": ((F.size("projects") > 0) & ~F.array_contains("projects", F.col("project_id"))).cast("int"),
    }
    n_violations = sum((F.col(n) for n in hits), F.lit(0))
    found = lambda counts: F.array_compact(F.array(*[F.when(c > 0, n) for n, c in counts.items()]))
    counted = of_rows.withColumns({f"w_{n}": c for n, c in warnings.items()})
    n_warnings = sum((F.col(f"w_{n}") for n in warnings), F.lit(0))
    score = F.greatest(F.lit(0.0), 1.0 - COSTS["violation"] * n_violations - COSTS["warning"] * n_warnings)
    return counted.select("response_id", found({n: F.col(n) for n in hits}).alias("violations"), found({n: F.col(f"w_{n}") for n in warnings}).alias("warnings"), n_violations.cast("long").alias("n_violations"), n_warnings.cast("long").alias("n_warnings"), F.round(score, 6).alias("score"), (n_violations == 0).alias("passed"))


def verify_citations(answers: DataFrame, memories: DataFrame) -> DataFrame:
    """answer_id with counts of cited ids that are missing, unusable, of another project, and good; score."""
    ids = answers.select("answer_id", F.col("project_id").alias("own"), F.explode_outer(F.array_distinct(T.all_matches(F.col("text"), "mem_[a-f0-9]+"))).alias("memory_id"))
    joined = ids.join(memories.select("memory_id", "validity", "project_id"), "memory_id", "left")
    cited = F.col("memory_id").isNotNull()
    missing = F.count_if(cited & F.col("validity").isNull())
    bad = F.count_if(F.col("validity").isin("superseded", "rejected", "archived"))
    foreign = F.count_if(F.col("project_id") != F.col("own"))
    out = joined.groupBy("answer_id").agg(missing.alias("missing"), bad.alias("unusable"), foreign.alias("foreign"), F.count_if(F.col("validity").isNotNull()).alias("known"))
    violations = F.col("missing") + F.col("unusable") + F.when(F.col("foreign") > 0, 1).otherwise(0)
    return out.withColumn("score", F.greatest(F.lit(0.0), 1.0 - 0.25 * violations)).withColumn("consistent", violations == 0)


# Words that deny, and words that claim a change of files.
DENIALS = ("not", "no", "never", "don't", "doesn't", "shouldn't", "avoid", "instead")
CHANGES = ("changed", "modified")
UNUSABLE = ("superseded", "rejected", "archived")


def verify_consistency(answers: DataFrame, packs: DataFrame, memories: DataFrame, decisions: int = 50) -> DataFrame:
    """answer_id with counts of findings, score and ``consistent``.

    Violations, a quarter each: cited ids that are missing or unusable;
    ``contradicted`` active decisions (the first ``decisions`` of the project
    in rank order) that share a word with an answer that denies something; ids
    in the pack of other projects, one for all.  A warning, a tenth: the
    answer claims changed files and no section of the pack speaks of a tool.
    answers: answer_id, project_id, text.  packs: answer_id, sections.
    memories: with ``statement`` of decisions.
    """
    own = answers.select("answer_id", F.col("project_id").alias("own"), "text")
    known = memories.select("memory_id", "validity", "project_id")
    cited = own.select("answer_id", F.explode(T.all_matches(F.col("text"), "mem_[a-f0-9]+")).alias("memory_id")).join(known, "memory_id", "left")
    cited = cited.groupBy("answer_id").agg(F.count_if(F.col("validity").isNull()).alias("missing"), F.count_if(F.col("validity").isin(*UNUSABLE)).alias("unusable"), F.count_if(~F.col("validity").isin(*UNUSABLE)).alias("citations"))
    said = top_memories(memories.where("statement is not null"), memory_type="decision", validity="active", k=decisions)
    denying = own.withColumn("words", T.words(F.col("text"))).where(F.arrays_overlap("words", F.array(*map(F.lit, DENIALS))))
    against = denying.join(said.select(F.col("project_id").alias("own"), T.words(F.col("statement")).alias("said")), "own").where(F.arrays_overlap("words", "said"))
    against = against.groupBy("answer_id").agg(F.count("*").alias("contradicted"))
    packed = packs.select("answer_id", F.explode(F.flatten(F.transform("sections", lambda s: s["memory_ids"]))).alias("memory_id")).join(known.select("memory_id", "project_id"), "memory_id")
    foreign = packed.join(own.select("answer_id", "own"), "answer_id").groupBy("answer_id").agg(F.max((F.col("project_id") != F.col("own")).cast("int")).alias("foreign"))
    proved = packs.select("answer_id", F.exists("sections", lambda s: F.lower(s["content"]).contains("tool")).alias("proved"))
    x = own
    for part in (cited, against, foreign, proved):
        x = x.join(part, "answer_id", "left")
    x = x.fillna(0, ["missing", "unusable", "citations", "contradicted", "foreign"])
    unproved = (any_contains(F.lower("text"), CHANGES) & ~F.coalesce("proved", F.lit(False))).cast("int")
    violations = F.col("missing") + F.col("unusable") + F.col("contradicted") + F.col("foreign")
    score = F.greatest(F.lit(0.0), 1.0 - 0.25 * violations - 0.1 * unproved)
    return x.select("answer_id", "missing", "unusable", "citations", "contradicted", "foreign", unproved.alias("unproved"), F.round(score, 6).alias("score"), (violations == 0).alias("consistent"))


def repair_actions(results: DataFrame) -> DataFrame:
    """response_id, actions: pass, or what to do about each kind of finding."""
    has = lambda column, *names: F.arrays_overlap(F.col(column), F.array(*map(F.lit, names)))
    todo: list[Column] = [
        F.when(has("violations", "stale_usage"), "stale_flagged"), F.when(has("warnings", "no_citations"), "citation_requested"), F.when(has("violations", "active_decision_contradiction"), "contradiction_warning"),
    ]
    return results.select("response_id", F.when(F.col("passed"), F.array(F.lit("pass"))).otherwise(F.array_compact(F.array(*todo))).alias("actions"))
