"""Restored sessions, expanded packs and field coverage: compositions of retrieval and packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memjobs.functions import text as T
from memjobs.operators import packs, retrieve, verify
from memjobs.sources.tables import written

ROUNDS = 2


def restore_sessions(sessions: DataFrame, memories: DataFrame, states: DataFrame | None = None, token_budget: int = 32768, max_pack_tokens: int = 65) -> DataFrame:
    """One pack per session (session_id, project_id, optional query): retrieval over the session's and its project's rows."""
    query = F.coalesce("query", F.lit("resume work")) if "query" in sessions.columns else F.lit("resume work")
    requests = sessions.select(F.col("session_id").alias("request_id"), "session_id", "project_id", query.alias("query"), F.expr("CAST(map() AS map<string, boolean>)").alias("requirements"))
    plans = retrieve.make_plan(requests).withColumns({"token_budget": F.lit(token_budget), "max_pack_tokens": F.lit(max_pack_tokens)})
    return packs.build_packs(plans, retrieve.retrieve(requests, memories), memories, states=states)


def _checked(requests: DataFrame, built: DataFrame, found: DataFrame, memories: DataFrame) -> DataFrame:
    text = built.select("request_id", packs.pack_text("sections").alias("text"))
    held = found.select("request_id", "memory_id").join(memories, "memory_id").withColumn("statement", F.when(F.col("memory_type") == "decision", F.col("raw_text")))
    return packs.pack_sufficiency(requests, text, held)


def _rewritten() -> Column:
    """The query with up to three words that the pack lacks, the types that no candidate has, and ``recent`` for a short pack."""
    words = F.slice("missing_words", 1, 3)
    hints = F.filter("missing_types", lambda t: ~F.contains(F.lower(F.concat_ws(" ", "query", F.array_join(words, " "))), t))
    recent = F.when(F.array_contains("issues", "pack_too_short") & ~F.contains(F.lower("query"), F.lit("recent")), "recent")
    return F.concat_ws(" ", "query", F.when(F.size(words) > 0, F.array_join(words, " ")), F.when(F.size(hints) > 0, F.array_join(hints, " ")), recent)


def auto_expand(requests: DataFrame, memories: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Packs of all requests after up to ``rounds`` re-retrievals of the insufficient ones.

    A request goes on while its pack is insufficient and its query grows by it.
    New candidates follow the old ones, and all enter the next pack.  The loop
    is over rounds; each reads the insufficient requests only, and writes what
    the next one starts from.  Memories are read in each, so they should be stored.
    """
    index = retrieve.bm25_index(memories)
    budget = {"token_budget": F.lit(32768), "max_pack_tokens": F.lit(65)}
    todo, found, done = requests, None, []
    for round_ in range(rounds + 1):
        plans = written(retrieve.make_plan(todo).withColumns(budget))
        fresh = written(retrieve.retrieve(todo, memories, index=index).select("request_id", "memory_id", "rank"))
        if found is None:
            found = fresh
        else:
            known = found.join(todo.select("request_id"), "request_id", "left_semi")
            last = known.groupBy("request_id").agg(F.max("rank").alias("last"))
            place = F.row_number().over(Window.partitionBy("request_id").orderBy("rank")) + F.coalesce("last", F.lit(0))
            new = fresh.join(known, ["request_id", "memory_id"], "left_anti").join(last, "request_id", "left")
            found = written(known.union(new.select("request_id", "memory_id", place.alias("rank"))))
        built = written(packs.build_packs(plans, found, memories, most=packs.MOST * (round_ + 1)))
        if round_ == rounds:
            done.append(built)
            break
        judged = plans.join(_checked(plans, built, found, memories), "request_id").withColumn("asked", _rewritten())
        judged = written(judged.withColumn("again", ~F.col("sufficient") & (F.col("asked") != F.col("query"))))
        done.append(built.join(judged.where("not again").select("request_id"), "request_id", "left_semi"))
        todo = judged.where("again").withColumn("query", F.col("asked")).select(*requests.columns)
        if todo.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out


# What an answer made of a pack says first, how much of the pack it takes, what a failed verification costs.
PREAMBLE, SPOKEN, FAILED = "Based on the project memory, ", 500, 0.1


def budget_curve(requests: DataFrame, memories: DataFrame, budgets: list[int], k: int = 50, token_budget: int = 8192) -> DataFrame:
    """budget, recall, passed, score, tokens, sections, n: what packs of different sizes are worth on average.

    requests: request_id, project_id, query, requirements, ``expected`` (texts
    that a pack should hold).  Retrieval and reranking don't depend on the budget
    and run once.  A pack's recall is the share of expected texts in it, 1 where
    none is expected; an answer that repeats its first characters is verified
    against the candidates, and a failed verification takes ``FAILED`` off.
    """
    plans = written(retrieve.make_plan(requests).withColumn("token_budget", F.lit(token_budget)))
    found = retrieve.retrieve(requests, memories, k=k).select("request_id", "memory_id")
    scored = retrieve.rerank_score(found.join(memories.drop("project_id", "session_id"), "memory_id").join(plans.select("request_id", "task", "query"), "request_id")).withColumn("score", F.round("score", 9))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "memory_id"))
    best = written(scored.select("request_id", "memory_id", place.alias("rank")).where(F.col("rank") <= k))
    each = plans.withColumn("max_pack_tokens", F.explode(F.array(*map(F.lit, budgets)))).withColumn("asked", F.col("request_id"))
    each = each.withColumn("request_id", F.struct("asked", "max_pack_tokens"))
    candidates = best.withColumnRenamed("request_id", "asked").join(each.select("request_id", "asked"), "asked").drop("asked")
    built = written(packs.build_packs(each, candidates, memories).select("request_id", "project_id", packs.pack_text("sections").alias("pack"), "tokens", F.size("sections").alias("sections")))
    said = built.select(F.col("request_id").alias("response_id"), "project_id", F.concat(F.lit(PREAMBLE), F.substring("pack", 1, SPOKEN)).alias("text"))
    known = candidates.select(F.col("request_id").alias("response_id"), "memory_id").join(memories, "memory_id")
    if "statement" not in memories.columns:
        known = known.withColumn("statement", F.when(F.col("memory_type") == "decision", F.col("raw_text")))
    verified = verify.verify_responses(said, known).select(F.col("response_id").alias("request_id"), "passed")
    expected = F.transform(F.coalesce("expected", F.array().cast("array<string>")), F.lower)
    held = F.size(F.filter("wanted", lambda t: F.contains(F.col("pack"), t)))
    judged = built.join(each.select("request_id", expected.alias("wanted")), "request_id").join(verified, "request_id")
    judged = judged.withColumn("recall", F.when(F.size("wanted") > 0, held / F.size("wanted")).otherwise(1.0))
    judged = judged.withColumn("score", F.greatest(F.lit(0.0), F.col("recall") - F.when(F.col("passed"), 0.0).otherwise(FAILED)))
    means = [F.avg(c).alias(n) for n, c in (("recall", "recall"), ("passed", F.col("passed").cast("int")), ("score", "score"), ("tokens", "tokens"), ("sections", "sections"))]
    return judged.groupBy(F.col("request_id.max_pack_tokens").alias("budget")).agg(*means, F.count("*").alias("n"))


# The state's fields that a pack should show.
SHOWN = ("project_phase", "current_branch", "current_milestone", "test_status", "deployment_status")
SHOWN_LISTS = ("blocked_tasks", "active_experiments", "risk_register")


def state_field_coverage(states: DataFrame, packs_text: DataFrame) -> DataFrame:
    """project_id, coverage: the share of eight state fields of which the pack's text (project_id, text) shows the value or a word of over four letters."""

    def shown(value: Column) -> Column:
        low = F.lower(value)
        words = F.filter(F.split(low, r"\s+"), lambda w: F.length(w) > 4)
        return F.coalesce((low != "") & (F.contains(F.col("text"), low) | F.exists(words, lambda w: F.contains(F.col("text"), w))), F.lit(False))

    checks = [shown(F.col(c)) for c in SHOWN] + [F.exists(c, shown) for c in SHOWN_LISTS]
    hits = sum((c.cast("int") for c in checks), F.lit(0))
    return states.join(packs_text, "project_id").select("project_id", (hits / len(checks)).alias("coverage"))


def entry_field_coverage(memories: DataFrame) -> DataFrame:
    """project_id, the shares of three decision and five error sub-fields that any row of the project fills."""
    told = lambda column, name: F.max(F.exists(column, lambda e: F.coalesce(e[name], F.lit("")) != "").cast("int"))
    listed = F.max(F.exists("decisions", lambda d: F.size(d["alternatives"]) > 0).cast("int"))
    risky = F.max(F.exists("errors_found", lambda e: e["recurrence_risk"] > 0).cast("int"))
    filed = F.max(F.exists("errors_found", lambda e: F.size(e["affected_files"]) > 0).cast("int"))
    decision = (told("decisions", "rationale") + told("decisions", "tradeoffs") + listed) / 3
    error = (told("errors_found", "root_cause") + told("errors_found", "fix_attempt") + told("errors_found", "verified_fix") + risky + filed) / 5
    return memories.groupBy("project_id").agg(decision.alias("decision_fields"), error.alias("error_fields"))
