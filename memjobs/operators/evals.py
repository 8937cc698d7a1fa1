"""Evaluation over labelled scenarios: recalls, composites, rankings, sweeps and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memjobs.operators.ledger import any_contains
from memjobs.operators.vectors import vector_candidates
from memjobs.sources.tables import written

# Words that tell a reason, and words that excuse a stale fact.
WHY = ("why", "because", "rationale", "reason", "tradeoff", "alternative", "instead of")
EXCUSES = ("deprecated", "rejected", "superseded", "old", "do not use", "v2", "instead")
NEAR = 60
# Weights of the two composites.
QUALITY_7 = {"exact_symbol": 0.15, "decision": 0.15, "project_state": 0.15, "open_task": 0.1, "error_bug": 0.1, "file_function": 0.1, "stale_suppression": 0.1, "citation": 0.05, "context_usefulness": 0.05, "token_efficiency": 0.05}
QUALITY_9 = {"exact_symbol": 0.15, "decision": 0.15, "project_state": 0.15, "error_bug": 0.1, "open_task": 0.1, "file_function": 0.1, "stale_suppression": 0.1, "rationale": 0.05, "token_efficiency": 0.1}


def _hits(text: Column, terms: str | Column) -> Column:
    return F.size(F.filter(terms, lambda t: F.contains(text, F.lower(t))))


def recall(text: Column, terms: str, empty: float = 1.0) -> Column:
    """Share of terms in the lower-case text."""
    return F.when(F.size(terms) == 0, empty).otherwise(_hits(text, terms) / F.size(terms))


def restore_metrics(packs: DataFrame, scenarios: DataFrame) -> DataFrame:
    """packs (name, method, text, state_text, tokens), scenarios (name, expected_*, exact_symbols) -> recalls per pack."""
    x = packs.join(scenarios, "name")
    text = F.col("text")
    verbatim = recall(text, "expected_goals")
    symbols = F.exists("exact_symbols", lambda s: F.contains(text, F.lower(s)))
    exact = F.when(F.size("expected_goals") == 0, 1.0).when(symbols, 1.0).otherwise(verbatim)
    decisions, errors = recall(text, "expected_decisions"), recall(text, "expected_errors")
    every = F.concat("expected_goals", "expected_decisions", "expected_errors")
    state = F.when(F.size(every) == 0, 1.0).otherwise(_hits(F.col("state_text"), every) / F.size(every))
    rationale = F.when((F.size("expected_decisions") > 0) & any_contains(text, WHY), 1.0).otherwise(0.0)
    return x.select("name", "method", "tokens", verbatim.alias("goal_verbatim"), exact.alias("goal_exact"), decisions.alias("decision"), errors.alias("error"), rationale.alias("rationale"), state.alias("project_state"), ((verbatim + decisions + errors) / 3).alias("overall_verbatim"), ((exact + decisions + errors) / 3).alias("overall_exact"))


def _told(x: DataFrame, text: Column, terms: str) -> Column:
    """The recall of a list of terms that scenarios may lack: then it counts as met."""
    return recall(text, terms) if terms in x.columns else F.lit(1.0)


def component_metrics(packs: DataFrame, scenarios: DataFrame) -> DataFrame:
    """The parts of quality of each pack.

    State: goals .3, tasks .3, constraints .2, dependencies .2.  Errors: text
    .4, root cause .35, fix .25.  Files and functions by halves.  Lists that a
    scenario lacks (expected_tasks, constraints, dependencies, root_causes,
    fixes, functions, expected_rationales) count as met; open tasks count as
    not, and without rationales a marker word tells one.
    """
    x = packs.join(scenarios, "name")
    text = F.col("text")
    wrong = F.when(F.size("rejected") > 0, _hits(text, "rejected") / F.size("rejected")).otherwise(0.0)
    correct = F.greatest(F.lit(0.0), _hits(text, "expected_decisions") / F.greatest(F.size("expected_decisions"), F.lit(1)) - wrong)
    goals, errors = recall(text, "expected_goals"), recall(text, "expected_errors")
    told = lambda name: _told(x, text, name)
    marked = F.when(any_contains(text, WHY), 1.0).otherwise(0.0)
    rationale = F.when(F.size("expected_rationales") > 0, recall(text, "expected_rationales")).otherwise(marked) if "expected_rationales" in x.columns else marked
    stale = F.when(F.size("stale_facts") > 0, _hits(text, "stale_facts") / F.size("stale_facts")).otherwise(0.0)
    parts = {
        "exact_symbol": recall(text, "exact_symbols"), "decision": recall(text, "expected_decisions"), "decision_correctness": correct,
        "project_state": 0.3 * goals + 0.3 * told("expected_tasks") + 0.2 * told("constraints") + 0.2 * told("dependencies"),
        "open_task": told("expected_tasks") if "expected_tasks" in x.columns else F.lit(0.0),
        "error_bug": 0.4 * errors + 0.35 * told("root_causes") + 0.25 * told("fixes"), "file_function": 0.5 * recall(text, "expected_files") + 0.5 * told("functions"),
        "stale_suppression": 1 - stale, "citation": F.lit(1.0), "context_usefulness": F.lit(0.0), "rationale": rationale,
        "token_efficiency": (goals + recall(text, "expected_decisions") + errors) / 3 * (1 - F.col("tokens") / 306.0),
    }
    return x.select("name", "method", *[c.alias(n) for n, c in parts.items()])


def quality(components: DataFrame) -> DataFrame:
    total = lambda weights: sum((w * F.col(c) for c, w in weights.items()), F.lit(0.0))
    return components.select("name", "method", total(QUALITY_7).alias("quality_7"), total(QUALITY_9).alias("quality_9"))


def score_packs(packs: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Keyword coverage, stale penalty (a hit with an excusing word within 60 characters is none), survival, quality."""
    x = packs.join(scenarios, "name")
    text = F.col("text")

    def stale(fact: Column) -> Column:
        low = F.lower(fact)
        whole = F.regexp_like(text, F.concat(F.lit(r"\b\Q"), low, F.lit(r"\E\b")))
        at = F.instr(text, low)
        around = F.substring(text, F.greatest(at - NEAR, F.lit(1)), F.least(at - 1, F.lit(NEAR)) + F.length(low) + NEAR)
        return whole & ~any_contains(around, EXCUSES)

    penalty = F.when(F.size("stale_facts") > 0, F.size(F.filter("stale_facts", stale)) / F.size("stale_facts")).otherwise(0.0)
    coverage = _hits(text, "keywords") / F.greatest(F.size("keywords"), F.lit(1))
    restore = (recall(text, "expected_goals") + recall(text, "expected_decisions") + recall(text, "expected_errors")) / 3
    critical = _hits(text, "exact_symbols") / F.greatest(F.size("exact_symbols"), F.lit(1))
    return x.select("name", "method", "tokens", restore.alias("restore"), coverage.alias("keyword_coverage"), penalty.alias("stale_penalty"), critical.alias("critical_survival"), (restore + coverage - penalty).alias("quality"))


def ranking_metrics(retrieved: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """retrieved (request_id, memory_id, rank), gold (request_id, memory_id) -> recall at each k and reciprocal rank per request."""
    hit = gold.join(retrieved, ["request_id", "memory_id"], "left")
    cols = [(F.count_if(F.col("rank") <= k) / F.count("*")).alias(f"recall_{k}") for k in ks]
    return hit.groupBy("request_id").agg(*cols, F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"), F.count("*").alias("n_gold"))


def unique_to(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(request_id, memory_id) among the first k of one retriever and not of the other."""
    pick = lambda df: df.where(F.col("rank") <= k).select("request_id", "memory_id")
    return pick(left).exceptAll(pick(right))


def semantic_match(expected: DataFrame, sections: DataFrame, threshold: float = 0.65) -> DataFrame:
    """expected (name, item, vector) and sections (name, vector) -> name, recall, mean best cosine.

    The best of each item is the nearest section of its name, found by multiplying
    blocks of items with batches of sections.  Zero vectors have a cosine of 0
    with those of their length; other lengths and nulls have none.
    """
    whole = lambda v: v.isNotNull() & ~F.exists(v, lambda x: x.isNull())
    zero = ~F.exists("vector", lambda x: x != 0)
    asked = written(expected.where("name is not null").select("name", "item", "vector").withColumn("request_id", F.monotonically_increasing_id()))
    told = sections.where("name is not null").select("name", F.when(whole(F.col("vector")), F.col("vector")).alias("vector"))
    lengths = told.groupBy("name").agg(F.collect_set(F.size("vector")).alias("lengths"), F.collect_set(F.when(zero, F.size("vector"))).alias("zeros"))
    rows = told.where("vector is not null").select(F.lit(0).alias("memory_id"), F.col("name").alias("project_id"), "vector")
    near = vector_candidates(rows, asked.where(whole(F.col("vector"))).select("request_id", F.col("name").alias("project_id"), "vector"), 1).select("request_id", "score")
    none = whole(F.col("vector")) & (F.array_contains("zeros", F.size("vector")) | (zero & F.array_contains("lengths", F.size("vector"))))
    each = asked.join(lengths, "name").join(near, "request_id", "left").withColumn("best", F.greatest("score", F.when(none, 0.0)))
    best = each.groupBy("name", "item").agg(F.max("best").alias("best"))
    return best.groupBy("name").agg(F.avg((F.col("best") >= threshold).cast("double")).alias("recall"), F.avg("best").alias("mean_best"))


def threshold_sweep(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """scores (label 0/1, score): per threshold the confusion counts, precision, recall, F1 (denominators 1 at least).

    The thresholds are an array on each row, exploded after one pass of
    counting, so nothing but counts is multiplied.
    """
    each = scores.select("label", F.explode(F.transform(F.array(*map(F.lit, thresholds)), lambda t: F.struct(t.alias("t"), (F.col("score") >= t).alias("p")))).alias("x"))
    counts = each.groupBy(F.col("x.t").alias("threshold")).agg(F.count_if(F.col("x.p") & (F.col("label") == 1)).alias("tp"), F.count_if(F.col("x.p") & (F.col("label") == 0)).alias("fp"), F.count_if(~F.col("x.p") & (F.col("label") == 1)).alias("fn"))
    precision, rec = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    both = precision + rec
    return counts.withColumns({"precision": precision, "recall": rec, "f1": F.when(both > 0, 2 * precision * rec / both).otherwise(0.0)})


def contamination(packed: DataFrame, memories: DataFrame) -> DataFrame:
    """packed (request_id, project_id, memory_id): per request the packed ids of other projects, and per 50."""
    own = memories.select("memory_id", F.col("project_id").alias("owner"))
    foreign = F.count_if(F.col("owner") != F.col("project_id"))
    return packed.join(own, "memory_id").groupBy("request_id").agg(foreign.alias("n_foreign"), (foreign / 50.0).alias("rate"))


def false_memory_rate(memories: DataFrame, planted: list[str]) -> DataFrame:
    """One row: decisions that hold planted text, over all decisions."""
    low = F.lower("raw_text")
    return memories.where("memory_type = 'decision'").agg(F.count("*").alias("decisions"), F.count_if(any_contains(low, [p.lower() for p in planted])).alias("planted")).withColumn("rate", F.col("planted") / F.greatest(F.col("decisions"), F.lit(1)))


def compare_methods(scores: DataFrame) -> DataFrame:
    """Per method: means of restore, tokens, coverage, stale penalty and quality; spread of quality."""
    means = [F.avg(c).alias(f"mean_{c}") for c in ("restore", "tokens", "keyword_coverage", "stale_penalty", "quality")]
    return scores.groupBy("method").agg(*means, F.median("quality").alias("median_quality"), F.min("quality").alias("min_quality"), F.max("quality").alias("max_quality"))


def ablation_deltas(means: DataFrame, baseline: str) -> DataFrame:
    """Each method's mean quality less the baseline's: one row is broadcast."""
    base = means.where(F.col("method") == baseline).select(F.col("mean_quality").alias("base"))
    return means.where(F.col("method") != baseline).join(F.broadcast(base)).select("method", (F.col("mean_quality") - F.col("base")).alias("delta"))


def pack_success_rates(scores: DataFrame, enough: float = 0.67) -> DataFrame:
    """scores (method, task, restore): share of packs with enough restored, by task, by method, and over all, in one pass."""
    ok = (F.col("restore") >= enough).cast("double")
    sets = [[F.col("task")], [F.col("method")], []]
    return scores.groupingSets(sets, F.col("task"), F.col("method")).agg(F.count("*").alias("n"), F.avg(ok).alias("rate"))


def content_success_rates(scores: DataFrame, packs: DataFrame, memories: DataFrame, enough: float = 0.67) -> DataFrame:
    """kind, value, n, rate: the share of successes among packs that show a section, and among memories of a type that packs include.

    scores: request_id, restore.  packs: request_id, sections.
    """
    sections = packs.select("request_id", F.explode("sections").alias("s")).select("request_id", F.col("s.name").alias("section"), F.col("s.memory_ids").alias("ids"))
    of_sections = sections.select("request_id", F.lit("section").alias("kind"), F.col("section").alias("value"))
    included = sections.select("request_id", F.explode("ids").alias("memory_id")).join(memories.select("memory_id", "memory_type"), "memory_id")
    of_types = included.select("request_id", F.lit("memory_type").alias("kind"), F.col("memory_type").alias("value"))
    judged = of_sections.union(of_types).join(scores.select("request_id", (F.col("restore") >= enough).cast("double").alias("ok")), "request_id")
    return judged.groupBy("kind", "value").agg(F.count("*").alias("n"), F.avg("ok").alias("rate"))


def task_scores(packs: DataFrame, tasks: DataFrame, second: bool = False) -> DataFrame:
    """packs (name, text, verified), tasks (name, category, expected, forbidden): recall less half the forbidden share, less 0.2 if unverified; mean per category.

    The second variant knows no forbidden terms and takes 0.1 off the recall, even below zero.
    """
    x = packs.join(tasks, "name")
    text = F.col("text")
    if second:
        score = recall(text, "expected") - F.when(F.col("verified"), 0.0).otherwise(0.1)
    else:
        forbidden = F.when(F.size("forbidden") > 0, _hits(text, "forbidden") / F.size("forbidden")).otherwise(0.0)
        score = F.greatest(F.lit(0.0), recall(text, "expected") - 0.5 * forbidden - F.when(F.col("verified"), 0.0).otherwise(0.2))
    return x.groupBy("category").agg(F.avg(score).alias("mean_score"), F.avg((score >= 0.8).cast("double")).alias("share_passed"), F.count("*").alias("n"))


def audit_scenarios(run: DataFrame, manifest: DataFrame, tuning: DataFrame) -> DataFrame:
    """One row: names missing from or extra to the manifest, unlocked, in the tuning set too, with another content hash, and whether all is well."""
    hashed = run.select("name", F.sha2(F.to_json(F.struct(*[c for c in run.columns if c != "name"])), 256).alias("hash"))
    joined = hashed.join(manifest.select("name", F.col("hash").alias("known"), "locked", F.lit(True).alias("listed")), "name", "full")
    overlap = hashed.select("name").intersect(tuning.select("name")).agg(F.count("*").alias("overlap"))
    out = joined.agg(
        F.count_if(F.col("hash").isNull()).alias("missing"), F.count_if(F.col("listed").isNull()).alias("extra"), F.count_if(~F.col("locked")).alias("unlocked"), F.count_if(F.col("hash") != F.col("known")).alias("changed")
    ).join(F.broadcast(overlap))
    return out.withColumn("ok", (F.col("missing") + F.col("extra") + F.col("unlocked") + F.col("changed") + F.col("overlap")) == 0)
