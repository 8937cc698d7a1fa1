"""Links between memories, superseded decisions, contradictions and graph walks."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memjobs.functions import text as T
from memjobs.operators.ledger import rank_order
from memjobs.operators.similarity import SLACK, distinct_sets, holders, similar_sets
from memjobs.operators.walks import walk
from memjobs.sources.tables import written

# Relations of type pairs, in either direction.
RELATIONS = {
    ("decision", "task"): "decision_affects_task", ("decision", "code_change"): "decision_affects_file", ("error", "code_change"): "error_caused_by_symbol",
    ("error", "decision"): "error_led_to_decision", ("task", "goal"): "task_achieves_goal", ("goal", "decision"): "goal_requires_decision",
    ("tool_call", "error"): "tool_output_verifies_error", ("tool_call", "code_change"): "tool_output_verifies_fix", ("intent", "goal"): "intent_promoted_to_goal",
    ("fact", "decision"): "fact_supports_decision", ("requirement", "decision"): "requirement_leads_to_decision",
}
STOP_WORDS = ("lorem", "ipsum", "dolor", "amet", "consectetur", "adipiscing", "elit", "this", "that", "with", "from", "have", "been", "were", "they", "their", "would", "could", "should", "there", "where", "when", "what", "how")
CLOSE_SECONDS = 300


def keywords(*columns: str, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct lower-case words of four letters or more."""
    text = F.lower(F.concat_ws(" ", *columns))
    return F.array_except(F.array_distinct(T.all_matches(text, r"\b[a-z]{4,}\b")), F.array(*map(F.lit, stop)))


def type_relation(a: Column, b: Column) -> Column:
    pairs = {f"{x}|{y}": r for (x, y), r in RELATIONS.items()} | {f"{y}|{x}": r for (x, y), r in RELATIONS.items()}
    return F.element_at(F.create_map(*map(F.lit, chain(*pairs.items()))), F.concat_ws("|", a, b))


def _before(a: str, b: str) -> Column:
    """Row b is earlier than row a."""
    return F.struct(f"{b}.timestamp", f"{b}.memory_id") < F.struct(f"{a}.timestamp", f"{a}.memory_id")


def _given(a: str, b: str) -> dict[str, Column]:
    """What the rules ask of two memories under these prefixes: one session, a relation of their types, a common file, how many common words, nearness in time."""
    return {
        "session": F.coalesce(F.col(f"{a}session_id") == F.col(f"{b}session_id"), F.lit(False)),
        "relation": type_relation(F.col(f"{a}memory_type"), F.col(f"{b}memory_type")),
        "file": F.coalesce(F.arrays_overlap(f"{a}file_references", f"{b}file_references"), F.lit(False)),
        "near": F.abs(F.col(f"{a}timestamp").cast("double") - F.col(f"{b}timestamp").cast("double")) < CLOSE_SECONDS,
    }


def auto_link(memories: DataFrame, cap: int | None = 100, temporal: bool = True) -> DataFrame:
    """source_id, target_id, relation_type, confidence: each memory against earlier ones of its project, first rule that fits.

    With ``cap``, only a project's first ``cap`` memories in rank order are
    targets, so the join makes at most cap rows for each memory.  Without it,
    each rule has a join of its own that leaves out what earlier rules link, so
    no pair is formed twice; common words are met over prefixes of rare words.
    """
    base = memories.select("memory_id", "project_id", "session_id", "timestamp", "memory_type", "file_references", keywords("raw_text", "compressed_summary", "semantic_summary").alias("words"), "recency_score", "importance_score")
    if cap is None:
        return _uncapped(base.drop("recency_score", "importance_score"), temporal)
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(*rank_order()))
    targets = base.withColumn("_n", place).where(F.col("_n") <= cap).drop("_n")
    pairs = base.alias("a").join(targets.alias("b"), (F.col("a.project_id") == F.col("b.project_id")) & _before("a", "b"))
    shared, given = F.size(F.array_intersect("a.words", "b.words")), _given("a.", "b.")
    rule = (
        F.when(given["session"], F.struct(F.lit("same_session").alias("relation_type"), F.lit(0.9).alias("confidence")))
        .when(given["relation"].isNotNull(), F.struct(given["relation"].alias("relation_type"), F.lit(0.7).alias("confidence")))
        .when(given["file"], F.struct(F.lit("shared_file").alias("relation_type"), F.lit(0.8).alias("confidence")))
        .when(shared >= SHARED_WORDS, F.struct(F.lit("keyword_overlap").alias("relation_type"), _overlap_confidence(shared).alias("confidence")))
    )
    if temporal:
        rule = rule.when(given["near"], F.struct(F.lit("temporal_proximity").alias("relation_type"), F.lit(0.5).alias("confidence")))
    linked = pairs.select(F.col("a.memory_id").alias("source_id"), F.col("b.memory_id").alias("target_id"), rule.alias("r")).where("r is not null")
    return linked.select("source_id", "target_id", "r.relation_type", "r.confidence")


SHARED_WORDS = 3


def _overlap_confidence(shared: Column) -> Column:
    return F.least(F.lit(0.8), 0.5 + shared * 0.05)


def _uncapped(base: DataFrame, temporal: bool) -> DataFrame:
    a, b, given = base.alias("a"), base.alias("b"), _given("a.", "b.")
    same = (F.col("a.project_id") == F.col("b.project_id")) & _before("a", "b")
    ends = (F.col("a.memory_id").alias("source_id"), F.col("b.memory_id").alias("target_id"))
    fresh = ~given["session"] & given["relation"].isNull()

    sessions = a.join(b, same & (F.col("a.session_id") == F.col("b.session_id"))).select(*ends, F.lit("same_session").alias("relation_type"), F.lit(0.9).alias("confidence"))

    kinds = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in [*RELATIONS, *((y, x) for x, y in RELATIONS)]])
    wanted = base.withColumn("other", F.explode(F.transform(F.filter(kinds, lambda p: p["x"] == F.col("memory_type")), lambda p: p["y"]))).alias("a")
    types = wanted.join(b, same & (F.col("a.other") == F.col("b.memory_type")) & ~given["session"]).select(*ends, given["relation"].alias("relation_type"), F.lit(0.7).alias("confidence"))

    files = base.drop("words").withColumn("file", F.explode(F.array_distinct("file_references")))
    shared_files = files.alias("a").join(files.alias("b"), same & (F.col("a.file") == F.col("b.file")) & fresh).select(*ends).distinct().select("*", F.lit("shared_file").alias("relation_type"), F.lit(0.8).alias("confidence"))

    sets = distinct_sets(base.select("project_id", F.col("memory_id").alias("id"), F.col("words").alias("tokens")), ("project_id",))
    found = written(similar_sets(sets, overlap=SHARED_WORDS).select("project_id", "x", "y", "shared"))
    itself = sets.sets.where(F.col("size") >= SHARED_WORDS).select("project_id", F.col("set_id").alias("x"), F.col("set_id").alias("y"), F.col("size").alias("shared"))
    own = _given("a_", "b_")
    later = F.struct("b_timestamp", "b_id") < F.struct("a_timestamp", "a_id")
    attributes = base.select("project_id", F.col("memory_id").alias("id"), "session_id", "timestamp", "memory_type", "file_references")
    worded = holders(sets, found.union(found.select("project_id", "y", "x", "shared")).union(itself), attributes, later & ~own["session"] & own["relation"].isNull() & ~own["file"])
    words = worded.select(F.col("a_id").alias("source_id"), F.col("b_id").alias("target_id"), F.lit("keyword_overlap").alias("relation_type"), _overlap_confidence(F.col("shared")).alias("confidence"))

    out = sessions.unionByName(types).unionByName(shared_files).unionByName(words)
    if not temporal:
        return out
    slot = F.floor(F.col("timestamp").cast("double") / CLOSE_SECONDS)
    slotted = base.withColumn("slot", slot).alias("b")
    around = base.withColumn("slot", F.explode(F.array(slot - 1, slot, slot + 1))).alias("a")
    few = F.size(F.array_intersect("a.words", "b.words")) < SHARED_WORDS
    close = around.join(slotted, same & (F.col("a.slot") == F.col("b.slot")) & fresh & ~given["file"] & few & given["near"])
    return out.unionByName(close.select(*ends, F.lit("temporal_proximity").alias("relation_type"), F.lit(0.5).alias("confidence")))


def shared_file_links(memories: DataFrame) -> DataFrame:
    """Pairs of one project's memories with a common file: equi-join on (project, file)."""
    files = memories.select("project_id", "memory_id", "timestamp", F.explode("file_references").alias("file"))
    a, b = files.alias("a"), files.alias("b")
    same = (F.col("a.project_id") == F.col("b.project_id")) & (F.col("a.file") == F.col("b.file")) & _before("a", "b")
    pairs = a.join(b, same).select(F.col("a.memory_id").alias("source_id"), F.col("b.memory_id").alias("target_id")).distinct()
    return pairs.withColumn("relation_type", F.lit("shared_file")).withColumn("confidence", F.lit(0.8))


def supersede_decisions(decisions: DataFrame) -> DataFrame:
    """memory_id, superseded_by: an active decision yields to the earliest later active one it conflicts with, of equally early ones to the least id.

    decisions: memory_id, project_id, timestamp, statement, file_references,
    validity.  Two conflict if their statements differ and they share a file or
    two words.  No pairs are formed: each decision is listed under its files and
    its pairs of words, and looks forward in each list to the first moment with
    another statement than its own.  Moments with one and the same statement make
    a run; as that moment begins a run, it is the next one's first or, if that
    still says the same, the first of the one after.
    """
    active = decisions.where("validity = 'active' and timestamp is not null and statement is not null and project_id is not null").withColumn("said", F.lower("statement"))
    base = active.select("memory_id", "project_id", "timestamp", "said", F.array_sort(T.words(F.col("said"))).alias("words"), "file_references")
    own = ("memory_id", "project_id", "timestamp", "said")
    first = base.select(*own, "words", F.posexplode("words").alias("at", "k1"))
    words = first.select(*own, F.lit("words").alias("kind"), "k1", F.explode(F.slice("words", F.col("at") + 2, F.size("words"))).alias("k2"))
    files = base.select(*own, F.lit("file").alias("kind"), F.explode(F.array_distinct("file_references")).alias("k1"), F.lit("").alias("k2"))
    listed = written(words.unionByName(files).where("k1 is not null"))
    key = ("project_id", "kind", "k1", "k2")
    said = listed.groupBy(*key, "timestamp", "said").agg(F.min("memory_id").alias("id"))
    least = F.min(F.struct("id", "said")).over(Window.partitionBy(*key, "timestamp"))
    moments = said.withColumn("least", least).groupBy(*key, "timestamp").agg(F.first("least.id").alias("id"), F.first("least.said").alias("said"), F.min(F.when(F.col("said") != F.col("least.said"), F.col("id"))).alias("other_id"))
    forward = Window.partitionBy(*key).orderBy("timestamp")
    only = F.when(F.col("other_id").isNull(), F.col("said"))
    begins = ~F.coalesce((F.col("only") == F.lag("only").over(forward)), F.lit(False))
    runs = moments.withColumn("only", only).withColumn("begins", begins).withColumn("run", F.sum(F.col("begins").cast("long")).over(forward))
    heads = runs.where("begins").select(*key, "run", F.struct("timestamp", "id", "said", "other_id").alias("head"))
    ahead = Window.partitionBy(*key).orderBy("run")
    after = heads.select(*key, "run", F.lead("head", 1).over(ahead).alias("next"), F.lead("head", 2).over(ahead).alias("then")).where("next is not null")
    # The list is far larger in memory than its encoded file, whose size the planner goes by: without the hints it is broadcast.
    answers = runs.select(*key, "timestamp", "run").join(after.hint("merge"), [*key, "run"]).select(*key, "timestamp", "next", "then")
    met = listed.join(answers.hint("merge"), [*key, "timestamp"])
    still = F.col("next.other_id").isNull() & (F.col("next.said") == F.col("said"))
    head = F.when(still, F.col("then")).otherwise(F.col("next"))
    yields = met.withColumn("head", head).where("head is not null").select("memory_id", F.col("head.timestamp").alias("at"), F.when(F.col("head.said") != F.col("said"), F.col("head.id")).otherwise(F.col("head.other_id")).alias("newer"))
    return yields.groupBy("memory_id").agg(F.min_by("newer", F.struct("at", "newer")).alias("superseded_by"))


def detect_contradictions(memories: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs of one project and type (decision, fact, requirement), both active, whose best word Jaccard + 0.2 exceeds the threshold.

    A memory holds the word sets of its texts; sets of one project and type are
    joined exactly over prefixes of rare words, equal ones once.
    """
    texts = F.array(*[T.words(F.col(c)) for c in ("raw_text", "compressed_summary", "semantic_summary")])
    base = memories.where("memory_type in ('decision', 'fact', 'requirement') and validity = 'active'")
    by = ("project_id", "memory_type")
    sets = distinct_sets(base.select(*by, F.col("memory_id").alias("id"), F.explode(texts).alias("tokens")), by)
    found = written(similar_sets(sets, jaccard=max(0.3, threshold - 0.2) - SLACK).withColumn("similarity", F.col("shared") / (F.col("size_x") + F.col("size_y") - F.col("shared"))).select(*by, "x", "y", "similarity"))
    itself = sets.sets.select(*by, F.col("set_id").alias("x"), F.col("set_id").alias("y"), F.lit(1.0).alias("similarity"))
    pairs = holders(sets, found.union(found.select(*by, "y", "x", "similarity")).union(itself), when=F.col("a_id") < F.col("b_id"))
    best = pairs.groupBy("a_id", "b_id").agg(F.max("similarity").alias("similarity")).where("similarity > 0.3")
    return best.withColumn("confidence", F.least(F.lit(1.0), F.col("similarity") + 0.2)).where(F.col("confidence") > threshold)


def _stored_links(memories: DataFrame) -> DataFrame:
    """(memory_id, next) from the link arrays that memories carry themselves."""
    held = [c for c in ("dependency_links", "contradiction_links") if c in memories.columns]
    none = F.array().cast("array<string>")
    return memories.select("memory_id", F.explode(F.concat(none, *[F.coalesce(c, none) for c in held])).alias("next"))


def expand_graph(seeds: DataFrame, links: DataFrame, max_hops: int = 2, relation_types: list[str] | None = None, memories: DataFrame | None = None) -> DataFrame:
    """(group_id, memory_id) reached from each group's seeds over links in both directions, in rounds 0..max_hops-1.

    Seeds may have a ``hops`` column, each group's own number of rounds.  With
    ``memories``, what these carry as dependency and contradiction links of the
    nodes reached is added at the end, as far as it exists.
    """
    if relation_types is not None:
        links = links.where(F.col("relation_type").isin(relation_types))
    edges = links.select(F.col("source_id").alias("node"), F.col("target_id").alias("next")).union(links.select("target_id", "source_id"))
    hops = F.col("hops") if "hops" in seeds.columns else F.lit(max_hops)
    visited = walk(seeds.select(F.col("group_id").alias("group"), F.col("memory_id").alias("node"), hops.alias("hops")), edges, max_hops).select(F.col("group").alias("group_id"), F.col("node").alias("memory_id"))
    if memories is None:
        return visited
    stored = visited.join(_stored_links(memories), "memory_id").select("group_id", F.col("next").alias("memory_id"))
    return visited.union(stored.join(memories.select("memory_id"), "memory_id", "left_semi").select("group_id", "memory_id")).distinct()


def neighbors(memories: DataFrame, links: DataFrame) -> DataFrame:
    """(memory_id, neighbor_id) over links in both directions and the links that memories carry, ends that exist only."""
    both = links.select(F.col("source_id").alias("memory_id"), F.col("target_id").alias("neighbor_id")).union(links.select("target_id", "source_id")).union(_stored_links(memories)).distinct()
    ids = memories.select("memory_id")
    return both.join(ids, "memory_id", "left_semi").join(ids.withColumnRenamed("memory_id", "neighbor_id"), "neighbor_id", "left_semi").select("memory_id", "neighbor_id")


def link_quality(memories: DataFrame, links: DataFrame) -> DataFrame:
    """Per relation: links, and those with two or more of same session, shared file, two shared keywords, both times known."""
    base = memories.select("memory_id", "session_id", "timestamp", "file_references", keywords("raw_text", "compressed_summary", "semantic_summary").alias("words"))
    ends = links.join(base.alias("a"), F.col("source_id") == F.col("a.memory_id")).join(base.alias("b"), F.col("target_id") == F.col("b.memory_id"))
    signs = [
        F.coalesce(F.col("a.session_id") == F.col("b.session_id"), F.lit(False)), F.coalesce(F.arrays_overlap("a.file_references", "b.file_references"), F.lit(False)),
        F.size(F.array_intersect("a.words", "b.words")) >= 2, F.col("a.timestamp").isNotNull() & F.col("b.timestamp").isNotNull(),
    ]
    good = sum((s.cast("int") for s in signs[1:]), signs[0].cast("int")) >= 2
    return ends.groupBy("relation_type").agg(F.count("*").alias("n"), F.count_if(good).alias("n_good"))


def link_recall(memories: DataFrame, links: DataFrame) -> DataFrame:
    """One row: expected pairs (one project, and one session or two files in common) and those linked.

    Expected pairs are counted, not formed: n(n-1)/2 for each session, and for
    each two file sets with two common files the product of their holders,
    without those of one session.  Only links are looked up pair by pair.
    """
    ids = memories.select("memory_id", "project_id", "session_id", F.array_distinct("file_references").alias("files")).where("project_id is not null")
    half = lambda n: n * (n - 1) / 2
    sessions = ids.where("session_id is not null").groupBy("project_id", "session_id").count().agg(F.sum(half(F.col("count"))).alias("n"))
    sets = distinct_sets(ids.where("size(files) >= 2").select("project_id", F.struct("memory_id", "session_id").alias("id"), F.col("files").alias("tokens")), ("project_id",))
    held = written(sets.members.groupBy("project_id", "set_id", F.col("id.session_id").alias("session_id")).agg(F.count("*").alias("n")))
    totals = held.groupBy("project_id", "set_id").agg(F.sum("n").alias("n"))
    alone = totals.agg(F.sum(half(F.col("n"))).alias("n")).union(held.where("session_id is not null").agg(-F.sum(half(F.col("n")))))
    met = written(similar_sets(sets, overlap=2).select("project_id", "x", "y"))
    named = lambda t, n: t.withColumnRenamed("set_id", n).withColumnRenamed("n", f"n_{n}")
    across = met.join(named(totals, "x"), ["project_id", "x"]).join(named(totals, "y"), ["project_id", "y"]).agg(F.sum(F.col("n_x") * F.col("n_y")).alias("n"))
    inside = met.join(named(held, "x"), ["project_id", "x"]).join(named(held, "y"), ["project_id", "y", "session_id"]).agg(-F.sum(F.col("n_x") * F.col("n_y")))
    expected = sessions.union(alone).union(across).union(inside).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("expected"))
    linked = links.select(F.least("source_id", "target_id").alias("x"), F.greatest("source_id", "target_id").alias("y")).where("x < y").distinct()
    ends = linked.join(ids.alias("a"), F.col("x") == F.col("a.memory_id")).join(ids.alias("b"), (F.col("y") == F.col("b.memory_id")) & (F.col("a.project_id") == F.col("b.project_id")))
    good = (F.col("a.session_id") == F.col("b.session_id")) | (F.size(F.array_intersect("a.files", "b.files")) >= 2)
    return expected.join(F.broadcast(ends.where(good).agg(F.count("*").alias("found"))))  # two rows of totals
