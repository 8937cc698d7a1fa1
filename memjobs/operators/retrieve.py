"""Retrieval and ranking for whole tables of requests: BM25, vectors, metadata lists, fusion, rerank, budgets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memjobs.functions import text as T
from memjobs.operators.ledger import any_contains, rank_order, top_memories
from memjobs.operators.vectors import ranked, vector_candidates, vector_search
from memjobs.sources.tables import dealt, written

# BM25 parameters; floor of negative idf as a share of the mean.
K1, B, FLOOR = 1.5, 0.75, 0.25


def postings(memories: DataFrame, unique: bool = False) -> DataFrame:
    """(memory_id, project_id, term, tf, length) of each text: semantic, else compressed, else raw.

    A text's terms are counted in its row: sorted, each starts where the one before differs.
    With ``unique`` ids nothing is shuffled; else rows of one id, project and length are counted together.
    """
    text = F.coalesce(F.nullif("semantic_summary", F.lit("")), F.nullif("compressed_summary", F.lit("")), "raw_text") if "semantic_summary" in memories.columns else F.col("raw_text")
    tokens = memories.select("memory_id", "project_id", F.sort_array(T.tokenize(text)).alias("tokens"))
    places = F.when(F.size("tokens") > 0, F.sequence(F.lit(0), F.size("tokens") - 1))
    starts = F.filter(places, lambda i: (i == 0) | (F.get("tokens", i) != F.get("tokens", i - 1)))
    rows = tokens.select("memory_id", "project_id", F.size("tokens").alias("length"), "tokens", starts.alias("starts"))
    terms = F.transform("starts", lambda i, j: F.struct(F.get("tokens", i).alias("term"), (F.coalesce(F.get("starts", j + 1), F.col("length")) - i).cast("long").alias("tf")))
    # The outer form keeps the optimizer from copying the tokens' whole expression into a filter on their number.
    out = rows.select("memory_id", "project_id", "length", F.explode_outer(terms).alias("x")).where("x is not null").select("memory_id", "project_id", "length", "x.term", "x.tf")
    return out if unique else out.groupBy("memory_id", "project_id", "length", "term").agg(F.sum("tf").alias("tf"))


def term_stats(index: DataFrame, n_docs: int) -> DataFrame:
    """term, df, idf; negative idf is lifted to a share of the mean idf."""
    df = written(index.groupBy("term").agg(F.count("*").alias("df")))
    raw = df.withColumn("raw", F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))  # one row


BLOCK_DOCS = 8  # memories of a block, on average
FIRST_BLOCKS = 8  # blocks of a request that are scored before the rest is judged


@dataclass
class Index:
    """Postings and term statistics as written tables, and two totals: made once, searched often."""

    postings: DataFrame
    stats: DataFrame
    mean_length: float
    n_docs: int

    def block(self) -> Column:
        return F.pmod(F.xxhash64("memory_id"), F.lit(max(1, self.n_docs // BLOCK_DOCS)))

    def weight(self) -> Column:
        return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / self.mean_length))


def bm25_index(memories: DataFrame) -> Index:
    """Texts are dealt over tasks before they are split: a file of few row groups would else be tokenized by as few."""
    n_docs, n_ids = memories.agg(F.count("*"), F.countDistinct("memory_id")).first()
    texts = [c for c in ("semantic_summary", "compressed_summary", "raw_text") if c in memories.columns]
    index = written(postings(dealt(memories.select("memory_id", "project_id", *texts), "memory_id"), unique=n_ids == n_docs))
    words = index.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
    return Index(index, written(term_stats(index, n_docs)), words / max(1, n_docs), n_docs)


def _asked(index: Index, requests: DataFrame) -> DataFrame:
    terms = requests.select("request_id", F.col("project_id").alias("asked_project"), F.explode(T.tokenize(F.col("query"))).alias("term")).groupBy("request_id", "asked_project", "term").agg(F.count("*").alias("qtf"))
    return terms.join(index.stats, "term")


def _scored(index: Index, met: DataFrame) -> DataFrame:
    return met.groupBy("request_id", "memory_id").agg(F.round(F.sum(F.col("qtf") * F.col("idf") * index.weight()), 6).alias("score")).where("score > 0")


MOST_ASKED = 1_000_000  # rows of asked terms up to which these are broadcast


def _meet(rows: DataFrame, asked: DataFrame, by: str, on: tuple[str, ...] = ("term",)) -> DataFrame:
    """Postings and asked terms; where these are few, rows with one ``by`` come together before they are multiplied, so that what is summed for it needs no other shuffle."""
    if asked.count() > MOST_ASKED:
        terms = asked.select("term").distinct()  # few, unless requests have texts of their own: then no posting of another term is shuffled
        held = rows.join(F.broadcast(terms), "term", "left_semi") if terms.count() <= MOST_ASKED else rows
        return held.join(asked, list(on))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = rows.join(F.broadcast(asked.select(*on).distinct()), list(on), "left_semi")
    return held.repartition(tasks, by).join(F.broadcast(asked), list(on))


def _scored_in_all(index: Index, asked: DataFrame) -> DataFrame:
    return _scored(index, _meet(index.postings, written(asked), "memory_id"))


def bm25_search(memories: DataFrame, requests: DataFrame, k: int = 50, scope: str = "project", index: Index | None = None) -> DataFrame:
    """request_id, memory_id, score, rank: the best k of each request.

    requests: request_id, project_id, query.  Scope ``project`` scores the
    request's project only; ``global`` scores all memories, by statistics of
    all memories either way.  Postings meet query terms by an equi-join, so
    only terms that are asked for are scored.  In scope ``global`` requests of
    the same terms are scored once, as all of them find the same rows.
    """
    index = index or bm25_index(memories)
    if scope != "global":
        asked = written(_asked(index, requests).withColumnRenamed("asked_project", "project_id"))
        return ranked(_scored(index, _meet(index.postings, asked, "memory_id", ("project_id", "term"))), k)
    said = written(requests.select("request_id", F.sha2(F.array_join(F.array_sort(T.tokenize(F.col("query"))), " "), 256).alias("text_id"), "query"))
    once = said.groupBy(F.col("text_id").alias("request_id")).agg(F.first("query").alias("query"), F.lit(None).cast("string").alias("project_id"))
    found = written(ranked(_scored_in_all(index, _asked(index, once)), k).withColumnRenamed("request_id", "text_id"))
    return said.select("request_id", "text_id").join(found, "text_id").select("request_id", "memory_id", "score", "rank")


@dataclass
class Pruned:
    """``found``: as of ``bm25_search``.  ``read``: (request_id, postings, read), how many postings its terms have and how many were scored."""

    found: DataFrame
    read: DataFrame


def bm25_pruned(index: Index, requests: DataFrame, k: int = 50) -> Pruned:
    """The same rows as ``bm25_search`` in all memories, without scoring blocks of memories that can't reach them.

    A block's bound for a request is the sum of its terms' largest weights there.
    The blocks with the highest bounds are scored first; the k-th best score
    found is what any other block's bound has to reach, ties included.  Rare
    terms lie in few blocks, so most blocks have the bounds of common terms only.
    """
    asked = written(_asked(index, requests).select("request_id", "term", "qtf", "idf"))
    rows = index.postings.select("memory_id", "term", "tf", "length", index.block().alias("block"))
    few = asked.count() <= MOST_ASKED
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = rows.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi").repartition(tasks, "block") if few else rows
    tops = held.groupBy("term", "block").agg(F.max(index.weight()).alias("top"), F.count("*").alias("n"))
    bound = F.sum(F.greatest(F.lit(0.0), F.col("qtf") * F.col("idf") * F.col("top")))
    bounds = written(tops.join(F.broadcast(asked) if few else asked, "term").groupBy("request_id", "block").agg(bound.alias("bound"), F.sum("n").alias("n")))
    order = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("bound"), "block"))
    leading = written(bounds.withColumn("place", order).where(F.col("place") <= FIRST_BLOCKS).select("request_id", "block", "n"))

    def scored(blocks: DataFrame) -> DataFrame:
        if not few:
            return written(_scored(index, rows.join(asked.join(blocks.select("request_id", "block"), "request_id"), ["term", "block"])))
        asking = blocks.groupBy("block").agg(F.collect_set("request_id").alias("asking"))
        met = _meet(rows, asked, "block").join(asking.hint("shuffle_hash"), "block").where(F.array_contains("asking", F.col("request_id")))
        return written(met.groupBy("block", "request_id", "memory_id").agg(F.round(F.sum(F.col("qtf") * F.col("idf") * index.weight()), 6).alias("score")).where("score > 0").select("request_id", "memory_id", "score"))

    first = scored(leading)
    least = ranked(first, k).where(F.col("rank") == k).select("request_id", F.col("score").alias("least"))
    rest = written(bounds.join(leading, ["request_id", "block"], "left_anti").join(least, "request_id", "left").where("least is null or bound >= least - 1e-5").select("request_id", "block", "n"))
    found = ranked(ranked(first, k).drop("rank").union(ranked(scored(rest), k).drop("rank")), k)
    totals = bounds.groupBy("request_id").agg(F.sum("n").alias("postings"))
    taken = leading.union(rest).groupBy("request_id").agg(F.sum("n").alias("read"))
    read = totals.join(taken, "request_id", "left").select("request_id", "postings", F.coalesce("read", F.lit(0)).alias("read"))
    return Pruned(found, read)


# Task keywords in their order of use.
TASK_WORDS = {
    "debugging": ("debug", "fix", "error", "bug", "fail", "traceback", "exception", "crash"),
    "architecture": ("architect", "design", "refactor", "structure", "adr", "pattern"),
    "feature": ("implement", "feature", "add ", "create ", "build ", "develop"),
    "research": ("research", "investigate", "explore", "compare", "analyze"),
}


def classify_task(query: Column) -> Column:
    low = F.lower(F.coalesce(query, F.lit("")))
    out = F.lit("general")
    for task, words in reversed(TASK_WORDS.items()):
        out = F.when(any_contains(low, words), task).otherwise(out)
    return out


HOPS = 2
NEEDS = {"session": True, "project": True, "decisions": True, "errors": True, "code": True, "graph": False}


def make_plan(requests: DataFrame) -> DataFrame:
    """requests (request_id, query, requirements map<string,boolean>, optional max_graph_hops) with ``task``, a boolean for each need, and ``hops``."""
    task = classify_task(F.col("query"))
    own = {n: F.coalesce(F.try_element_at("requirements", F.lit(f"include_{n}")), F.lit(default)) for n, default in NEEDS.items()}
    debugging, architecture, feature, research = (task == t for t in TASK_WORDS)
    own["errors"] = own["errors"] | debugging
    own["decisions"] = own["decisions"] | debugging | architecture | feature
    own["code"] = (own["code"] | debugging | feature) & ~(architecture | research)
    own["project"] = own["project"] | research
    hops = F.coalesce("max_graph_hops", F.lit(HOPS)) if "max_graph_hops" in requests.columns else F.lit(HOPS)
    return requests.withColumn("task", task).withColumns({f"needs_{n}": c for n, c in own.items()} | {"hops": hops})


# Metadata lists in order: (type, rows, need).
LISTS = (("decision", 30, "decisions"), ("error", 30, "errors"), ("intent", 20, None), ("requirement", 20, None), ("code_change", 15, "code"))
SESSION_ROWS, RECENT = 20, 5


def metadata_candidates(plans: DataFrame, memories: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """request_id, memory_id, position: the session's recent decisions and errors, its best rows, then lists by type.

    states: session_id, recent_decisions, recent_errors (arrays of ids, oldest
    first).  The lists by type are ranked in one window over (project, type).
    """
    parts = []
    if "session_id" in plans.columns:
        inside = plans.where("needs_session and session_id is not null")
        if states is not None:
            known = memories.select("memory_id")
            for place, name in ((-2, "recent_decisions"), (-1, "recent_errors")):
                last = F.slice(name, F.greatest(F.size(name) - RECENT + 1, F.lit(1)), F.lit(RECENT))
                told = inside.select("request_id", "session_id").join(states, "session_id").select("request_id", F.posexplode(last).alias("at", "memory_id"))
                parts.append(told.join(known, "memory_id", "left_semi").select("request_id", "memory_id", F.lit(place).alias("list"), (F.col("at") + 1).alias("rank")))
        best = top_memories(memories, ("session_id",), k=SESSION_ROWS).select("session_id", "memory_id", F.lit(0).alias("list"), "rank")
        parts.append(inside.join(best, "session_id").select("request_id", "memory_id", "list", "rank"))
    place = most = F.lit(None).cast("int")
    wanted = F.lit(False)
    for i, (kind, k, need) in enumerate(LISTS, 1):
        place, most = (F.when(F.col("memory_type") == kind, v).otherwise(c) for v, c in ((i, place), (k, most)))
        wanted = wanted | ((F.col("list") == i) & (F.lit(True) if need is None else F.col(f"needs_{need}")))
    listed = memories.select("memory_id", "project_id", "memory_type", "recency_score", "importance_score", "timestamp", place.alias("list"), most.alias("most")).where("list is not null")
    rank = F.row_number().over(Window.partitionBy("project_id", "memory_type").orderBy(*rank_order()))
    listed = listed.withColumn("rank", rank).where(F.col("rank") <= max(k for _, k, _ in LISTS)).where("rank <= most")
    parts.append(plans.join(listed.select("project_id", "memory_id", "list", "rank"), "project_id").where(wanted).select("request_id", "memory_id", "list", "rank"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    position = F.row_number().over(Window.partitionBy("request_id").orderBy("list", "rank"))
    return rows.select("request_id", "memory_id", position.alias("position"))


def rrf(lists: DataFrame, k: int = 60, top: int = 100) -> DataFrame:
    """lists (request_id, memory_id, list, rank from 1) -> the best by the sum of 1/(k + rank); ties by first appearance, then id."""
    fused = lists.groupBy("request_id", "memory_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc(F.round("score", 12)), "first", "memory_id"))
    return fused.withColumn("place", place).where(F.col("place") <= top).drop("first")


# Boosts by task and type, penalties by validity, stability.
BOOSTS = {("debugging", "error"): 0.3, ("debugging", "decision"): 0.15, ("debugging", "code_change"): 0.1, ("architecture", "decision"): 0.3, ("architecture", "requirement"): 0.2, ("feature", "code_change"): 0.2, ("feature", "decision"): 0.15}
PENALTIES = {"superseded": 0.5, "rejected": 0.8}
STABLE = {"canonical": 0.1, "stable": 0.05}


def _by_value(column: Column, values: dict, default: float) -> Column:
    out = F.lit(default)
    for v, x in values.items():
        out = F.when(column == v, x).otherwise(out)
    return out


def rerank_recency_importance(candidates: DataFrame) -> DataFrame:
    """candidates (task, base, and a memory's columns) with ``score``."""
    boost = F.lit(0.0)
    for (task, kind), x in BOOSTS.items():
        boost = F.when((F.col("task") == task) & (F.col("memory_type") == kind), x).otherwise(boost)
    score = 0.35 * F.coalesce("base", F.lit(0.5)) + 0.15 * F.col("recency_score") + 0.2 * F.col("importance_score") + 0.1 * F.col("confidence_score") + boost
    score = score + _by_value(F.col("stability"), STABLE, 0.0) - _by_value(F.col("validity"), PENALTIES, 0.0)
    return candidates.withColumn("score", F.greatest(F.lit(0.0), score))


def rerank_score(candidates: DataFrame) -> DataFrame:
    """candidates (task, query, memory columns; optional relevance) with ``score``; relevance is else the share of query words found."""
    text = F.coalesce("semantic_summary", "compressed_summary", "raw_text")
    asked = T.words(F.col("query"))
    overlap = F.size(F.array_intersect(asked, T.words(text))) / F.greatest(F.size(asked), F.lit(1))
    relevance = F.coalesce(F.col("relevance"), overlap) if "relevance" in candidates.columns else overlap
    affinity = F.when((F.col("task") == "debugging") & F.col("memory_type").isin("error", "decision"), 1.0).otherwise(0.5)
    contradictions = F.coalesce(F.col("n_contradictions"), F.lit(0)) if "n_contradictions" in candidates.columns else F.lit(0)
    score = (
        0.25 * relevance + 0.15 * F.col("importance_score") + 0.1 * F.col("recency_score") + 0.15 * _by_value(F.col("stability"), {"canonical": 1.0, "stable": 0.7}, 0.3) + 0.1 * F.col("confidence_score")
        + 0.1 * affinity + 0.05 - 0.1 * F.when(F.col("validity") == "superseded", 1.0).otherwise(0.0) - 0.1 * F.least(contradictions * 0.1, F.lit(0.5))
    )
    return candidates.withColumn("score", F.greatest(F.lit(0.0), score))


INACTIVE = ("superseded", "rejected", "archived")


def _of_project(found: DataFrame, requests: DataFrame, memories: DataFrame) -> DataFrame:
    """Of rows found in all projects, those of the request's own, ranked anew."""
    own = found.join(memories.select("memory_id", "project_id"), "memory_id").join(requests.select("request_id", "project_id"), ["request_id", "project_id"])
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy("rank")))


def retrieve(
    requests: DataFrame, memories: DataFrame, links: DataFrame | None = None, k: int = 50, vectors: DataFrame | None = None, states: DataFrame | None = None, index: Index | None = None, scope: str = "project"
) -> DataFrame:
    """request_id, memory_id, score, rank: vector, BM25 and metadata lists, fused, expanded over links for plans that want it, reranked.

    requests: request_id, project_id, query, requirements, optional session_id,
    max_graph_hops and vector.  vectors (memory_id, project_id, vector) add the
    vector list, states (session_id, recent ids) the session's recent rows.

    With scope ``project`` each list holds the best 50 of the request's project;
    with ``global`` the best 50 of all memories, of which those of the project
    stay, so a request may find few.
    """
    plans = make_plan(requests)
    inside = plans.where("needs_project")
    words = bm25_search(memories, inside, 50, scope, index)
    lists = (words if scope == "project" else _of_project(words, inside, memories)).select("request_id", "memory_id", F.lit(0).alias("list"), "rank")
    if vectors is not None:
        near = vector_candidates(vectors, inside, 50) if scope == "project" else _of_project(vector_search(vectors, inside, 50), inside, memories)
        lists = lists.union(near.select("request_id", "memory_id", F.lit(-1).alias("list"), "rank"))
    metadata = metadata_candidates(plans, memories, states).select("request_id", "memory_id", F.lit(1).alias("list"), F.col("position").alias("rank"))
    fused = rrf(lists.union(metadata)).select("request_id", "memory_id", F.col("score").alias("base"), "place")
    if links is None:
        fused = fused.select("request_id", "memory_id", "base")
    else:
        from memjobs.operators.links import expand_graph

        fused = written(fused)
        graph = plans.where("needs_graph and hops > 0").select("request_id", "hops")
        seeds = fused.where("place <= 10").join(graph, "request_id").select(F.col("request_id").alias("group_id"), "memory_id", "hops")
        most = graph.agg(F.max("hops")).first()[0] or 0
        more = expand_graph(seeds, links, most, memories=memories).select(F.col("group_id").alias("request_id"), "memory_id").join(fused, ["request_id", "memory_id"], "left_anti")
        fused = fused.select("request_id", "memory_id", "base").union(more.select("request_id", "memory_id", F.lit(0.5)))
    found = fused.join(memories.drop("project_id", "session_id"), "memory_id").where(~F.col("validity").isin(*INACTIVE)).join(plans.select("request_id", "task"), "request_id")
    scored = rerank_recency_importance(found).withColumn("score", F.round("score", 9))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "memory_id"))
    return scored.select("request_id", "memory_id", "score", place.alias("rank")).where(F.col("rank") <= k)


def suppress_stale_facts(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """Candidates whose text holds none of their request's stale facts (request_id, fact); case is ignored."""
    text = F.lower(F.concat_ws(" ", "raw_text", "compressed_summary"))
    own = facts.groupBy("request_id").agg(F.collect_set(F.lower("fact")).alias("_facts"))
    joined = candidates.join(own, "request_id", "left")
    return joined.where(~F.coalesce(F.exists("_facts", lambda f: text.contains(f)), F.lit(False))).drop("_facts")


# Words in front of the query, by task.
VARIANTS = {"debugging": ("error bug fix", "traceback exception"), "architecture": ("design decision ADR",), "feature": ("implement requirement",)}


def expand_query(requests: DataFrame) -> DataFrame:
    """(request_id, variant, query): the query and up to two more with words of its task."""
    task = classify_task(F.col("query"))
    more = F.array()
    for name, words in VARIANTS.items():
        more = F.when(task == name, F.array(*[F.concat(F.lit(f"{w} "), F.col("query")) for w in words])).otherwise(more.cast("array<string>"))
    return requests.select("request_id", F.posexplode(F.concat(F.array("query"), more)).alias("variant", "query"))


# Hundredths of the budget by section and task, and learned multipliers.
SECTIONS = ("system_task", "session_state", "decisions", "errors", "code_context", "requirements", "graph_paths", "procedures", "open_questions", "buffer")
SHARES = {
    "debugging": (0.04, 0.03, 0.08, 0.10, 0.15, 0.04, 0.03, 0.02, 0.02, 0.49),
    "architecture": (0.04, 0.03, 0.15, 0.02, 0.08, 0.10, 0.05, 0.02, 0.02, 0.49),
    "feature": (0.04, 0.03, 0.08, 0.02, 0.15, 0.10, 0.03, 0.02, 0.02, 0.51),
    "research": (0.04, 0.02, 0.06, 0.02, 0.08, 0.06, 0.05, 0.02, 0.03, 0.62),
}
LEARNED = {"requirements": 0.85, "decisions": 0.9, "errors": 0.85, "code_context": 0.9, "procedures": 0.8, "open_questions": 0.8, "graph_paths": 0.8}


def token_budget(requests: DataFrame, learned: bool = True) -> DataFrame:
    """requests (request_id, task, token_budget) with a column of tokens for each section; what is left goes to the buffer."""
    total = F.col("token_budget")
    out = {}
    for i, section in enumerate(SECTIONS[:-1]):
        share = F.lit(SHARES["feature"][i])
        for task, shares in SHARES.items():
            share = F.when(F.col("task") == task, shares[i]).otherwise(share)
        part = F.floor(total * share)
        if learned:
            factor = F.lit(LEARNED.get(section, 1.0))
            if section == "errors":
                factor = F.when(F.col("task") == "debugging", 1.0).otherwise(factor)
            part = F.floor(part * factor)
        out[section] = part
    spent = sum(out.values(), F.lit(0))
    return requests.select("request_id", *[c.alias(s) for s, c in out.items()], (total - spent).alias("buffer"))


def conversation_requests(conversations: DataFrame) -> DataFrame:
    """conv_id, query: the last user message of each conversation, or an empty text."""
    said = F.when(F.col("role") == "user", F.col("text"))
    return conversations.groupBy("conv_id").agg(F.coalesce(F.max_by(said, F.when(F.col("role") == "user", F.col("turn"))), F.lit("")).alias("query"))


def inject_packs(conversations: DataFrame, packs: DataFrame) -> DataFrame:
    """The conversations with each pack (conv_id, text, sufficiency) in front, as a system turn -1."""
    head = F.concat(F.lit("[context, sufficiency "), F.format_number("sufficiency", 2), F.lit("]\n"), F.col("text"))
    front = packs.select("conv_id", F.lit(-1).cast("bigint").alias("turn"), F.lit("system").alias("role"), head.alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(front)
