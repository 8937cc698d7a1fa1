"""Context packs: the budgeted fill of a request's candidates, baselines, sufficiency and prompts.

A pack is built by expressions alone.  A request's candidates (a bounded list)
are one array; a task's sections are an array too.  Their product, in order, is
folded once: the state of the fold is what the pack holds so far.  Rescue and
trimming are two more folds over short arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memjobs.functions import text as T
from memjobs.operators import extract
from memjobs.operators.health import normalised
from memjobs.operators.ledger import any_contains, top_memories
from memjobs.operators.retrieve import token_budget, vector_candidates

SECTION = "array<struct<name:string,content:string,memory_ids:array<string>,tokens:int>>"
PLACED = "array<struct<ord:int,id:string,body:string,tokens:int>>"
WORDS = "array<string>"
# The texts of a pack's warnings.
FILTERED = "Filtered %d stale/superseded/rejected memories from pack."
RESCUED = "Rescued %d memories for protected terms."
CUT = "Trimmed %s to stay under %d tokens."
MOST = 50  # candidates of a request
INACTIVE = ("stale", "superseded", "rejected")

# The first sections by task as (name, types, most items); fillers after them as (name, types, budget).
FIRST = {
    "debugging": (("errors", ("error",), 2), ("decisions", ("decision",), 2), ("code_context", ("code_change",), 1)),
    "architecture": (("decisions", ("decision",), 2), ("requirements", ("requirement",), 1)),
    "": (("decisions", ("decision",), 2), ("errors", ("error",), 2), ("code_context", ("code_change",), 1)),
}
FILLERS = (("goals", ("goal",), 20), ("requirements", ("requirement",), 14), ("intents", ("intent",), 12), ("reflections", ("reflection",), 12), ("open_questions", ("uncertainty", "task"), 12))
RANKED_TYPES = ("decision", "error", "intent", "requirement", "goal")
COMPACT = (("state", ("goal", "requirement", "intent"), 40), ("context", ("decision", "error"), 25), ("code", ("code_change",), 20))
# Sections that may be trimmed, tokens for rescued rows, words of a query about something broken.
TRIMMED = ("intents", "reflections", "procedures", "facts", "open_questions")
RESCUE = 22


BROKEN = ("debug", "fix", "error", "bug", "crash", "test fail", "broken")


def _sections(task: Column, query: Column, compact: bool) -> Column:
    """The sections of a task's pack, in order; ``always``: shown without any row too."""

    def one(place: int, name: str, types: tuple, budget: Column, items: int, always: Column, cap: int | None = None) -> Column:
        return F.struct(
            F.lit(place).alias("ord"), F.lit(name).alias("name"), F.array(*map(F.lit, types)).alias("types"), F.lit(types[0] in RANKED_TYPES).alias("ranked"),
            budget.cast("int").alias("budget"), F.lit(items).alias("items"), F.lit(cap).cast("int").alias("cap"), always.alias("always"),
        )

    shown = F.lit(True)
    if compact:
        return F.array(*[one(i, n, types, F.lit(b), 3, shown, 80) for i, (n, types, b) in enumerate(COMPACT)])

    def of(name: str) -> Column:
        about_code = shown if name == "debugging" else any_contains(F.lower(query), BROKEN)
        out = [one(i, n, types, F.col(n), items, about_code if n == "code_context" else shown) for i, (n, types, items) in enumerate(FIRST[name])]
        for n, types, b in FILLERS:
            budget = F.least(F.col("requirements"), F.lit(b)) if n == "requirements" else F.lit(b)
            out.append(one(len(out), n, types, budget, 1, F.lit(False)))
        return F.array(*out)

    out = of("")
    for name in FIRST:
        if name:
            out = F.when(task == name, of(name)).otherwise(out)
    return out


def _offers(sections: Column, live: Column, room: Column, scale: Column) -> Column:
    """What each section is offered, in the order in which it is looked at."""

    def offered(s: Column) -> Column:
        fits = F.filter(live, lambda c: F.array_contains(s["types"], c["type"]))
        worth = lambda c: F.when(s["ranked"], -(0.6 * c["importance"] + 0.4 * c["recency"])).otherwise(0.0)
        keyed = F.array_sort(F.transform(fits, lambda c: F.struct(worth(c).alias("worth"), F.array_position(s["types"], c["type"]).alias("type_place"), c["rank"].alias("rank"), c.alias("c"))))
        width = lambda c: F.coalesce(s["cap"], (F.when(F.size(c["keywords"]) > 0, 100).otherwise(72) * scale).cast("int"))
        return F.transform(keyed, lambda k: F.struct(s["ord"].alias("ord"), s["budget"].alias("budget"), (s["items"] + room).alias("items"), k["c"]["id"].alias("id"), k["c"]["text_key"].alias("text_key"), k["c"]["body"].substr(F.lit(1), width(k["c"])).alias("body")))

    return F.flatten(F.transform(sections, offered))


def _fill(offers: Column) -> Column:
    """The placed rows: a section takes unseen rows until one is over its budget or its items are full."""
    none = F.array().cast(WORDS)
    start = F.struct(F.lit(-1).alias("ord"), F.lit(0).alias("used"), F.lit(0).alias("taken"), F.lit(False).alias("closed"), none.alias("texts"), F.array().cast(PLACED).alias("placed"))

    def step(state: Column, x: Column) -> Column:
        same = state["ord"] == x["ord"]
        used, taken = (F.when(same, state[n]).otherwise(0) for n in ("used", "taken"))
        closed = same & state["closed"]
        seen = F.exists(state["placed"], lambda r: r["id"] == x["id"]) | ((x["text_key"] != "") & F.array_contains(state["texts"], x["text_key"]))
        n = T.estimate_tokens(x["body"])
        looked = ~closed & ~seen
        fits = looked & (used + n <= x["budget"])
        return F.struct(
            x["ord"].alias("ord"), F.when(fits, used + n).otherwise(used).alias("used"), F.when(fits, taken + 1).otherwise(taken).alias("taken"),
            (closed | (looked & ~fits) | (fits & (taken + 1 >= x["items"]))).alias("closed"),
            F.when(looked, F.concat(state["texts"], F.array(x["text_key"]))).otherwise(state["texts"]).alias("texts"),
            F.when(fits, F.concat(state["placed"], F.array(F.struct(x["ord"].alias("ord"), x["id"].alias("id"), x["body"].alias("body"), n.alias("tokens"))))).otherwise(state["placed"]).alias("placed"),
        )

    return F.aggregate(offers, start, step, lambda state: state["placed"])


def _section(name: Column | str, content: Column, ids: Column, tokens: Column) -> Column:
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), content.alias("content"), ids.alias("memory_ids"), tokens.cast("int").alias("tokens"))


def _total(rows: Column) -> Column:
    return F.aggregate(rows, F.lit(0), lambda n, r: n + r["tokens"])


def _rescued(every: Column, placed: Column, text: Column, required: Column) -> Column:
    """Rows for terms that the pack lost: by term, the most important unused holder, within ``RESCUE`` tokens.

    Keywords of unused rows come first; a required term that is no row's
    keyword is held by the first row that mentions it.
    """
    unused = F.filter(every, lambda c: ~F.exists(placed, lambda r: r["id"] == c["id"]))

    def held(c: Column, terms: Column, by_keyword: bool) -> Column:
        order = -c["importance"] if by_keyword else F.lit(0.0)
        return F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(0 if by_keyword else 1).alias("kind"), order.alias("order"), c["rank"].alias("rank"), c["id"].alias("id"), c["body"].alias("body")))

    lost = lambda terms: F.filter(F.transform(terms, F.lower), lambda t: ~F.contains(text, t))
    told = F.transform(unused, lambda c: held(c, lost(c["keywords"]), True))
    mentioned = F.transform(unused, lambda c: held(c, F.filter(lost(required), lambda t: F.contains(F.lower(c["raw_text"]), t)), False))
    start = F.struct(F.lit("").alias("term"), F.lit(False).alias("full"), F.lit(0).alias("used"), F.array().cast(PLACED).alias("rows"))

    def step(state: Column, x: Column) -> Column:
        n = T.estimate_tokens(x["body"])
        looked = ~state["full"] & (state["term"] != x["term"]) & ~F.exists(state["rows"], lambda r: r["id"] == x["id"])
        fits = looked & (state["used"] + n <= RESCUE)
        row = F.struct(F.lit(0).alias("ord"), x["id"].alias("id"), x["body"].alias("body"), n.alias("tokens"))
        return F.struct(x["term"].alias("term"), (state["full"] | (looked & ~fits)).alias("full"), F.when(fits, state["used"] + n).otherwise(state["used"]).alias("used"), F.when(fits, F.concat(state["rows"], F.array(row))).otherwise(state["rows"]).alias("rows"))

    return F.aggregate(F.array_sort(F.flatten(F.concat(told, mentioned))), start, step, lambda state: state["rows"])


def _trimmed(sections: Column, cap: Column) -> Column:
    """(kept, dropped): sections that may go are left out from the end while the pack is over the cap and has more than three."""
    start = F.struct(_total(sections).alias("total"), F.size(sections).alias("n"), F.array().cast(SECTION).alias("kept"), F.array().cast(WORDS).alias("dropped"))

    def step(state: Column, s: Column) -> Column:
        drop = (state["total"] > cap) & (state["n"] > 3) & s["name"].isin(*TRIMMED)
        return F.struct(
            F.when(drop, state["total"] - s["tokens"]).otherwise(state["total"]).alias("total"), F.when(drop, state["n"] - 1).otherwise(state["n"]).alias("n"),
            F.when(drop, state["kept"]).otherwise(F.concat(F.array(s), state["kept"])).alias("kept"), F.when(drop, F.concat(state["dropped"], F.array(s["name"]))).otherwise(state["dropped"]).alias("dropped"),
        )

    return F.aggregate(F.reverse(sections), start, step, lambda state: F.struct(state["kept"], state["dropped"]))


def build_packs(requests: DataFrame, retrieved: DataFrame, memories: DataFrame, states: DataFrame | None = None, symbols: DataFrame | None = None, compact: bool = False, most: int = MOST) -> DataFrame:
    """request_id, project_id, sections, tokens, sufficiency, warnings: one pack per request, of its first ``most`` candidates.

    requests: request_id, project_id, query, task, token_budget,
    max_pack_tokens, optional required_terms.  retrieved: request_id,
    memory_id, rank.  states and symbols: (project_id, slot), (request_id,
    slot).  A request without candidates gets a pack of empty sections.
    """
    full = {"decisions", "errors_found"} <= set(memories.columns)
    body = extract.compress(3) if full else F.coalesce("semantic_summary", "compressed_summary", "raw_text", F.lit(""))
    raw = F.coalesce("raw_text", F.lit(""))
    rows = memories.select("memory_id", F.col("memory_type").alias("type"), F.col("validity").isin(*INACTIVE).alias("inactive"), raw.alias("raw_text"), F.col("importance_score").alias("importance"), F.col("recency_score").alias("recency"), body.alias("body"), T.protected_keywords(raw).alias("keywords"), F.substring(normalised(raw), 1, 120).alias("text_key"))
    held = retrieved.where(F.col("rank") <= most).select("request_id", "memory_id", "rank").join(rows, "memory_id")
    candidate = F.struct("rank", F.col("memory_id").alias("id"), "type", "inactive", "raw_text", "importance", "recency", "body", "keywords", "text_key")
    held = held.groupBy("request_id").agg(F.array_sort(F.collect_list(candidate)).alias("every"))

    wanted = ["request_id", "project_id", "query", "task", "token_budget", "max_pack_tokens", *(["required_terms"] if "required_terms" in requests.columns else [])]
    x = requests.select(*wanted).join(token_budget(requests).drop("buffer"), "request_id").join(held, "request_id", "left")
    for other, name, key in ((symbols, "symbol_text", "request_id"), (states, "state_text", "project_id")):
        x = x.withColumn(name, F.lit("")) if other is None else x.join(other.select(key, F.col("slot").alias(name)), key, "left").fillna("", [name])
    required = F.coalesce("required_terms", F.array().cast(WORDS)) if "required_terms" in requests.columns else F.array().cast(WORDS)
    x = x.withColumn("every", F.coalesce("every", F.array().cast(held.schema["every"].dataType))).withColumn("plan", _sections(F.col("task"), F.col("query"), compact))
    x = x.withColumn("live", F.filter("every", lambda c: ~c["inactive"]))
    pack = F.col("max_pack_tokens")
    scale = F.least(F.lit(5.0), F.greatest(F.lit(1.0), pack / 100))
    room = F.when(pack > 150, ((pack - 150) / 100).cast("int")).otherwise(0)
    x = x.withColumn("offers", _offers(F.col("plan"), F.col("live"), room, scale)).withColumn("placed", _fill(F.col("offers")))

    none = F.array().cast(WORDS)
    slot = lambda name, column: F.when(F.col(column) != "", _section(name, F.col(column), none, F.regexp_count(column, F.lit(r"\S+"))))
    asked = F.concat(F.lit("p="), "project_id", F.lit(" q="), F.substring("query", 1, 20))
    head = F.array_compact(F.array(slot("exact_symbols", "symbol_text"), slot("project_state", "state_text"), _section("system_task", asked, none, T.estimate_tokens(asked))))

    def of_rows(name: Column | str, own: Column) -> Column:
        return _section(name, F.array_join(F.transform(own, lambda r: r["body"]), "\n"), F.transform(own, lambda r: r["id"]), _total(own))

    shown = F.filter("plan", lambda s: s["always"] | F.exists("live", lambda c: F.array_contains(s["types"], c["type"])))
    body_sections = F.transform(shown, lambda s: of_rows(s["name"], F.filter("placed", lambda r: r["ord"] == s["ord"])))
    x = x.withColumn("sections", F.concat(head.cast(SECTION), body_sections.cast(SECTION)))
    if compact:
        x = x.withColumn("rescued", F.array().cast(PLACED))
    else:
        x = x.withColumn("said", pack_text("sections")).withColumn("rescued", _rescued(F.col("every"), F.col("placed"), F.col("said"), required))
    x = x.withColumn("sections", F.when(F.size("rescued") > 0, F.concat("sections", F.array(of_rows("protected_evidence", F.col("rescued"))).cast(SECTION))).otherwise(F.col("sections")))
    cap = F.least("token_budget", "max_pack_tokens")
    x = x.withColumn("trimmed", _trimmed(F.col("sections"), cap)).withColumn("sections", F.col("trimmed.kept"))
    holds = lambda name: F.exists("sections", lambda s: (s["name"] == name) & (F.size(s["memory_ids"]) > 0)).cast("int")
    score = 0.3 + 0.3 * holds("decisions") + 0.2 * holds("errors") + 0.1 * (F.size("every") > 5).cast("int") + 0.1 * (F.size("every") > 10).cast("int")
    gone = F.size("every") - F.size("live")
    warnings = F.concat(
        F.array_compact(F.array(
            F.when(gone > 0, F.format_string(FILTERED, gone)),
            F.when(F.size("rescued") > 0, F.format_string(RESCUED, F.size("rescued"))),
        )),
        F.transform("trimmed.dropped", lambda n: F.format_string(CUT, n, cap)),
    )
    return x.select("request_id", "project_id", "sections", _total(F.col("sections")).alias("tokens"), F.least(F.lit(1.0), F.round(score, 6)).alias("sufficiency"), warnings.alias("warnings"))


def flat_packs(packs: DataFrame) -> DataFrame:
    """request_id, section, ord, content, ids, tokens."""
    return packs.select("request_id", F.posexplode_outer("sections").alias("ord", "s")).select("request_id", "ord", F.col("s.name").alias("section"), F.col("s.content").alias("content"), F.array_join("s.memory_ids", "|").alias("ids"), F.col("s.tokens").alias("tokens"))


def pack_text(sections: Column | str = "sections") -> Column:
    return F.lower(F.array_join(F.transform(sections, lambda s: s["content"]), " "))


# What every answer has to do.
DUTIES = ("Give a concrete actionable response.", "Cite memory IDs when relying on memory.", "Do not claim files were changed unless tool output confirms it.")


def compose_prompts(packs: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, prompt: sections with content as headed text, warnings, scope, the query, the duties of an answer."""
    listed = lambda xs: F.array_join(F.transform(xs, lambda w: F.concat(F.lit("- "), w)), "\n")
    title = lambda s: F.upper(F.replace(s["name"], F.lit("_"), F.lit(" ")))
    full = F.filter("sections", lambda s: F.trim(s["content"]) != "")
    parts = F.transform(full, lambda s: F.concat(F.lit("## "), title(s), F.lit("\n"), s["content"]))
    warned = F.when(F.size("warnings") > 0, F.concat(F.lit("## WARNINGS\n"), listed(F.col("warnings"))))
    scope = F.concat(F.lit("## FORBIDDEN CONTEXT\n- Scope:"), "project_id")
    duties = F.lit("## ANSWER REQUIREMENTS\n" + "\n".join(f"- {d}" for d in DUTIES))
    joined = packs.join(requests.select("request_id", "query"), "request_id")
    return joined.select("request_id", F.concat_ws("\n\n", F.when(F.size(full) > 0, F.array_join(parts, "\n\n")), warned, scope, F.concat(F.lit("## USER QUERY\n"), "query"), duties).alias("prompt"))


# --- baselines -----------------------------------------------------------


def _one_section(rows: DataFrame, name: str, text: Column, order: Column, separator: str, budget: int | None) -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), separator)
    out = rows.groupBy("project_id").agg(joined.alias("content"))
    if budget is not None:
        most = budget * 3
        out = out.withColumn("content", F.when(F.length("content") > most, F.concat(F.substring("content", 1, most), F.lit("\n...[truncated]"))).otherwise(F.col("content")))
    return out.select("project_id", F.lit(name).alias("section"), "content", T.estimate_tokens(F.col("content")).alias("tokens"))


def _first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)), 1, n), " ")


def summary_packs(memories: DataFrame, budget: int = 32768) -> DataFrame:
    """The first words of the first decisions and errors of each project."""
    text = F.coalesce("compressed_summary", "raw_text")
    rows = [top_memories(memories, memory_type=kind, k=k).select("project_id", F.struct(F.lit(i).alias("l"), F.col("rank").alias("r")).alias("o"), _first_words(text, n).alias("t")) for i, (kind, k, n) in enumerate((("decision", 20, 10), ("error", 10, 8)))]
    return _one_section(rows[0].union(rows[1]), "summary", F.col("t"), F.col("o"), "\n", budget)


def full_packs(memories: DataFrame, budget: int = 32768) -> DataFrame:
    """All rows of a project in rank order, as far as the budget's characters reach; every row takes three at least, so no more rows are gathered than these."""
    rows = top_memories(memories, k=budget * 3 + 1)
    text = F.concat(F.lit("["), "memory_type", F.lit("] "), F.substring(F.coalesce("compressed_summary", "raw_text"), 1, 400))
    return _one_section(rows, "full_context", text, F.col("rank"), "\n\n", budget)


def _within(rows: DataFrame, order: list, budget: int, text: Column, name: str) -> DataFrame:
    """Rows in order until the running token sum passes the budget."""
    run = Window.partitionBy("request_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = rows.withColumn("used", F.sum(T.estimate_tokens(text)).over(run)).where(F.col("used") <= budget)
    line = F.concat(F.lit("["), "memory_type", F.lit("] "), text)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("used", F.col("memory_id").alias("id"), line.alias("t")))), lambda x: x["t"]), "\n")
    return kept.groupBy("request_id").agg(F.lit(name).alias("section"), joined.alias("content"), F.max("used").cast("int").alias("tokens"))


def raw_verbatim_packs(fused: DataFrame, memories: DataFrame, budget: int) -> DataFrame:
    """fused (request_id, memory_id, place): the first 20, one for each text prefix, in time order."""
    rows = fused.where("place <= 20").join(memories, "memory_id")
    once = F.row_number().over(Window.partitionBy("request_id", F.substring("raw_text", 1, 200)).orderBy("place"))
    return _within(rows.withColumn("n", once).where("n = 1"), [F.col("timestamp"), F.col("memory_id")], budget, F.col("raw_text"), "raw_verbatim")


def strong_rag_packs(fused: DataFrame, memories: DataFrame, budget: int) -> DataFrame:
    """The first 15 that are not stale, in fused order."""
    rows = fused.join(memories, "memory_id").where(~F.col("validity").isin(*INACTIVE))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("place"))
    return _within(rows.withColumn("n", place).where("n <= 15"), [F.col("n")], budget, F.coalesce("compressed_summary", "raw_text"), "strong_rag")


def rag_packs(requests: DataFrame, memories: DataFrame, vectors: DataFrame, k: int = 20) -> DataFrame:
    """Packs of the ``k`` nearest memories of the project alone: requests as for ``build_packs``, with ``vector``."""
    return build_packs(requests, vector_candidates(vectors, requests, k), memories)


# --- sufficiency ---------------------------------------------------------

# Memory types that words of a query ask for, and words that ask for nothing.
ASKS = {"decision": ("decision",), "error": ("error",), "bug": ("error",), "state": ("fact", "decision", "code_change"), "status": ("fact", "decision", "code_change"), "goal": ("requirement", "decision"), "task": ("task", "decision"), "file": ("code_change", "fact"), "code": ("code_change", "fact"), "test": ("fact", "error"), "deploy": ("fact", "decision"), "security": ("error", "fact")}
QUIET = ("what", "where", "when", "which", "this", "that", "current", "project", "about", "with", "from", "does", "should", "would", "could", "will", "have", "been", "being", "were")


def pack_sufficiency(requests: DataFrame, packs: DataFrame, candidates: DataFrame) -> DataFrame:
    """request_id, score, sufficient, issues, missing_words, missing_types: keyword gaps, missing types, one source only, conflicting decisions, short, no citations.

    packs: request_id, text (lower case).  candidates: request_id,
    memory_type, source_type, validity, statement (null but for decisions).
    """
    low = F.lower("query")
    words = F.filter(T.all_matches(low, r"\b[a-z]{4,}\b"), lambda w: ~w.isin(*QUIET))
    wanted = F.array_distinct(F.flatten(F.array(*[F.when(low.contains(w), F.array(*map(F.lit, types))).otherwise(F.array().cast("array<string>")) for w, types in ASKS.items()])))
    said = F.lower("statement")
    long = F.length("statement") > 10
    held = candidates.groupBy("request_id").agg(
        F.collect_set("memory_type").alias("types"), F.countDistinct("source_type").alias("sources"), F.count("*").alias("n"),
        F.collect_set(F.when((F.col("validity") == "active") & long, said)).alias("active"), F.collect_set(F.when((F.col("validity") == "rejected") & long, said)).alias("rejected"),
    )
    x = requests.select("request_id", words.alias("words"), wanted.alias("wanted")).join(packs.select("request_id", "text"), "request_id").join(held, "request_id", "left")
    none = F.array().cast("array<string>")
    lacking = F.filter("words", lambda w: ~F.contains(F.col("text"), w))
    absent = F.array_except("wanted", F.coalesce("types", none))
    uncovered, missing = F.size(lacking), F.size(absent)
    clash = F.exists(F.coalesce("active", none), lambda a: F.exists(F.coalesce("rejected", none), lambda r: F.size(F.array_intersect(F.split(a, r"\s+"), F.split(r, r"\s+"))) >= 3))
    tests = F.regexp_count("text", F.lit("test"))
    mixed = F.contains("text", F.lit("passed")) & F.contains("text", F.lit("failed")) & (tests > 0) & (tests < 3)
    checks = {
        "keyword_gap": (uncovered > 0, F.least(F.lit(0.3), uncovered * 0.05)), "missing_memory_type": (missing > 0, missing * 0.15), "low_diversity": ((F.coalesce("sources", F.lit(0)) < 2) & (F.coalesce("n", F.lit(0)) > 3), F.lit(0.1)),
        "internal_contradiction": (clash | mixed, F.lit(0.2)), "pack_too_short": (F.length("text") < 100, F.lit(0.3)), "no_citations_in_pack": (~F.col("text").rlike("mem_[a-z0-9]+"), F.lit(0.05)),
    }
    score = F.lit(1.0) - sum((F.when(hit, cost).otherwise(0.0) for hit, cost in checks.values()), F.lit(0.0))
    issues = F.array_compact(F.array(*[F.when(hit, n) for n, (hit, _) in checks.items()]))
    out = x.select("request_id", score.alias("raw"), issues.alias("issues"), F.slice(lacking, 1, 5).alias("missing_words"), absent.alias("missing_types"))
    ok = (F.round("raw", 6) >= 0.7) & ~F.arrays_overlap("issues", F.array(F.lit("missing_memory_type"), F.lit("internal_contradiction")))
    return out.select("request_id", F.greatest(F.lit(0.0), F.round("raw", 2)).alias("score"), ok.alias("sufficient"), "issues", "missing_words", "missing_types")


def query_coverage(requests: DataFrame, packs: DataFrame) -> DataFrame:
    """request_id, score, sufficient: 1.5 times the share of distinct query words in the pack, 1 at most."""
    x = requests.select("request_id", T.words(F.col("query")).alias("words")).join(packs.select("request_id", "text"), "request_id")
    found = F.size(F.filter("words", lambda w: F.contains(F.col("text"), w)))
    score = F.least(F.lit(1.0), found / F.greatest(F.size("words"), F.lit(1)) * 1.5)
    return x.select("request_id", score.alias("score"), (score > 0.5).alias("sufficient"))


def pack_trace(candidates: DataFrame, packs: DataFrame) -> DataFrame:
    """request_id, memory_id, fate: the section that holds a candidate, or why it was dropped."""
    held = packs.select("request_id", F.explode_outer("sections").alias("s")).select("request_id", F.col("s.name").alias("section"), F.explode_outer("s.memory_ids").alias("memory_id"))
    held = held.groupBy("request_id", "memory_id").agg(F.min("section").alias("section"))
    joined = candidates.join(held, ["request_id", "memory_id"], "left")
    why = F.when(F.col("validity").isin(*INACTIVE), F.concat(F.lit("dropped: "), "validity")).otherwise("dropped: budget")
    return joined.select("request_id", "memory_id", F.coalesce("section", why).alias("fate"))


