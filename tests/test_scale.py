"""Operators whose plans must not grow with the square of a hot group, against plain readings and on large single groups."""

import os
import random
import re
import time
from collections import Counter
from datetime import datetime
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memjobs.operators import code, evals, links, retrieve, similarity, transfer, vectors, walks
from memjobs.plans import compositions, evaluating
from memjobs.sources import tables, views


def values(df):
    return sorted(tuple(r) for r in df.collect())


def random_sets(rng, n, shared=("common",)):
    words = [f"w{i}" for i in range(30)]
    sets = [tuple(sorted(set(rng.choices(words, k=rng.randint(0, 9))) | set(shared))) for _ in range(n)]
    return sets + sets[: n // 4]  # equal ones


@pytest.mark.parametrize("least", (0.3, 0.5, 0.8, 1.0))
def test_similar_sets_by_jaccard_match_all_pairs(spark, least):
    rng = random.Random(int(least * 10))
    sets = random_sets(rng, 120)
    frame = spark.createDataFrame([(i, list(s)) for i, s in enumerate(sets)], "id int, tokens array<string>")
    made = similarity.distinct_sets(frame)
    held = {r.id: r.set_id for r in made.members.collect()}
    got = {(r.x, r.y): r.shared for r in similarity.similar_sets(made, jaccard=least).collect()}
    want = {}
    for i, j in combinations(range(len(sets)), 2):
        a, b = set(sets[i]), set(sets[j])
        if a != b and len(a & b) / len(a | b) >= least:
            want[frozenset((held[i], held[j]))] = len(a & b)
    assert {frozenset(p): n for p, n in got.items()} == want and len(got) == len(want)


@pytest.mark.parametrize("overlap", (1, 2, 3))
def test_similar_sets_by_overlap_match_all_pairs_within_their_groups(spark, overlap):
    rng = random.Random(overlap)
    sets = random_sets(rng, 100, shared=())
    rows = [(f"g{i % 3}" if i % 17 else None, i, list(s)) for i, s in enumerate(sets)]
    made = similarity.distinct_sets(spark.createDataFrame(rows, "g string, id int, tokens array<string>"), ("g",))
    pairs = similarity.similar_sets(made, overlap=overlap)
    itself = made.sets.where(F.col("size") >= overlap).select("g", F.col("set_id").alias("x"), F.col("set_id").alias("y"))
    both = pairs.select("g", "x", "y").union(pairs.select("g", "y", "x")).union(itself)
    got = values(similarity.holders(made, both, when=F.col("a_id") < F.col("b_id")).select("g", "a_id", "b_id"))
    assert got == sorted((g, i, j) for (g, i, a), (h, j, b) in combinations(rows, 2) if g and g == h and len(set(a) & set(b)) >= overlap)


def test_a_member_that_all_sets_share_is_no_key_of_the_join(spark):
    """3,000 different sets with ten members in common and ten of their own: a join on the common ones forms 4.5 million pairs each."""
    rows = [(i, [f"own{i}_{j}" for j in range(10)] + [f"all{j}" for j in range(10)]) for i in range(3000)]
    made = similarity.distinct_sets(spark.createDataFrame(rows, "id int, tokens array<string>"))
    assert similarity.candidates(made, jaccard=0.6).count() == 0
    assert similarity.similar_sets(made, jaccard=0.6).count() == 0 and similarity.candidates(made, jaccard=0.3).count() <= 3000 * 2999 // 2


def test_projects_that_share_all_features_meet_once(spark):
    rows = [(f"p{i}", f) for i in range(200) for f in ("alpha", "beta", "gamma")] + [("q", "alpha"), ("q", "delta"), ("z", "omega")]
    got = values(transfer.similar_projects(spark.createDataFrame(rows, "project_id string, feature string"), 0.25))
    alike = [(f"p{i}", f"p{j}", 1.0) for i in range(200) for j in range(200) if i != j]
    assert got == sorted(alike + [x for i in range(200) for x in ((f"p{i}", "q", 0.25), ("q", f"p{i}", 0.25))])


def test_pairs_of_projects_with_one_signature_are_made_by_all_tasks(spark):
    """one pair of signatures stands for all pairs of projects, which were one task's work."""
    rows = [(f"p{i}", f) for i in range(600) for f in ("alpha", "beta")] + [(None, "alpha"), (None, "beta")]
    pairs = transfer.similar_projects(spark.createDataFrame(rows, "project_id string, feature string"))
    by_task = [r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(by_task) == 600 * 599 == pairs.distinct().count()
    assert len(by_task) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(by_task) < 600 * 599 / 2


def dealt_columns(plan):
    """The columns that a plan deals over a stated number of tasks."""
    own = {f.split(":")[-1] for f in plan.schema().simpleString().removeprefix("struct<").removesuffix(">").split(",")} if plan.nodeName() == "RepartitionByExpression" else set()
    return own.union(*(dealt_columns(plan.children().apply(i)) for i in range(plan.children().size())))


def test_ids_are_put_to_pairs_of_signatures_after_these_are_dealt(spark, monkeypatch):
    """pairs of blocks of 64 were dealt with all their ids, bytes that grow with the square of the projects."""
    held = {f"p{i}": ("alpha", "beta") for i in range(150)} | {f"q{i}": ("alpha", "beta", "gamma") for i in range(40)} | {"r": ("omega",), "s": ("omega", "beta", "gamma"), None: ("alpha",)}
    signatures = spark.createDataFrame([(p, f) for p, features in held.items() for f in features], "project_id string, feature string")
    alike = {(p, q): len(set(a) & set(b)) / len(set(a) | set(b)) for p, a in held.items() for q, b in held.items() if p and q and p != q}
    want = sorted((p, q, round(s, 3)) for (p, q), s in alike.items() if s >= 0.3)
    monkeypatch.setattr(similarity, "BLOCK", 5)
    monkeypatch.setattr(similarity, "TILE", 12)
    for most in (similarity.MOST_HELD, 0):
        monkeypatch.setattr(similarity, "MOST_HELD", most)
        pairs = transfer.similar_projects(signatures)
        assert any("array" in kind for kind in dealt_columns(pairs._jdf.queryExecution().optimizedPlan())) == (most == 0)
        assert values(pairs) == want


SAID = "memory_id string, project_id string, memory_type string, validity string, file_references array<string>, raw_text string, compressed_summary string, recency_score double, importance_score double, timestamp timestamp"


def warned(spark, rows, requests):
    """What transfer_warnings finds in rows (memory_id, project_id, memory_type, validity, raw_text, recency_score), and what all pairs of projects give."""
    frame = spark.createDataFrame([(i, p, kind, validity, [], text, None, recency, 0.5, datetime(2024, 1, 1)) for i, p, kind, validity, text, recency in rows], SAID)
    found = transfer.transfer_warnings(spark.createDataFrame(requests, "request_id string, project_id string, query string"), frame, transfer.project_signatures(frame))
    terms = lambda text: {w for w in re.findall(r"\b[a-z]{4,}\b", (text or "").lower())} - set(transfer.STOP_WORDS)
    signed = {}
    for _, p, kind, _, text, _ in rows:
        signed.setdefault(p, set()).update(terms(text) | {kind})
    want = []
    for q in {q for q, *_ in requests}:
        told = []
        for _, own, query in (r for r in requests if r[0] == q):
            for i, p, kind, validity, text, _ in rows:
                if own and p and p != own and own in signed and kind in ("decision", "error") and validity in ("active", "proposed"):
                    similarity = len(signed[own] & signed[p]) / len(signed[own] | signed[p])
                    relevance = len(terms(query) & terms(text)) if terms(query) else 1
                    if similarity >= 0.3 and relevance:
                        told.append((-relevance, -round(similarity, 3), i))
        want += [(q, i, -r, -s, n) for n, (r, s, i) in enumerate(sorted(told)[:5], 1)]
    return sorted(tuple(r) for r in found.select("request_id", "memory_id", "relevance", "similarity", "place").collect()), sorted(want)


def test_warnings_come_from_all_similar_projects_and_all_their_memories(spark):
    """only the three closest projects were asked, and of each only what was among its best hundred memories."""
    rows = [(f"m{p}_{i:03d}", f"p{p}", "decision", "active", "alpha beta gamma", 0.9) for p in range(5) for i in range(100)]
    rows += [(f"m{p}_last", f"p{p}", "decision", "active", "alpha beta gamma omega", 0.1) for p in (1, 4)] + [("other", "q", "fact", "active", "sigma", 0.5)]
    got, want = warned(spark, rows, [("r", "p0", "about omega"), ("s", "p4", "omega"), ("t", "q", "omega")])
    assert got == want and [r[:2] for r in got] == [("r", "m1_last"), ("r", "m4_last"), ("s", "m1_last")]


@pytest.mark.parametrize("seed", range(3))
def test_warnings_match_all_pairs_of_projects(spark, seed):
    rng = random.Random(seed)
    words = ["parser", "loader", "engine", "module", "cache"][: 3 + seed]
    rows = []
    for i in range(160):
        text = None if i % 41 == 0 else " ".join(rng.choices(words, k=rng.randint(1, 2)))
        rows.append((f"m{rng.randint(0, 200):03d}", f"p{i % 12}" if i % 29 else None, rng.choice(("decision", "error", "fact")), rng.choice(("active", "active", "proposed", "rejected", None)), text, 0.5))
    requests = [(f"r{i % 17}" if i % 13 else None, f"p{i % 14}" if i % 11 else None, rng.choice((None, "", "nothing", " ".join(rng.choices(words, k=2))))) for i in range(40)]
    got, want = warned(spark, rows, [r for r in requests if r[0]])
    assert got == want and len(want) > 50


def test_rows_of_one_key_are_first_ranked_by_project(spark):
    rows = [(1, f"p{i % 7}", i) for i in range(100)]
    made = transfer._first(spark.createDataFrame(rows, "y int, other_id string, memory_id int"), ("y",), ("memory_id",), 3)
    assert re.search(r"hashpartitioning\(y#\d+, other_id#\d+,", made._jdf.queryExecution().executedPlan().toString())
    assert sorted(r.memory_id for r in made.collect()) == list(range(6))


MEMORY = "memory_id string, project_id string, session_id string, timestamp timestamp, memory_type string, file_references array<string>, raw_text string, compressed_summary string, semantic_summary string, recency_score double, importance_score double"


def memories(spark, rng, n, project="p"):
    words = ["parser", "loader", "engine", "module", "cache", "store", "branch", "release"]
    rows = []
    for i in range(n):
        files = [rng.choice(("a.py", "b.py", "c.py"))] * rng.randint(0, 1)
        kind = rng.choice(("decision", "error", "code_change", "fact", "goal", "note"))
        rows.append((f"m{i:04d}", project, rng.choice(("s1", "s2", "s3", None)), f"2024-01-01 {i // 60 % 24:02d}:{i % 60:02d}:00", kind, files, " ".join(rng.choices(words, k=rng.randint(1, 5))), None, None, round(rng.random(), 3), round(rng.random(), 3)))
    frame = spark.createDataFrame(rows, MEMORY.replace("timestamp timestamp", "timestamp string"))
    return rows, frame.withColumn("timestamp", F.to_timestamp("timestamp"))


def plain_links(rows, targets):
    stop = set(links.STOP_WORDS)
    related = {**links.RELATIONS, **{(y, x): r for (x, y), r in links.RELATIONS.items()}}
    out = []
    for a in rows:
        for b in targets:
            if (b[3], b[0]) >= (a[3], a[0]):
                continue
            shared = len({w for w in a[6].split() if w not in stop} & {w for w in b[6].split() if w not in stop})
            seconds = abs((int(a[3][11:13]) * 60 + int(a[3][14:16])) - (int(b[3][11:13]) * 60 + int(b[3][14:16]))) * 60
            if a[2] and a[2] == b[2]:
                rule = ("same_session", 0.9)
            elif (a[4], b[4]) in related:
                rule = (related[a[4], b[4]], 0.7)
            elif set(a[5]) & set(b[5]):
                rule = ("shared_file", 0.8)
            elif shared >= 3:
                rule = ("keyword_overlap", round(min(0.8, 0.5 + shared * 0.05), 6))
            elif seconds < 300:
                rule = ("temporal_proximity", 0.5)
            else:
                continue
            out.append((a[0], b[0], *rule))
    return sorted(out)


def test_links_with_and_without_a_cap_on_a_project_of_more_rows_than_the_cap(spark):
    rows, frame = memories(spark, random.Random(8), 150)
    first = sorted(rows, key=lambda r: (-r[9], -r[10], [-ord(c) for c in r[3]], r[0]))[:100]
    for cap, targets in ((100, first), (None, rows)):
        got = values(links.auto_link(frame, cap).withColumn("confidence", F.round("confidence", 6)))
        assert got == plain_links(rows, targets), cap
    assert len(plain_links(rows, first)) < len(plain_links(rows, rows))
    assert {r[2] for r in plain_links(rows, rows)} >= {"same_session", "shared_file", "keyword_overlap", "temporal_proximity"}


def test_recall_is_counted_as_pairs_would_be(spark):
    rng = random.Random(9)
    rows = [(f"m{i}", rng.choice(("p", "q")), rng.choice(("s1", "s2", "s3", "s4", None)), rng.sample(["a", "b", "c", "d", "e"], rng.randint(0, 4))) for i in range(90)]
    told = [(rng.choice(rows)[0], rng.choice(rows)[0]) for _ in range(300)]
    pairs = {tuple(sorted((a[0], b[0]))) for a, b in combinations(rows, 2) if a[1] == b[1] and ((a[2] and a[2] == b[2]) or len(set(a[3]) & set(b[3])) >= 2)}
    frame = spark.createDataFrame(rows, "memory_id string, project_id string, session_id string, file_references array<string>")
    got = links.link_recall(frame, spark.createDataFrame(told, "source_id string, target_id string")).first()
    assert (got.expected, got.found) == (len(pairs), len(pairs & {tuple(sorted(t)) for t in told}))


DECISION = "memory_id string, project_id string, timestamp timestamp, statement string, file_references array<string>, validity string"


def test_superseded_decisions_match_all_pairs(spark):
    rng = random.Random(10)
    rows = []
    for i in range(160):
        text = " ".join(rng.choices(("use", "Engine", "for", "store", "cache"), k=rng.randint(1, 4)))
        rows.append((f"m{i:03d}", rng.choice(("p", "q")), rng.choice((None, *range(8), *range(8))), text if rng.random() < 0.95 else None, rng.sample(["a.py", "b.py"], rng.randint(0, 2)), rng.choice(("active", "active", "active", "rejected"))))
    want = {}
    live = [r for r in rows if r[5] == "active" and r[2] is not None and r[3] is not None]
    for b in live:
        later = [(a[2], a[0]) for a in live if a[1] == b[1] and a[2] > b[2] and a[3].lower() != b[3].lower() and (set(a[4]) & set(b[4]) or len(set(a[3].lower().split()) & set(b[3].lower().split())) >= 2)]
        if later:
            want[b[0]] = min(later)[1]
    frame = spark.createDataFrame([(*r[:2], None if r[2] is None else f"2024-01-01 00:00:{r[2]:02d}", *r[3:]) for r in rows], DECISION.replace("timestamp timestamp", "timestamp string")).withColumn("timestamp", F.to_timestamp("timestamp"))
    assert dict(values(links.supersede_decisions(frame))) == want and len(want) > 60


def test_decisions_of_a_large_project_are_superseded_in_linear_work(spark):
    n = 100_000
    rows = spark.range(n).select(F.format_string("m%06d", "id").alias("memory_id"), F.lit("p").alias("project_id"), F.timestamp_seconds(F.col("id")).alias("timestamp"), F.concat(F.lit("use engine "), (F.col("id") % 7).cast("string")).alias("statement"), F.array().cast("array<string>").alias("file_references"), F.lit("active").alias("validity"))
    began = time.time()
    got = links.supersede_decisions(rows).where(F.col("superseded_by") == F.format_string("m%06d", F.substring("memory_id", 2, 9).cast("int") + 1)).count()
    assert got == n - 1 and time.time() - began < 120  # all pairs would be five billion


def test_no_list_of_decisions_is_broadcast(spark):
    rows = spark.range(200).select(F.format_string("m%03d", "id").alias("memory_id"), F.lit("p").alias("project_id"), F.timestamp_seconds(F.col("id")).alias("timestamp"), F.concat(F.lit("use engine "), (F.col("id") % 7).cast("string")).alias("statement"), F.array().cast("array<string>").alias("file_references"), F.lit("active").alias("validity"))
    got = links.supersede_decisions(rows)  # the lists of these few are estimated small, like those of six million events were
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString() and got.count() == 199


def test_a_walk_over_a_hub_of_many_edges(spark, monkeypatch):
    """0 - 1 - hub with 100,000 leaves, one of which goes on: six hops."""
    chain = [("n0", "n1"), ("n1", "hub"), ("leaf7", "m0"), ("m0", "m1"), ("m1", "m2"), ("m2", "m3")]
    edges = spark.range(100_000).select(F.lit("hub").alias("node"), F.concat(F.lit("leaf"), "id").alias("next")).union(spark.createDataFrame(chain, "node string, next string"))
    seeds = spark.createDataFrame([(1, "n0", 7), (2, "n0", 2), (3, "hub", 1), (4, "nowhere", 9), (5, "n0", 0)], "group int, node string, hops int")
    got = {r.group: r.n for r in walks.walk(seeds, edges, 7).groupBy("group").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 3 + 100_000 + 3, 2: 2, 3: 1, 4: 1}
    spread, hubs = walks._blocked(edges.distinct())
    assert values(hubs) == [("hub", 25)] and max(r["count"] for r in spread.groupBy("node", "block").count().collect()) < 2 * walks.HUB


def test_walks_end_on_an_empty_frontier(spark, monkeypatch):
    written = []
    monkeypatch.setattr(walks, "written", lambda df: written.append(1) or df.cache())
    seeds, edges = spark.createDataFrame([(1, "a", 50)], "group int, node string, hops int"), spark.createDataFrame([("a", "b"), ("b", "a")], "node string, next string")
    assert values(walks.walk(seeds, edges, 50)) == [(1, "a"), (1, "b")] and len(written) < 10


def test_changed_lines_meet_the_symbols_of_a_huge_file(spark):
    n = 100_000
    symbols = spark.range(n).select(F.lit("big.py").alias("file_path"), F.concat(F.lit("f"), "id").alias("name"), F.lit("function").alias("symbol_type"), (3 * F.col("id") + 1).cast("int").alias("line_start"), (3 * F.col("id") + 2).cast("int").alias("line_end"))
    symbols = symbols.union(spark.createDataFrame([("big.py", "all", "class", 1, 3 * n), ("big.py", "os", "import", 1, 1)], symbols.schema))
    changes = spark.range(n).select(F.lit("big.py").alias("file_path"), (3 * F.col("id") + 1 + F.col("id") % 3).cast("int").alias("line"))
    began = time.time()
    got = code.affected_symbols(symbols, changes)
    assert got.count() == sum(i % 3 < 2 for i in range(n)) + 1 and time.time() - began < 120
    assert got.where("name = 'all'").count() == 1 and got.where("name = 'os'").count() == 0


def test_inverted_file_search_reaches_its_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 24)) * 2
    x = centres[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 24), (9003, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "memory_id bigint, vector array<double>")
    asked = frame.where("memory_id % 20 = 0").withColumnRenamed("memory_id", "request_id")
    index = vectors.ivf_index(frame)
    assert index.probes < len(index.centroids) / 2 and index.table.count() == 4000  # every row is in a cell
    got, want = ({q: set() for q in range(0, 4000, 20)} for _ in range(2))
    for r in vectors.ivf_search(index, asked, 10).collect():
        got[r.request_id].add(r.memory_id)
    exact = x / np.linalg.norm(x, axis=1)[:, None]
    for q in want:
        want[q] = set(np.argsort(-(exact @ exact[q]), kind="stable")[:10].tolist())
    assert np.mean([len(got[q] & want[q]) / 10 for q in want]) >= 0.9
    every = {(r.request_id, r.memory_id) for r in vectors.ivf_search(index, asked, 10, probes=len(index.centroids)).collect()}
    assert every == {(q, m) for q in want for m in want[q]}
    empty = vectors.ivf_index(frame.limit(0))
    assert vectors.ivf_search(empty, asked, 10).count() == 0 == vectors.ivf_search(index, asked.limit(0), 10).count()


def test_a_project_finds_its_own_vectors_only(spark):
    rows = [(f"m{i:03d}", f"p{i % 3}" if i % 10 else None, [float(i % 7), 1.0, float(i % 5)]) for i in range(120)]
    asked = [("r1", "p0", [1.0, 1.0, 0.0]), ("r2", "p1", [0.0, 0.0, 0.0]), ("r3", "p2", None), ("r4", "none", [1.0, 1.0, 1.0]), ("r5", None, [1.0, 1.0, 1.0])]
    frame, requests = spark.createDataFrame(rows, "memory_id string, project_id string, vector array<double>"), spark.createDataFrame(asked, "request_id string, project_id string, vector array<double>")
    q = np.array([1.0, 1.0, 0.0])
    score = lambda v: round(float(np.dot(v, q) / (np.linalg.norm(v) * np.linalg.norm(q) + 1e-10)), 9)
    want = sorted(((-score(v), m) for m, p, v in rows if p == "p0"))[:5]
    got = vectors.vector_candidates(frame.repartition(3), requests, 5).orderBy("request_id", "rank").collect()
    assert [(r.request_id, r.memory_id, r["rank"]) for r in got] == [("r1", m, i) for i, (_, m) in enumerate(want, 1)]


def test_files_are_written_by_several_tasks(spark, tmp_path):
    lines = spark.range(600).select(F.concat(F.lit("a/f"), (F.col("id") % 60).cast("string"), F.lit(".txt")).alias("path"), F.concat(F.col("id").cast("string"), F.lit("\n")).alias("content"), (-F.col("id")).alias("at"))
    spark.sparkContext.setJobGroup("files", "files")
    try:
        assert tables.write_files(lines, str(tmp_path / "tree"), ("at",)) == 60
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("files") for s in tracker.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(s.numTasks for s in stages if s) >= 4  # a coalesced shuffle would leave all files to one
    assert (tmp_path / "tree" / "a" / "f7.txt").read_text().split() == [str(n) for n in range(547, 0, -60)]


def test_requests_of_equal_terms_are_scored_once(spark, monkeypatch):
    memories = spark.createDataFrame([(f"m{i}", f"p{i % 5}", f"fix parser now{i}" if i % 4 == 0 else f"plain text{i}") for i in range(40)], "memory_id string, project_id string, raw_text string")
    requests = spark.range(300).select(F.format_string("r%03d", "id").alias("request_id"), F.lit("p1").alias("project_id"), F.when(F.col("id") % 2 == 0, "fix parser").otherwise("parser fix").alias("query"))
    asked, scored = [], retrieve._scored_in_all
    monkeypatch.setattr(retrieve, "_scored_in_all", lambda index, terms: asked.append(terms.select("request_id").distinct().count()) or scored(index, terms))
    got = values(retrieve.bm25_search(memories, requests, 3, "global").select("request_id", "rank", "memory_id", "score"))
    assert asked == [1] and len(got) == 900 and got[:3] == [("r000", *r[1:]) for r in got[-3:]]


def test_bm25_with_few_and_with_many_asked_terms(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(25)], k=rng.randint(1, 12))) for _ in range(200)]
    index = retrieve.bm25_index(spark.createDataFrame([(i, "p", t) for i, t in enumerate(texts)], "memory_id int, project_id string, raw_text string"))
    requests = spark.createDataFrame([(i, "p", t) for i, t in enumerate(texts[:6])], "request_id int, project_id string, query string")
    found = []
    for most in (retrieve.MOST_ASKED, 0):
        monkeypatch.setattr(retrieve, "MOST_ASKED", most)
        pruned = retrieve.bm25_pruned(index, requests, 5)
        found += [(values(pruned.found.select("request_id", "memory_id", "score")), values(pruned.read))]
        assert found[-1][0] == values(retrieve.bm25_search(None, requests, 5, "global", index).select("request_id", "memory_id", "score"))
    assert found[0] == found[1]


def test_closest_projects_are_the_first_of_all_pairs(spark):
    rng = random.Random(8)
    sets = random_sets(rng, 40)
    rows = [(f"p{i:02d}", w) for i, s in enumerate(sets) for w in s] + [(f"q{i:02d}", w) for i in range(30) for w in ("common", "w1")]
    signatures = spark.createDataFrame(rows, "project_id string, feature string")
    want, by = set(), {}
    for r in transfer.similar_projects(signatures).collect():
        by.setdefault(r.project_id, []).append((-r.similarity, r.other_id))
    for p, near in by.items():
        want |= {(p, o, -s) for s, o in sorted(near)[:3]}
    assert set(values(transfer.closest_projects(signatures, 3))) == want and len(want) > 150


def test_semantic_match_forms_no_pairs_of_rows_and_keeps_zero_vectors(spark):
    rng = np.random.default_rng(5)
    made = lambda n: [("a" if i % 3 else "b", i, [0.0] * 4 if i % 10 == 0 else [float(x) for x in rng.normal(size=4 if i % 7 else 3)]) for i in range(n)]
    asked, told = made(40), made(60)
    want = {}
    for name in "ab":
        best = [max(float(np.dot(e, s) / (np.linalg.norm(e) * np.linalg.norm(s) + 1e-10)) for m, _, s in told if m == name and len(s) == len(e)) for n, _, e in asked if n == name]
        want[name] = (round(np.mean([b >= 0.3 for b in best]), 6), round(np.mean(best), 6))
    schema = "name string, item int, vector array<double>"
    got = evals.semantic_match(spark.createDataFrame(asked, schema), spark.createDataFrame(told, schema), 0.3)
    assert {r.name: (round(r.recall, 6), round(r.mean_best, 6)) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "MapInArrow" in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_code_lines_need_no_shuffle_and_no_language_of_their_own(spark):
    files = spark.createDataFrame([("a.py", "def f(x):\n  return g(\n  h (x)\nclass B:\n    pass\n\n\nk()"), ("b.txt", "def f(x):"), ("c.py", None)], "file_path string, content string")
    made = code.index_code_regex(files)
    assert "Exchange" not in plan_of(made) and "Window" not in plan_of(made)
    assert plan_of(made).count("regexp_extract(file_path") < 20  # once a file, not in the patterns of each line
    assert [(r.name, r.symbol_type, r.line_start, r.calls) for r in made.orderBy("line_start").collect()] == [("f", "function", 1, ["g", "h"]), ("B", "class", 4, ["k"])]


def test_call_graph_reads_its_edges_once(spark):
    rows = [("a", "x", "b", "y"), ("b", "y", "a", "x"), ("a", "x", "a", "z"), ("b", "x", "b", "y")]
    edges = spark.createDataFrame(rows, "file_path string, caller string, callee_path string, callee string")
    chain = code.dependency_chain(edges)
    assert plan_of(chain).count("Exchange") == 1 and "Join" not in plan_of(chain)
    assert sorted(tuple(r) for r in chain.collect()) == [("a", "x", ["y"], ["y", "z"]), ("a", "z", ["x"], None), ("b", "x", None, ["y"]), ("b", "y", ["x"], ["x"])]
    assert values(code.transitive_affected(spark.createDataFrame([("a", "z")], "file_path string, name string"), edges, 3)) == [("a", "x"), ("a", "z"), ("b", "y")]


def test_callers_of_stated_names_make_no_other_edges(spark, monkeypatch):
    from memjobs.plans import breadth

    made = []
    own = tables.written
    monkeypatch.setattr(breadth.tables, "written", lambda df: made.append(df) or own(df))
    out = breadth.QUERIES["l4_callers_callees"](spark, "/root/testdata/sf0.001")
    assert len(made) == 1 and "parquet" in plan_of(out) and "events.parquet" not in plan_of(out)


def test_python_symbols_leave_a_task_in_small_batches(spark):
    files = spark.createDataFrame([(f"{i}.py", "def f(): g()\n" * 700) for i in range(5)], "file_path string, content string").coalesce(1)
    assert code.index_code_python(files).count() == 3500
    batch = pa.RecordBatch.from_pydict({"file_path": [f"{i}.py" for i in range(5)], "content": ["def f(): g()\n" * 700] * 5})
    assert [b.num_rows for b in code.symbol_batches([batch])] == [1000, 1000, 1000, 500]


def test_commit_windows_sort_commits_once(spark):
    from memjobs.sources import readers

    rows = [("r", i, s) for i, s in enumerate(["beta alpha", "beta alphas it", None, "gamma gamma", "beta", "x", "delta delta delta", "zeta"])] + [("short", 0, "alpha")]
    made = readers.commit_windows(spark.createDataFrame(rows, "repo string, i int, subject string"), 4)
    assert plan_of(made).count("Exchange") == 1 and "Join" not in plan_of(made)
    assert sorted((r.start, r.goals, r["query"]) for r in made.collect()) == [
        (0, ["beta alpha", "beta alphas it", None], "beta gamma alpha"), (2, [None, "gamma gamma", "beta"], "gamma beta"), (4, ["beta", "x", "delta delta delta"], "delta beta zeta"),
    ]


def test_written_memories_hash_an_event_once(spark):
    from memjobs.operators import extract

    log = spark.createDataFrame([("e1", "p", "s", "user_message", "We must fix api_key = abcdefghijklmnop1234 now")], "event_id string, project_id string, session_id string, event_type string, raw_text string").selectExpr("*", "timestamp'2024-01-01' AS timestamp", "CAST(null AS string) AS tool_name", "CAST(null AS string) AS file_path", "CAST(null AS string) AS error_kind")
    made = extract.write_memories(log)
    above = plan_of(made.select("event_id", "memory_type", "raw_text")).split("Generate inline")[0]
    assert "sha2" not in above and "AKIA" not in above
    assert {r.raw_text for r in made.collect()} == {"We must fix [REDACTED] now"}


def test_verified_fixes_extract_once(spark):
    from memjobs.plans import upkeep

    assert "events.parquet" not in plan_of(upkeep.QUERIES["h8_add_verified_fix"](spark, "/root/testdata/sf0.001"))


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_verified_fixes_are_for_the_errors_of_all_events(spark, tmp_path):
    """a third of the events was left out before their errors were looked for."""
    from memjobs.plans import upkeep

    log = [(i, datetime(2024, 1, 2), 1, kind, 0.0, f'{{"k": {k}}}') for i, (k, kind) in enumerate((k, kind) for k in range(12) for kind in ("error", "purchase"))]
    spark.createDataFrame(log, EVENTS).write.parquet(f"{tmp_path}/events.parquet")
    got = values(upkeep.QUERIES["h8_add_verified_fix"](spark, str(tmp_path)))
    assert got == sorted((f"evt_{i}", "runtime_error", f"patch evt_{i}", f"Verified fix: patch evt_{i}") for i, *_, kind, _, _ in log if kind == "error")


def test_postings_are_counted_without_a_shuffle(spark):
    texts = ["b a b x9_ B", "", None, "!", "one one one", "zz yy zz yy aa"]
    made = retrieve.postings(spark.createDataFrame(list(enumerate(texts)), "memory_id int, raw_text string").withColumn("project_id", F.lit("p")), unique=True)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    said = {i: re.findall("[a-z0-9_]{2,}", (t or "").lower()) for i, t in enumerate(texts)}
    assert values(made.select("memory_id", "term", "tf", "length")) == sorted((i, t, n, len(w)) for i, w in said.items() for t, n in Counter(w).items())


def test_rows_of_one_id_are_counted_together(spark):
    rows = [(1, "p", "aa bb"), (1, "p", "aa cc"), (1, "p", "aa"), (2, "p", "aa bb")]
    index = retrieve.bm25_index(spark.createDataFrame(rows, "memory_id int, project_id string, raw_text string"))
    assert values(index.postings.select("memory_id", "length", "term", "tf")) == [(1, 1, "aa", 1), (1, 2, "aa", 2), (1, 2, "bb", 1), (1, 2, "cc", 1), (2, 2, "aa", 1), (2, 2, "bb", 1)]
    assert {r.term: r.df for r in index.stats.collect()} == {"aa": 3, "bb": 2, "cc": 1} and index.n_docs == 4


def test_project_search_sums_scores_where_its_postings_lie(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(25)], k=rng.randint(1, 12))) for _ in range(200)]
    index = retrieve.bm25_index(spark.createDataFrame([(i, f"p{i % 3}", t) for i, t in enumerate(texts)], "memory_id int, project_id string, raw_text string"))
    requests = spark.createDataFrame([(i, f"p{i % 4}", t) for i, t in enumerate(texts[:8])], "request_id int, project_id string, query string")
    n, mean = len(texts), sum(len(t.split()) for t in texts) / len(texts)
    idf = {r.term: r.idf for r in index.stats.collect()}
    want = []
    for q, query in enumerate(texts[:8]):
        scores = {i: sum(idf[w] * (c := t.split().count(w)) * 2.5 / (c + 1.5 * (0.25 + 0.75 * len(t.split()) / mean)) for w in query.split() if w in t.split()) for i, t in enumerate(texts) if i % 3 == q % 4}
        want += [(q, i, s) for i, s in sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0])) if round(s, 6) > 0][:n]
    for most in (retrieve.MOST_ASKED, 0):
        monkeypatch.setattr(retrieve, "MOST_ASKED", most)
        found = retrieve.bm25_search(None, requests, n, "project", index)
        rows = found.orderBy("request_id", "rank").collect()
        assert [(q, i) for q, i, _ in want] == [(r.request_id, r.memory_id) for r in rows] and [s for *_, s in want] == pytest.approx([r.score for r in rows], abs=1e-6)
        by_request_and_memory = re.search(r"hashpartitioning\(request_id#\d+L?, memory_id#\d+L?,", found._jdf.queryExecution().executedPlan().toString())
        assert bool(by_request_and_memory) == (most == 0)


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_derived_memories_are_dealt_over_tasks(spark):
    """The events lie in one row group, which one task reads."""
    made = views.mem_table(spark, DATA)
    assert len(made.inputFiles()) == 4 and values(made.select("memory_id", "raw_text")) == values(views.mem(spark, DATA).select("memory_id", "raw_text"))


class Reached(Exception):
    """The search has got its memories."""


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", ("f1_build_packs", "f3_rescue_terms", "f7_auto_expand", "f8_compose_prompts", "f10_restore_sessions", "f11_pack_trace", "m11_budget_curve"))
def test_retrieval_reads_stored_memories(spark, monkeypatch, name):
    plans = []

    def index(memories):
        plans.append(memories._jdf.queryExecution().optimizedPlan().toString())
        raise Reached

    monkeypatch.setattr(retrieve, "bm25_index", index)
    with pytest.raises(Reached):
        (evaluating.QUERIES | compositions.QUERIES)[name](spark, DATA)
    assert len(plans) == 1 and "get_json_object" not in plans[0]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_a_trace_retrieves_once(spark):
    plan = evaluating.QUERIES["f11_pack_trace"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "tf#" not in plan  # no posting is read by the trace itself
