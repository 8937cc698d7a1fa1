"""Ranked search, conversation repair and nearest neighbours against brute force on small fixtures and on odd rows."""

import functools
import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

from memjobs.llm import conversations, lexical, neighbours

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_ranking(docs, items, k):
    terms = [Counter(TERM.findall(lower(t))) for _, t in docs]
    n_all, length = sum(1 for t in terms if t), sum(sum(t.values()) for t in terms)
    df = Counter(x for t in terms for x in t)
    asked = {}
    for item, text in set(items):
        asked.setdefault(item, Counter()).update(TERM.findall(lower(text)))
    out = []
    for item, q in asked.items():
        scored = []
        for (doc, _), t in zip(docs, terms):
            n = sum(t.values())
            m = 25 + (75 * n * n_all) // length if n else 0
            score = sum(c * math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[x] + 1))) * ((1000000000 * t[x]) // (1000 * t[x] + 8 * m)) for x, c in q.items() if x in t)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=str)


def ranked(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id bigint, text string, score int, row string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, term int")
    return sorted((tuple(r) for r in lexical.search(d, b, **options).collect()), key=str)


@pytest.mark.parametrize("shard", (8192, 7))
def test_search_matches_brute_force(spark, monkeypatch, shard):
    rng = random.Random(3)
    words = ["the", "The", "of", "ÄÖ", "ä-b", "x1", "²", "naïve"] + [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, weights=[20, 9, 9] + [1] * 45, k=rng.choice((1, 5, 30, 200))))) for i in range(80)]
    docs += [(500, docs[3][1]), (499, docs[3][1]), (None, docs[3][1]), (3, docs[3][1]), (600, None), (601, ""), (602, " .,;\n"), (603, "the " * 20000)]
    items = [(i, " ".join(rng.choices(words, k=12))) for i in range(8)] + [(20, None), (21, ""), (22, "nowhere"), (None, "w1 w2 the"), (23, "w3"), (23, "w3"), (23, "w4 w4")]
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical, "FIRST_READ", 2)
    want = brute_ranking(docs, items, 10)
    assert ranked(spark, docs, items) == want
    assert ranked(spark, docs, items, block_terms=40) == want


def test_search_of_nothing(spark):
    assert ranked(spark, [], [(1, "a")]) == [] == ranked(spark, [(1, "a")], []) == ranked(spark, [(1, None), (2, "")], [(1, "a")])


def test_nra_reads_until_scores_are_final():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(1, 400))
        lists = []
        for _ in range(int(rng.integers(1, 6))):
            docs = rng.permutation(n)[: rng.integers(1, n + 1)]
            impacts = np.sort(rng.integers(1, 9 if rng.random() < 0.5 else 10**6, len(docs)))[::-1].astype(np.int64)
            lists.append((docs, impacts))
        total = np.zeros(n, np.int64)
        for docs, impacts in lists:
            total[docs] += impacts
        want = sorted(((int(d), int(s)) for d, s in enumerate(total) if s), key=lambda x: (-x[1], x[0]))[:10]
        assert lexical.nra(lists, n, 10) == want


SPACE = re.compile(r"[^\x20\x09-\x0D]")


def brute_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of rows (turn, role, text), by plain recursion over all edits."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        found = SPACE.findall(text)
        faults.append("b" if not found else "d" if (role, text) in seen else "t" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @functools.cache
    def best(i, state, inserted):
        choices = [(0, "", "")] if i == len(rows) and state in ("", "a") else []

        def add(cost, edit, said, rest):
            if rest:
                choices.append((cost + rest[0], edit + rest[1], said + rest[2]))

        other = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        name = {"u": "user", "a": "assistant"}[other]
        if inserted < 2:
            add(3, "I", f"{name}:\n", best(i, other, inserted + 1))
        if i < len(rows):
            _, role, text = rows[i]
            add(4, "D", "", best(i + 1, state, 0))
            if faults[i] not in ("b", "d"):
                extra = 3 if faults[i] == "t" else 0
                add(3 + extra, "R", f"{name}:{text}\n", best(i + 1, other, 0))
                if (state, role[:1]) in step:
                    add(extra, "K", f"{role}:{text}\n", best(i + 1, step[state, role[:1]], 0))
        return min(choices, key=lambda c: c[:2], default=None)

    cost, audit, said = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(said[:-1].encode()).hexdigest())


def test_repair_matches_brute_force(spark):
    rng = random.Random(11)
    texts = ["Yes.", "No", "what? ", "", " \n", "É!", "a:b", "x\ny."]
    given = {c: [(rng.choice((None, rng.randint(0, 6))), rng.choice(("user", "user", "assistant", "assistant", "system", "tool", "", "ux")), rng.choice(texts)) for _ in range(rng.randint(1, 9))] for c in range(250)}
    flat = [(c, *r, 1) for c, rows in given.items() for r in rows]
    got = conversations.repair(spark.createDataFrame(flat, "conv_id bigint, turn bigint, role string, text string, first int"))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {c: brute_repair(rows) for c, rows in given.items()}


def test_damage_and_conversations_that_lose_all(spark):
    rng = random.Random(2)
    table = [(c, t, rng.choice(("user", "assistant", "system", None)), rng.choice(("Hi. there!", "ok", None, ""))) for c in [*range(200), None] for t in range(rng.choice((1, 1, 2, 5)))] + [(900, None, "user", "a."), (900, None, "user", "a.")]
    want = {}
    for c, t, role, text in table:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        rows = want.setdefault(c, [])
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    frame = spark.createDataFrame([(*r, "x", 3) for r in table], "conv_id bigint, turn bigint, role string, text string, _conv string, digest int")
    got = {r[0]: tuple(r)[1:] for r in conversations.repair_damaged(frame).collect()}
    assert got == {c: brute_repair(rows) for c, rows in want.items()} and any(not rows for rows in want.values())
    assert conversations.repair_damaged(frame.limit(0)).collect() == []


def test_a_long_conversation_keeps_its_vectors_at_checkpoints(spark, monkeypatch):
    codes = bytes(random.Random(4).choices((0, 1, 2, 3, 6, 7, 10, 11), k=40_000))
    cost, edits = conversations.cheapest_edits(codes)
    audit = "".join(e for e, _ in edits)
    kept = [conversations._END]
    for code in reversed(codes):
        kept.append(conversations._back(code, kept[-1]))
    assert cost == kept[-1][0] and sum(e != "I" for e in audit) == len(codes)
    monkeypatch.setattr(conversations, "SPOOL_BYTES", 1000)  # the texts go through the task's file
    rows = [(1, t, "user" if t % 3 else "assistant", f"text {t}{'.' if t % 5 else ''}") for t in range(3000)]
    got = conversations.repair(spark.createDataFrame(rows, "conv_id int, turn bigint, role string, text string")).first()
    said, i = [], 0
    for e in got.audit:  # no system rows: roles alternate from user on
        if e != "D":
            said.append(f"{('user', 'assistant')[len(said) % 2]}:{'' if e == 'I' else rows[i][3]}")
        i += e != "I"
    assert i == 3000 and len(said) % 2 == 0 and got.repaired_sha256 == hashlib.sha256("\n".join(said).encode()).hexdigest()


def near(spark, vectors, asked="vec_id % 20 = 0", **options):
    frame = spark.createDataFrame([(i, v, 1, 2.0) for i, v in vectors], "vec_id bigint, embedding array<float>, label int, score double")
    found = {}
    for r in neighbours.search(frame, asked, **options).orderBy("query_id", "rank").collect():
        assert r.rank == len(found.setdefault(r.query_id, [])) + 1
        found[r.query_id].append((r.vec_id, r.score))
    return found


def brute_near(vectors, k):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], np.float32).astype(np.float64)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        score = np.einsum("ij,j->i", x, x[i])
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


@pytest.mark.parametrize("norms", (False, True))
def test_neighbours_reach_their_recall(spark, norms):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x = x * rng.lognormal(size=(3000, 1)).astype(np.float32) if norms else x / np.linalg.norm(x, axis=1)[:, None]
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = near(spark, vectors), brute_near(vectors, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]) >= 0.9
    scores = {q: dict(brute_near(vectors, 3000)[q]) for q in list(want)[:5]}
    assert all(abs(scores[q][i] - s) < 1e-9 for q in scores for i, s in got[q])


def test_few_neighbours_are_exact_with_ties_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(1, 60)]
    vectors = [(i, v) for i, v in vectors if any(v)] + [(i, [1.0, 1.0, 0.0, 2.0]) for i in range(100, 180)]
    odd = [(0, None), (20, [0.0] * 4), (200, [1.0, None, 0.0, 0.0]), (220, [1.0, float("nan"), 0.0, 0.0]), (240, [float("inf"), 0.0, 0.0, 0.0]), (260, []), (280, [1.0]), (None, [1.0, 0.0, 0.0, 0.0]), (100, [1.0, 1.0, 0.0, 2.0])]
    assert near(spark, vectors + odd) == brute_near(vectors, 20)
    assert near(spark, []) == near(spark, odd[:3]) == near(spark, [(1, [1.0, 2.0])]) == {}
    assert near(spark, [(20, [1.0, 2.0])]) == {} and near(spark, [(20, [1.0, 2.0]), (7, [3.0, 0.0])]) == {20: [(7, 3.0)]}


def test_leaves_are_scored_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    rng = np.random.default_rng(3)
    vectors = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(700)]
    got, want = near(spark, vectors, recall=1.0), brute_near(vectors, 20)
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]) >= 0.99


def test_the_shared_folder_where_no_setting_names_it(tmp_path):
    code = "from pyspark.sql import SparkSession as S; from memjobs.llm._shared import shared_dir, written; s = S.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate(); assert s.conf.get('spark.checkpoint.dir', None) is None; print('ROWS', written(s.range(7)).count(), shared_dir(s) == shared_dir(s))"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}
    said = subprocess.run([sys.executable, "-c", code], env=env, cwd=root, capture_output=True, text=True, timeout=120)
    assert "ROWS 7 True" in said.stdout, said.stderr[-2000:]
