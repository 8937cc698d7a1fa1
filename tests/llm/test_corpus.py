"""Mixing, near duplicates, decontamination, language, toxicity and the pipeline against brute force on small fixtures."""

import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from memjobs.llm import _words, components, decontaminate, language, minhash, mixing, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, copy string, component string, score string"


def frame(spark, rows):
    """rows: (doc_id, text, source)"""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "c", "x", "s") for i, t, s in rows], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 400)) for _ in range(n))


# --- words -----------------------------------------------------------------


def test_words_and_sequences_match_plain_splitting():
    rng = random.Random(0)
    texts = ["", None, "  a  b\n", "é è", *("".join(rng.choice("ab \n\té") for _ in range(200)) for _ in range(30))]
    for lo, hi, data, offsets in _words.text_blocks(pa.array(texts), 500):
        w = _words.words_of(data, offsets)
        for d in range(hi - lo):
            own = [data[a:b].tobytes() for a, b, doc in zip(w.start, w.end, w.doc, strict=True) if doc == d]
            assert own == (texts[lo + d] or "").encode().split()
    data = np.frombuffer(b"x y z x y z w", np.uint8)
    s = _words.Sequences(_words.words_of(data, np.array([0, len(data)])).hash)
    assert s.span(np.array([0]), np.array([3]))[0] == s.span(np.array([3]), np.array([6]))[0] != s.span(np.array([4]), np.array([7]))[0]


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def test_alike_words_and_sequences_do_not_collide():
    tm = "".join("ab"[x] for x in thue_morse(4096))
    far = ["x" * 65_536 + "ab" + "y" * 65_536, "x" * 65_536 + "ba" + "y" * 65_536, "y" * 65_536 + "ab" + "x" * 65_536]
    words = [tm, tm.translate(str.maketrans("ab", "ba")), *far, *("z" * n for n in range(1, 80)), "a" * 8 + "b", "a" * 9, "a\0", "a"]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    for base in _words.WORD_BASES:
        assert len(set(_words.words_of(data, np.array([0, len(data)]), base).hash.tolist())) == len(set(words))
    two = np.array([3, 5], np.uint64)
    sequence = np.array([two[x] for x in thue_morse(4096)] + [two[1 - x] for x in thue_morse(4096)])
    for base in _words.SEQUENCE_BASES:
        s = _words.Sequences(_words.mix(sequence), base)
        a, b = s.span(np.array([0, 4096]), np.array([4096, 8192]))
        assert a != b


# --- mixing ------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), repeats=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > repeats * sizes[s]]
        if not over:
            return target | {s: share * weight[s] for s in open_}
        for s in over:
            target[s] = repeats * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_mix_takes_its_targets(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(0, 40)), rng.choice(["a", "a", "a", "b", "c", None, "é"])) for i in range(300)]
    rows += [(500, None, "a"), (501, "", "a"), (None, "no id", "b"), (7, rows[7][1], rows[7][2]), (600, "one", "solo")]
    out = mixing.mix(frame(spark, rows)).collect()
    again = mixing.mix(frame(spark, rows[::-1])).collect()
    assert sorted(map(str, out)) == sorted(map(str, again)) and len(out) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    for s in sizes:
        mine = [r for r in out if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= len(sizes) + 1
    assert sum(r.taken for r in out) == sum(sizes.values())


def test_mix_of_nothing(spark):
    assert mixing.mix(frame(spark, [(1, None, "a"), (2, " ", None)])).agg({"taken": "sum"}).first()[0] == 0
    assert mixing.mix(frame(spark, []).limit(0)).count() == 0


def test_mixed_documents_are_copies_and_cuts(spark):
    docs = frame(spark, [(i, " ".join(f"w{i}" for _ in range(10)), s) for i, s in enumerate(["a", "b", "c", "a", "b", "c", "c", "c"])])
    got = mixing.mixed_documents(docs)
    assert got.columns == [c for c in docs.columns if c != "copy"] + ["copy", "copy_words"]
    assert all(len(r.text.split()) == r.copy_words for r in got.collect())


# --- near duplicates -----------------------------------------------------------


def test_components_match_union_find(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)]
    links = [(a, b) for a, b in links if a != b]
    parent = {}
    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in list(parent)}


def changed(rng, words, share):
    return [w if rng.random() > share else f"new{rng.randint(0, 10**6)}" for w in words]


def brute_classes(rows, weights):
    """Components of weighted Jaccard >= 0.8 and equal texts."""
    ids = [i for i, t, _ in rows]
    sets = []
    for lo, hi, data, offsets in _words.text_blocks(pa.array([t for _, t, _ in rows], pa.string())):
        sets += list(minhash._shingles(minhash._folded_words(data, offsets), hi - lo, weights))
    parent = list(range(len(rows)))
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            text = rows[i][1]
            same = text is not None and text.strip() != "" and text == rows[j][1]
            if same or (len(sets[i][0]) and len(sets[j][0]) and minhash.weighted_jaccard(sets[i], sets[j]) >= 0.8):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for i in range(len(rows)):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return {ids[i]: low[find(i)] for i in range(len(rows))}


def test_classes_match_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for size, copies, share in ((60, 5, 0.01), (200, 8, 0.02), (120, 40, 0.01), (300, 3, 0.3), (8, 3, 0.0), (3, 2, 0.0)):
        base = prose(rng, size).split()
        texts += [" ".join(base)] + [" ".join(changed(rng, base, share)) for _ in range(copies)]
    texts += [prose(rng, rng.randint(1, 150)) for _ in range(60)]
    texts += [None, None, "", "", "***", "***", "One, two. Three four five six", "one two three FOUR five six!"]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    docs = frame(spark, rows)
    got = {r.doc_id: r.class_id for r in minhash.classes(docs).collect()}
    assert got == brute_classes(rows, minhash.word_weights(docs))
    kept = {r.doc_id for r in minhash.one_of_each(docs).collect()}
    assert kept == {i for i, c in got.items() if i == c}
    assert minhash.one_of_each(docs).columns == docs.columns


def test_crowded_buckets_match_brute_force(spark):
    """Clusters that share boilerplate, and chains that drift from it, meet in large buckets of many components."""
    rng = random.Random(11)
    page, texts = prose(rng, 240).split(), []
    for _ in range(8):
        base = page + prose(rng, 40).split()
        texts += [" ".join([*base[:-1], f"end{i}"]) for i in range(15)]
    for chain in range(4):
        for i in range(30):
            texts.append(" ".join(page + [f"drift{chain}x{j}" for j in range(10 * i, 10 * i + 40)]))
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    docs = frame(spark, rows)
    got = {r.doc_id: r.class_id for r in minhash.classes(docs).collect()}
    want = brute_classes(rows, minhash.word_weights(docs))
    assert len(set(want.values())) >= 6
    assert got == want
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(minhash, "BLOCK_TEXTS", 16)  # now they are crowded
        assert {r.doc_id: r.class_id for r in minhash.classes(docs).collect()} == want
        patch.setattr(minhash, "BLOCK_BYTES", 4_000)  # about two texts a block
        assert {r.doc_id: r.class_id for r in minhash.classes(docs).collect()} == want


def test_pages_of_one_template_meet_by_their_rarest_shingles(spark, monkeypatch):
    """400 pages, 0.6 alike by their template, with pairs among them at 0.8 and more."""
    rng = random.Random(21)
    page, texts = prose(rng, 150).split(), []
    for i in range(400):
        own = [f"own{i}x{j}" for j in range(48)]
        texts.append(" ".join(page + own))
        if i % 20 == 0:
            texts.append(" ".join([*page, *own[:-2], f"near{i}"]))
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    docs = frame(spark, rows)
    want, seen = brute_classes(rows, minhash.word_weights(docs)), []
    assert 380 <= len(set(want.values())) <= 401
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 32)
    split = minhash._split
    def watched(members, crowded, *rest):
        out = split(members, crowded, *rest)
        met = minhash._mixed(out).join(crowded.select("bucket"), "bucket", "left_anti")
        seen.append((crowded.agg({"n_all": "max"}).first()[0], met.agg({"n_all": "max"}).first()[0]))
        return out
    monkeypatch.setattr(minhash, "_split", watched)
    assert {r.doc_id: r.class_id for r in minhash.classes(docs).collect()} == want
    assert seen and seen[0][0] > 33 and (seen[0][1] or 0) <= 33  # a crowd before, at most a block after


def test_rarest_shingles_are_shared_by_all_pairs_of_the_similarity(spark):
    """Random weighted sets of every similarity: no pair at the threshold lacks a common shingle among the rarest."""
    rng = random.Random(22)
    texts = []
    for _ in range(25):
        base = prose(rng, rng.randint(5, 90)).split()
        texts += [" ".join(changed(rng, base, share)) for share in (0, 0.01, 0.02, 0.04, 0.1)]
    weights = np.full(minhash.SLOTS, minhash._UNIT, np.int32)
    counts = np.random.default_rng(1).integers(0, 50, minhash.SLOTS)
    held = lambda x: type("Held", (), {"value": x})
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(texts))]), pa.array(texts)], names=["key", "text"])
    rare = [set(x) for b in minhash._rarest(held(weights), held(counts), 0.8)([batch]) for x in b.column(1).to_pylist()]
    sets = list(minhash._sets(batch.column(1), weights))
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if minhash.weighted_jaccard(sets[i], sets[j]) >= 0.8]
    assert len(alike) > 25 and all(rare[i] & rare[j] for i, j in alike)
    assert sum(len(x) for x in rare) < 0.45 * sum(len(u) for u, _ in sets)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "same text here for all", "s"), (4, "same text here for all", "s"), (4, "same text here for all", "s"), (4, "quite another text lies here now", "s"), (9, "same text here for all", "s")]
    kept = minhash.one_of_each(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text[:5]) for r in kept) == [(0, "same "), (4, "quite"), (4, "same ")]
    assert minhash.classes(frame(spark, rows).limit(0)).count() == 0
    assert minhash.one_of_each(frame(spark, [(1, None, "s")])).count() == 1


def test_near_copies_under_one_id_leave_one(spark):
    rng = random.Random(12)
    base = prose(rng, 80).split()
    near = " ".join([*base[:-1], "other"])
    for ids in ((5, 5), (5, 6)):
        docs = frame(spark, [(ids[0], " ".join(base), "s"), (ids[1], near, "s"), (9, prose(rng, 50), "s")])
        assert sorted(r.doc_id for r in minhash.one_of_each(docs).collect()) == [5, 9]
    named = docs.withColumn("doc_id", docs["doc_id"].cast("string"))
    assert sorted(r.doc_id for r in minhash.one_of_each(named).collect()) == ["5", "9"]


def test_a_large_group_and_its_neighbours_match_brute_force(spark):
    """500 copies, many under 0.8 of each other, and looser clusters that share their buckets: blocks of 64 texts."""
    rng = random.Random(13)
    page = prose(rng, 120).split()
    texts = []
    for i in range(500):
        at = rng.randint(0, 115)
        texts.append(" ".join([*page[:at], f"c{i}", f"d{i}", *page[at + rng.randint(0, 3) :]]))
    for c in range(6):
        other = page[:70] + prose(rng, 30).split()
        texts += [" ".join([*other, f"x{c}y{i}"]) for i in range(12)]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    docs = frame(spark, rows)
    want = brute_classes(rows, minhash.word_weights(docs))
    for size in (64, minhash.BLOCK_TEXTS):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(minhash, "BLOCK_TEXTS", size)
            got = {r.doc_id: r.class_id for r in minhash.classes(docs).collect()}
        assert got == want


def test_icws_collides_by_weighted_jaccard():
    rng = np.random.default_rng(4)
    u = np.sort(rng.integers(1, 1 << 63, 300, dtype=np.uint64))
    a, b = rng.random(300) + 0.5, rng.random(300) + 0.5
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert (minhash.icws(u, a, 3000) == minhash.icws(u, b, 3000)).mean() == pytest.approx(want, abs=0.04)


# --- decontamination ------------------------------------------------------------


ITEM = "How many apples does Anna have if she buys 12 kg on Monday and then sells 5 kg of them on Friday to Peter"


def test_leaks_exact_reparameterised_and_clean(spark):
    rng = random.Random(5)
    again = ITEM.replace("12", "31").replace("5", "8").replace("Anna", "Berta").replace("Peter", "Paul").replace("kg", "g")
    mixed = ITEM.replace("on Friday to Peter", "on Friday to Anna").replace("12", "5")  # slots that map two to one
    rows = [(1, prose(rng, 30) + " " + ITEM + " " + prose(rng, 30), "s"), (2, prose(rng, 20) + "; " + again.upper()[:0] + again, "s"), (3, prose(rng, 80), "s"), (4, None, "s"), (5, "", "s"), (6, ITEM[:40], "s"), (7, mixed, "s")]
    bench = spark.createDataFrame([(10, ITEM), (11, None), (12, "too short"), (13, prose(rng, 40))], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(spark, rows), bench).collect()}
    assert got == {(1, 10), (2, 10)}
    assert {r.doc_id for r in decontaminate.without_leaks(frame(spark, rows), bench).collect()} == {3, 4, 5, 6, 7}
    salted = decontaminate.leaks(frame(spark, rows), bench, most=0)
    assert {(r.doc_id, r.item_id) for r in salted.collect()} == got
    assert {r.doc_id for r in decontaminate.without_leaks(frame(spark, rows), bench, most=0).collect()} == {3, 4, 5, 6, 7}
    assert decontaminate.leaks(frame(spark, rows).limit(0), bench).count() == 0
    assert decontaminate.leaks(frame(spark, rows), bench.limit(0)).count() == 0


def test_names_that_open_sentences_and_grouped_numbers_are_slots(spark):
    rng = random.Random(7)
    names = "Anna buys six red apples today. Peter gives her two more. Maria wants half of them. Anna asks how many are left"
    sizes = "the tank holds 3.5 l of oil and 1,000 l of water so it weighs 20.25 kg more than before"
    rows = [(1, prose(rng, 20) + ". " + names.replace("Anna", "Bertha").replace("Peter", "Omar").replace("Maria", "Ines"), "s")]
    rows += [(2, prose(rng, 20) + " " + sizes.replace("3.5", "7").replace("1,000", "250").replace("20.25", "1,300.5"), "s")]
    rows += [(3, names.replace("Peter", "Anna").replace("Maria", "Anna"), "s"), (4, "3.", "s"), (5, "5 " + prose(rng, 40), "s")]
    bench = spark.createDataFrame([(1, names), (2, sizes)], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(spark, rows), bench).collect()} == {(1, 1), (2, 2)}


def test_verbatim_items_of_any_make_up_are_found(spark):
    rng = random.Random(6)
    sums, title, units, short = "3 5 8 13 21 34 55 89 144 233 377", "The Old Man And The Sea Of Stories By Night", "mix 3 kg 5", "zebra quagga"
    items = [(1, sums), (2, title), (3, units), (4, short)]
    rows = [(i, f"{prose(rng, 20)} in {t} and {prose(rng, 20)}", "s") for i, t in items]
    rows += [(5, "in 4 6 9 14 22 35 56 90 145 234 378 and", "s"), (6, "mix 4 kg 6", "s"), (7, "zebra or quagga", "s"), (8, "in One New Sun Over Two Hill Of Horses At Noon and", "s")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(spark, rows), bench).collect()} == {(i, i) for i in range(1, 5)}
    assert {r.doc_id for r in decontaminate.without_leaks(frame(spark, rows), bench).collect()} == {5, 6, 7, 8}


def brute_leaks(docs, items, n=8, share=0.5, enough=13):
    """Verbatim leaks of items without numbers or capitals, by plain slicing."""
    found = set()
    for d, text in docs:
        words = text.split()
        grams = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
        for i, item in items:
            w = item.split()
            covered = {p + k for p in range(len(w) - n + 1) if tuple(w[p : p + n]) in grams for k in range(n)}
            if covered and (len(covered) >= share * len(w) or len(covered) >= enough):
                found.add((d, i))
    return found


def test_verbatim_leaks_match_brute_force(spark):
    rng = random.Random(15)
    def letters(n):
        return " ".join(rng.choice("abcdefghij") * rng.randint(2, 4) for _ in range(n))
    items = [(i, letters(rng.randint(8, 60))) for i in range(12)]
    docs = []
    for d in range(60):
        words = letters(rng.randint(0, 20)).split()
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(items)[1].split()
            a = rng.randint(0, len(w) - 1)
            words += w[a : a + rng.randint(1, len(w))] + letters(rng.randint(0, 5)).split()
        docs.append((d, " ".join(words)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(spark, [(d, t, "s") for d, t in docs]), bench).collect()}
    assert got == brute_leaks(docs, items) and len(got) > 20


def test_slots_are_consistent_over_alignments(spark):
    item = "first take 12 of the small blue cubes and put them down then take 12 of the large red cubes and keep them near"
    inserted = item.replace("12", "31").replace("down then", "down quietly then")
    mixed = inserted.replace("31", "77", 1)  # 12 maps to 77 before the inserted word and to 31 after it
    twice = item.replace("12", "5") + " and later " + item.replace("12", "6")
    long = "so " * 50_000 + item + " so" * 50_000
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = {r.doc_id: r.n_covered for r in decontaminate.leaks(frame(spark, [(1, inserted, "s"), (2, mixed, "s"), (3, twice, "s"), (4, long, "s")]), bench, enough=100, share=0.7).collect()}
    assert set(got) == {1, 3, 4} and got[3] == got[4] == len(item.split())


# --- language ---------------------------------------------------------------------


def test_language_fuses_evidence(spark):
    en, de = "the house is on the hill and the dog ", "das haus ist auf dem berg und der hund "
    docs = spark.createDataFrame([(i, (en if i % 2 else de) * 30, "en" if i % 2 else "de") for i in range(20)] + [(99, None, None)], "doc_id bigint, text string, lang string")
    rows = [(i, f"http://a.example.de/{i}", f"<html lang='de'><script>the the</script><p>{de * 5}</p>") for i in range(10)]
    rows += [(20, "http://b.example.com/x", f"<html><p>{en * 5}</p>"), (21, "http://a.example.de/none", "<html><p>zz</p>"), (22, None, None), (23, "http://b.example.com/y", f"<html lang='en'>{en * 9}")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in language.identify(pages, docs).collect()}
    assert len(got) == len(rows) and all(got[i].lang == "de" for i in range(10)) and got[20].lang == got[23].lang == "en"
    assert got[21].lang == "de"  # the host and suffix decide
    assert all(0 < r.probability <= 1 for r in got.values())
    assert {r.lang for r in language.identify(pages, docs.limit(0)).collect()} == {"und"}


def test_fusion_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(language, "BLOCK_LANGUAGES", 16)
    rng = random.Random(8)
    names = [f"l{i:02d}" for i in range(70)]
    stems = {x: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=4)) for _ in range(8)] for x in names}
    docs = [(i, " ".join(rng.choices(stems[x], k=60)), x) for i, x in enumerate(names * 2)]
    pages = []
    for i in range(120):
        x = rng.choice(names[:6] + [rng.choice(names)])
        lang = rng.choice([x, x, "", "zz"])
        host = rng.choice([f"{x}.example.com", "a.b.org", "b.org", "c.net"])
        pages.append((i, f"http://{host}/p", f"<html lang='{lang}'><p>{' '.join(rng.choices(stems[x], k=rng.randint(0, 12)))}</p>"))
    pages += [pages[3], (500, None, None)]
    got = language.identify(spark.createDataFrame(pages, "page_id bigint, url string, html string"), spark.createDataFrame(docs, "doc_id bigint, text string, lang string")).collect()
    counts = {x: np.full(language.SLOTS, 0.5) for x in names}
    for _, t, x in docs:
        np.add.at(counts[x], language._trigrams(np.frombuffer(t.encode(), np.uint8)), 1)
    log_p = np.array([np.log(counts[x] / counts[x].sum()) for x in names]).astype(np.float32)
    rows = []
    for i, url, html in pages:
        raw = (html or "").encode()
        x = language.TEMPER * log_p[:, language._trigrams(np.frombuffer(language.visible(raw), np.uint8))].sum(1, dtype=np.float64)
        x = np.maximum(x - x.max(), -language.MOST)
        host = url.split("/")[2] if url else ""
        rows.append((i, host, language.declared_language(raw), x, np.rint(language.UNIT * np.exp(x) / np.exp(x).sum())))
    u, want = language.UNIT, {}
    for k, (i, host, said, x, own) in enumerate(rows):
        prior = None
        for level in (lambda h: 0, lambda h: h.split(".")[-1], lambda h: ".".join(["", *h.split(".")][-2:]), lambda h: h):
            others = sum((r[4] for j, r in enumerate(rows) if j != k and level(r[1]) == level(host)), np.zeros(70))
            prior = (others + u / 70) / (others.sum() + u) if prior is None else (others + language.KAPPA * u * prior) / (others.sum() + language.KAPPA * u)
        alike = sum((r[4] for j, r in enumerate(rows) if j != k and r[2] == said), np.zeros(70))
        everything = sum((r[4] for j, r in enumerate(rows) if j != k), np.zeros(70))
        total = x + np.log(prior) + np.log((alike + u / len({r[2] for r in rows})) / (everything + u))
        p = np.exp(total - total.max())
        want[i] = (names[int(p.argmax())], float((p / p.sum()).max()))
    assert len(got) == len(pages)
    for r in got:
        assert r.lang == want[r.page_id][0] and r.probability == pytest.approx(want[r.page_id][1], rel=1e-4)
    assert language.identify(spark.createDataFrame(pages, "page_id bigint, url string, html string").limit(0), spark.createDataFrame(docs, "doc_id bigint, text string, lang string")).count() == 0


def test_visible_text_in_one_pass():
    html = b"<html LANG=de><head><title>t</title></head><body><!-- c > --><p>one&amp;two</p><Script>x<y</SCRIPT >three<nav>n</nav >four < five"
    assert language.visible(html).split() == [b"one", b"two", b"three", b"four", b"<", b"five"] and language.declared_language(html) == "de"
    began = time.time()
    for junk in (b"<script ", b"<!-- ", b"<nav><", b"<head> ", b"&a"):
        assert language.visible(junk * 100_000) is not None
    language.declared_language(b"<html " * 100_000)
    assert time.time() - began < 10


# --- toxicity ----------------------------------------------------------------------


def toxic_rows(rng, n):
    rows, labels = [], []
    for i in range(n):
        words, bad = prose(rng, rng.randint(20, 80)).split(), i % 4 == 0
        if bad:
            for _ in range(4):
                words.insert(rng.randint(0, len(words)), rng.choice(["wretched", "vermin", "dunghead"]))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    rows, labels = toxic_rows(rng, 400)
    rows += [(1000, None, "s"), (1001, "", "s")]
    docs, marks = frame(spark, rows), spark.createDataFrame(labels + [(3, 1, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.learn(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 50 and np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.97
    assert got[1000].predicted == got[1001].predicted == 0 and all(0 <= r.score <= 1 for r in got.values())
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    assert {r.score for r in toxicity.score(docs, toxicity.learn(docs, marks.limit(0))).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0
    odd = frame(spark, [(None, "wretched vermin " * 3, "s"), (1, "wretched " * 60_000, "s")]).select("doc_id", "text", toxicity.held_out("doc_id").alias("h"))
    assert [r.h for r in odd.where("doc_id is null").collect()] == [False] and toxicity.score(odd, model).count() == 2
    hashed = docs.select("doc_id", toxicity.held_out("doc_id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in hashed)


def test_levels_are_isotonic():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=400), 1)
    y = rng.random(400) < 1 / (1 + np.exp(-3 * x))
    pools = toxicity.isotonic(x, y, np.ones(400))
    assert len(pools) > 3 and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pools, pools[1:], strict=False))
    at = np.searchsorted([p[0] for p in pools], x, "right") - 1
    for k, (_, p) in enumerate(pools):
        assert p == pytest.approx(y[at == k].mean())
    assert len(toxicity.isotonic(np.arange(400.0), np.arange(400) > 200, np.ones(400))) <= toxicity.LEVELS


def test_scores_match_a_recomputation_from_windows(spark):
    """Every window compressed by itself, its text folded by hand, the levels looked up one by one."""
    rng = random.Random(12)
    rows, labels = toxic_rows(rng, 200)
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.learn(docs, marks)
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(docs, model).collect()}
    ordinary, toxic = model.compressors()
    second = lambda b: bytes(x for c in b for x in (c, (c + 101) % 256))
    for i, text, _ in rows:
        found = [w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split()]
        hits = 0
        for w in found:
            window = bytes(64) + second(f" {w} ".encode())
            hits += len(ordinary(window)) - len(toxic(window)) >= model.threshold
        value = hits * np.log(1 + model.excess / (model.rate * len(found))) if hits else 0.0
        score = model.levels[0]
        for edge, level in zip(model.edges, model.levels[1:], strict=True):
            score = level if value >= edge else score
        assert got[i] == (pytest.approx(score), int(score >= 0.3)), i
    assert len(model.levels) > 1 and len({s for s, _ in got.values()}) > 1


def test_the_size_of_the_toxic_dictionary_is_chosen_by_unseen_rows(monkeypatch):
    rng = random.Random(13)
    texts, labels = toxic_rows(rng, 200)
    rows = [(i, t, bad) for (i, t, _), (_, _, bad) in zip(texts, labels, strict=True)]
    sizes = []
    calibrate = toxicity._calibrate
    monkeypatch.setattr(toxicity, "_calibrate", lambda m, *rest: sizes.append((calibrate(m, *rest), m)) or sizes[-1][0])
    model = toxicity.fit(rows, (100, 100))
    assert len(sizes) == len(toxicity.TOXIC_BYTES) and max(sizes, key=lambda x: x[0])[1] is model


def test_a_document_is_scored_by_hits_for_its_length():
    model = toxicity.Model(b"x", b"y", 5, 0.001, 3.0)
    assert model.statistic([9] * 3 + [0] * 50) > model.statistic([9] * 3 + [0] * 5000) > model.statistic([0] * 50) == 0


# --- the pipeline --------------------------------------------------------------------


def test_pipeline_stages_and_result(spark, tmp_path):
    rng = random.Random(7)
    rows, labels = toxic_rows(rng, 240)
    rows = [(i, t, "ab"[i % 2]) for i, t, _ in rows]
    clean = [i for i, _, _ in rows if i % 4]
    copy, leaky, secret = clean[3], clean[4], clean[5]
    rows.append((900, dict((i, t) for i, t, _ in rows)[copy], "a"))
    text = dict((i, t) for i, t, _ in rows)
    key = hashlib.sha1(b"k").hexdigest()
    rows = [(i, t + " " + ITEM if i == leaky else t + f" token = '{key}'" if i == secret else t, s) for i, t, s in rows]
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert not any(i % 4 == 0 and i < 240 for i in kept["toxicity"]) and len(kept["toxicity"]) > 170
    assert set(kept["toxicity"]) - set(kept["near_duplicates"]) == {900}
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == {leaky}
    assert set(kept["secrets"]) == set(kept["decontamination"]) and key not in kept["secrets"][secret]
    assert set(kept["mixing"]) <= set(kept["secrets"])
    assert text  # the stages only read the table
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_pipeline_of_odd_rows_and_of_nothing(spark, tmp_path):
    rng = random.Random(9)
    rows, labels = toxic_rows(rng, 60)
    odd = [(None, "no id at all", "a"), (700, None, "a"), (701, "", None), (702, " ", "b"), (703, "x" * 300_000, "b"), (704, "word " * 60_000, "a"), (5, rows[5][1], "s"), (5, rows[5][1], "s"), (5, "another text", "s"), (705, ITEM, "a")]
    clashing = "class_id bigint, key string, n_links bigint, row string, taken bigint, version bigint, spans string, rest string, copy int, words int, t string"
    names = [x.split()[0] for x in clashing.split(", ")]
    full = frame(spark, rows + odd).selectExpr("doc_id", "text", "lang", "source", "n_chars", *[f"cast(null as {x.split()[1]}) as {x.split()[0]}" for x in clashing.split(", ")])
    for name, docs in (("odd", full), ("none", full.limit(0))):
        path = f"{tmp_path}/{name}"
        docs.write.parquet(f"{path}/documents.parquet")
        marks = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
        items = spark.createDataFrame([(1, ITEM), (2, None), (None, "null id of an item in here")], "item_id bigint, text string")
        (marks if name == "odd" else marks.limit(0)).write.parquet(f"{path}/labels.parquet")
        (items if name == "odd" else items.limit(0)).write.parquet(f"{path}/benchmark.parquet")
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES:
            out = f(spark, docs, path)
            assert stage == "mixing" or out.columns == docs.columns
            out.write.parquet(f"{path}/{stage}")
            docs = spark.read.parquet(f"{path}/{stage}")
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            if stage != "mixing":
                assert ids == set() if name == "none" else {None, 700, 701, 702, 703, 704} <= ids
        assert name == "none" or (705 not in ids and 703 in ids and set(names) <= set(docs.columns))


def test_ids_of_any_type(spark):
    """Items, documents and labels named by strings."""
    item = "the quick brown fox jumps over one lazy dog near some quiet river bank today"
    docs = spark.createDataFrame([("d1", f"before it {item} after it"), ("d2", "nothing of the sort is said here at all")], "doc_id string, text string")
    bench = spark.createDataFrame([("q-1", item), (None, item)], "item_id string, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()] == [("d1", "q-1")]
    assert [r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()] == ["d2"]
    assert decontaminate.leaks(docs, bench.limit(0)).collect() == [] and decontaminate.without_leaks(docs, bench.limit(0)).count() == 2
    texts = [(f"d{i}", "vile scum filth " * 5 if i % 2 else "calm seas and fair winds " * 5) for i in range(80)]
    labels = spark.createDataFrame([(d, i % 2) for i, (d, _) in enumerate(texts)], "doc_id string, toxic int")
    frame = spark.createDataFrame(texts, "doc_id string, text string")
    scored = {r.doc_id: r.score for r in toxicity.score(frame, toxicity.learn(frame, labels)).collect()}
    assert min(scored[d] for i, (d, _) in enumerate(texts) if i % 2) > max(scored[d] for i, (d, _) in enumerate(texts) if not i % 2)
