"""Token counts, secrets, URLs, media and repeated passages against brute force on small fixtures."""

import hashlib
import math
import random
import re
import time
import zlib

import pytest

from memjobs.llm import media, secrets, substring, tokens, urls
from memjobs.llm.queries import URL_RULES, VOCABULARY

DOCS = "doc_id bigint, text string, lang string, version string, spans string"
ODD = [None, "", " \n\t", "a", "token = 'abc'", "x" * 5000, "é" * 700 + " word", "token=a:token=abcdefg SECRET: \"0123456789abcdef\" ſecret=abcdefgh", "AKIA" + "Z" * 16 + " AKIA123 " + "deadbeef" * 5]


def frame(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, None, "v", "s") for i, t in zip(ids, texts)], DOCS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def brute_secrets(text):
    text, out = text or "", []
    word = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])"
    for k, pattern, ok in ((0, word + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6), (1, "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), (2, "[0-9a-f]+", lambda m: len(m[0]) >= 24)):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if ok(m)]
    return sorted(out)


def test_secrets_match_brute_force(spark):
    rng = random.Random(1)
    bits = ["token", "Api_Key", "apikey", "secret", "PASSWD", "=", ":", " ", '"', "'", "abc", "0123456789abcdef" * 2, "AKIA", "QWERTY1234567890", "é", "\n", "face", "AKIA" * 6]
    texts = ODD + ["".join(rng.choices(bits, k=30)) for _ in range(300)]
    for r in secrets.scan(frame(spark, texts)).collect():
        base = brute_secrets(texts[r.doc_id])
        joined = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert not base or set(joined.split(",")) <= set(r.spans.split(","))


def brute_entropy_spans(text, base):
    """Candidates by hand, every window counted anew."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        w = m[0]
        covered = {i for s, _, e in base for i in range(max(s, m.start()), min(e, m.end()))}
        left = "".join("\n" if i in covered else text[i] for i in range(m.start(), m.end())).split("\n")
        if covered and all(secrets._is_plain(x) for x in left if x) or not (any(c.isdigit() for c in w) and any(c.isalpha() for c in w)):
            continue
        kind = "hex" if set(w) <= set("0123456789abcdefABCDEF") else "alphanumeric" if w.isalnum() else "base64"
        best = max(-sum(x.count(c) / 20 * math.log2(x.count(c) / 20) for c in set(x)) for x in (w[i : i + 20] for i in range(len(w) - 19)))
        allowed = any(p.search(w) for p in secrets.ALLOWED) or secrets.is_path(w)
        if best >= secrets.THRESHOLDS[kind] - 1e-9 and not allowed:
            out.append((m.start(), 3, m.end()))
    return out


def test_entropy_spans_match_brute_force():
    rng = random.Random(4)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    bits = [lambda: "".join(rng.choices(chars, k=rng.randint(5, 40))), lambda: "".join(rng.choices("0123456789abcdef", k=rng.randint(10, 30))), lambda: "token=abcdefgh", lambda: "path/to/file2", lambda: "aaaa1111" * 4, lambda: "word"]
    for _ in range(300):
        text = "".join(rng.choice(bits)() + rng.choice([" ", " ", "", "/", ":"]) for _ in range(12))
        base = secrets.base_spans(text)
        assert secrets.entropy_spans(text, base) == brute_entropy_spans(text, base)


def test_long_texts_scan_in_linear_time():
    text = ("token=abcdefgh1 q7Zk2LmX9vB4nT8wYcR3pD6s " * 20_000)[:-1]
    began = time.time()
    base = secrets.base_spans(text)
    assert len(base) == 20_000 and len(secrets.entropy_spans(text, base)) == 20_000 and time.time() - began < 15


def test_incremental_entropy_is_shannon():
    rng = random.Random(2)
    for _ in range(50):
        text = "".join(rng.choices("abcdef0123456789XYZ", k=rng.randint(20, 60)))
        def bits(w):
            return -sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w))
        assert secrets.largest_entropy(text) == pytest.approx(max(bits(text[i : i + 20]) for i in range(len(text) - 19)))


def test_entropy_finds_keys_and_leaves_words(spark):
    key = "q7Zk2LmX9vB4nT8wYcR3pD6s"
    r = secrets.scan(frame(spark, [f"the key {key} is here", "thanbleshaningtionntanderhea word", "550e8400-e29b-41d4-a716-446655440000 " + "example" + key])).orderBy("doc_id").collect()
    assert r[0].spans == f"entropy:8:{8 + len(key)}" and r[1].spans == "" and r[2].spans == ""


def test_keys_with_slashes_are_found_and_paths_left():
    rng = random.Random(3)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for n in (40, 64, 88, 200, 400):
        for first in ("", "/", "+", "ab//", "a/b/c/"):
            for _ in range(40):
                key = first + "".join(rng.choices(chars, k=n - len(first)))
                if secrets.character_class(key) == "base64" and secrets.largest_entropy(key) >= secrets.THRESHOLDS["base64"]:
                    assert secrets.entropy_spans(key, []) == [(0, 3, n)], key
    for path in ("/usr/lib/python3/dist-packages/numpy/core", "/home/maker/projects/2024/summer_photos/july", "--dry-run=1/2/export/monthly_figures"):
        assert secrets.largest_entropy(path) >= 3.0 and not secrets.entropy_spans(path, [])


def test_redaction_keeps_rows_and_columns(spark):
    docs = frame(spark, ODD)
    out = secrets.redact(docs)
    assert out.columns == docs.columns and out.count() == len(ODD)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[8].count("[SECRET]") == 2 and got[0] is None and got[5] == ODD[5]
    assert secrets.redact(docs.limit(0)).count() == 0


def brute_tokens(pieces, text):
    import regex

    total = 0
    for word in regex.findall(tokens.PRETOKEN, text or ""):
        b = word.encode()
        best = [(0.0, 0)] + [None] * len(b)
        for end in range(1, len(b) + 1):
            best[end] = max((best[i][0] + pieces[b[i:end]], best[i][1] - 1) for i in range(end) if b[i:end] in pieces)
        total -= best[-1][1]
    return total


def test_token_counts_match_plain_dynamic_programming(spark):
    pieces, _ = tokens.vocabulary(VOCABULARY)
    texts = ODD[:5] + ODD[6:] + ["The there then theory's 12345 çéñ 日本語 \x00", "again again again"]
    for bound in (400_000, 10):
        out = tokens.token_counts(frame(spark, texts).coalesce(1), VOCABULARY, bound)
        assert {r.doc_id: r.n_tokens for r in out.collect()} == {i: brute_tokens(pieces, t) for i, t in enumerate(texts)}


def test_both_engines_split_alike():
    import regex

    rng, whole = random.Random(9), regex.compile(tokens.PRETOKEN).findall
    latin = "".join(chr(i) for i in range(0x250) if not tokens._BEYOND(chr(i)))
    assert len(latin) > 570 and all(tokens._BEYOND(c) for c in "\x1c²½¹٣Ⅷ漢\u0301\u2003")
    for chars in (latin, latin + "²½Ⅷ漢\u0301\u2003\x1c"):
        for _ in range(400):
            text = "".join(rng.choices(chars + " '  sdmtlvre_-\n" * 20, k=150))
            assert tokens.pretokens(text) == whole(text)


def test_long_pretokens_count_alike_in_linear_time(spark):
    pieces, longest = tokens.vocabulary(VOCABULARY)
    rng = random.Random(5)
    trie = tokens.CountingTrie(pieces, longest)
    for n in (1, 7, 200, 300, 700):
        word = "".join(rng.choices("etaoinabc", k=n)).encode()
        assert trie._forward(word) == trie._insert(word)
    began = time.time()
    long = "".join(rng.choices("etaoinabc", k=300_000))
    out = tokens.token_counts(frame(spark, [long, "a b"]), VOCABULARY).collect()
    assert time.time() - began < 30 and sorted(r.n_pretokens for r in out) == [1, 2]
    assert tokens.token_counts(frame(spark, ["x"]).limit(0), VOCABULARY).count() == 0


def test_urls_of_odd_rows(spark):
    pages = spark.createDataFrame([(None, "http://x.org/a", "h"), (None, "http://x.org/a", "h")], "page_id bigint, url string, html string")
    rules = [("x.org", "/", "allow"), ("x.org", "/", "block"), ("x.org", "/", "allow")]
    assert [(r.rule, r.verdict) for r in urls.judge_urls(pages, rules).collect()] == [("x.org/", "block")] * 2
    assert urls.judge_urls(pages.limit(0), URL_RULES).count() == 0 and [r.verdict for r in urls.judge_urls(pages, []).collect()] == ["allow"] * 2


def test_urls_longest_rule_wins(spark):
    cases = {
        "http://WWW.Example.com/en/x?q": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "https://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"),
        "https://m.example.com/EN/": ("m.example.com", "/EN/", "com/", "allow"),
        "http://example.com": ("example.com", "", None, "allow"),
        "http://a.net/fr/1#x": ("a.net", "/fr/1", "net/fr/", "block"),
        "http://a.net:80/fr/1": ("a.net:80", "/fr/1", None, "allow"),
        "http://notnet/fr/": ("notnet", "/fr/", None, "allow"),
        "nothing": ("", "", None, "allow"), None: ("", "", None, "allow"), "x://": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(cases)], "page_id bigint, url string, html string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, URL_RULES).collect()}
    assert got == dict(enumerate(cases.values()))


def test_digest_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda s: 7)
    path = tmp_path / "rules"
    path.write_bytes(urls.digest_bytes([("a.com", "/", "allow"), ("b.com", "/x", "block"), ("b.co", "m/x", "allow")]))
    array = urls.DigestArray(str(path))
    found = array.probe([(b"b.com/x", 5), (b"a.com/", 5), (b"c.com/", 5)])
    assert [array.string(i) if i >= 0 else None for i in found] == [b"b.com/x", b"a.com/", None] and array.host_len[found[0]] == 5


def test_media_round_trip(spark):
    rng = random.Random(3)
    texts = ODD + ["".join(chr(rng.randint(32, 400)) for _ in range(n)) for n in (63, 64, 65, 4096, 4097, 20_000)]
    out = media.media_features(media.store_texts(frame(spark, texts))).collect()
    assert len(out) == len(texts)
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_media_reads_without_index_and_by_walking_tables():
    payload = bytes(range(256)) * 40
    avi = media.write_avi(payload)
    assert media.payload_of(avi)[0] == payload
    assert media.payload_of(avi[: avi.rindex(b"idx1")])[0] == payload
    frame_ = media.read_frames(avi)[0][0]
    other = frame_.replace(b"\xff\xda", b"\xff\xdd\0\4\xff\xff\xff\xda", 1)  # with a restart interval, so by the tables
    assert (media.decode_frame(other)[::8, ::8].tobytes()) == payload[:4096]
    with pytest.raises(ValueError):
        media.read_frames(b"RIFF....WAVE")


def encode_jpeg(blocks, width, height, parts, interval=0):
    """A plain encoder: blocks by unit of (part, 64 coefficients in zigzag order); codes of 4 bits for DC, 8 for AC."""
    bits, out, before = "", [], [0] * len(parts)
    ac = [r << 4 | s for r in range(16) for s in range(11)]
    def number(v):
        n = abs(v).bit_length()
        return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""
    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    scan, units = b"", 0
    for unit in blocks:
        if interval and units and units % interval == 0:
            scan += flush(bits) + bytes([255, 0xD0 + (units // interval - 1) % 8])
            bits, before = "", [0] * len(parts)
        units += 1
        for part, c in unit:
            n, raw = number(c[0] - before[part])
            before[part] = c[0]
            bits += format(n, "04b") + raw
            run = 0
            last = max((k for k in range(1, 64) if c[k]), default=0)
            for k in range(1, last + 1):
                if not c[k]:
                    run += 1
                    if run == 16:
                        bits, run = bits + format(ac.index(0xF0), "08b"), 0
                    continue
                n, raw = number(c[k])
                bits, run = bits + format(ac.index(run << 4 | n), "08b") + raw, 0
            if last < 63:
                bits += format(ac.index(0), "08b")
    scan += flush(bits)
    def seg(m, body):
        return bytes([255, m]) + (len(body) + 2).to_bytes(2, "big") + body
    sof = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(parts)]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(parts))
    sos = bytes([len(parts)]) + b"".join(bytes([i + 1, 0]) for i in range(len(parts))) + b"\0\x3f\0"
    dht = b"\0" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12)) + b"\x10" + bytes([0] * 7 + [len(ac)] + [0] * 8) + bytes(ac)
    dri = seg(0xDD, interval.to_bytes(2, "big")) if interval else b""
    out = [b"\xff\xd8", seg(0xE0, b"JFIF\0"), seg(0xDB, b"\0" + bytes(range(1, 65))), seg(0xC0, sof), seg(0xC4, dht), dri, seg(0xDA, sos), scan, b"\xff\xd9"]
    return b"".join(out)


@pytest.mark.parametrize("parts,interval", [([(1, 1)], 0), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 2), ([(1, 1), (1, 1), (1, 1)], 1)])
def test_frames_of_other_encoders(parts, interval):
    rng = random.Random(len(parts) * 10 + interval)
    h, v = parts[0] if len(parts) > 1 else (1, 1)
    width, height = 37, 29
    wide, high = -(-width // (8 * h)), -(-height // (8 * v))
    units, luma = [], {}
    for y in range(high):
        for x in range(wide):
            unit = []
            for part, (ph, pv) in enumerate(parts):
                for b in range(ph * pv if len(parts) > 1 else 1):
                    c = [rng.randint(-300, 300)] + [rng.choice([0, 0, 0, rng.randint(-9, 9)]) for _ in range(63)]
                    unit.append((part, c))
                    if part == 0:
                        luma[y * v + b // h, x * h + b % h] = c
            units.append(unit)
    got = media.decode_frame(encode_jpeg(units, width, height, parts, interval))
    assert got.shape == (height, width)
    order = [(0, 0)]  # the zigzag walk, step by step
    while len(order) < 64:
        r, c = order[-1]
        if (r + c) % 2 == 0:
            order.append((r, c + 1) if r == 0 and c < 7 else (r + 1, c) if c == 7 else (r - 1, c + 1))
        else:
            order.append((r + 1, c) if c == 0 and r < 7 else (r, c + 1) if r == 7 else (r + 1, c - 1))
    for y, x in ((0, 0), (5, 9), (28, 36), (13, 30), (20, 2)):
        c, total = luma[y // 8, x // 8], 0.0
        for k, (i, j) in enumerate(order):
            scale = (0.5**0.5 if i == 0 else 1) * (0.5**0.5 if j == 0 else 1) / 4
            total += scale * c[k] * (k + 1) * math.cos((2 * (y % 8) + 1) * i * math.pi / 16) * math.cos((2 * (x % 8) + 1) * j * math.pi / 16)
        assert abs(int(got[y, x]) - min(255, max(0, total + 128))) <= 1


def test_null_and_broken_media(spark):
    good = media.write_avi(b"x" * 64)
    cut = good[: good.index(b"\xff\xda") + 4]
    table = [(1, 64, good), (2, 1, None), (3, 1, b""), (4, 1, b"RIFF1234AVI nothing"), (5, 1, cut), (6, 1, good.replace(b"\xff\xc0", b"\xff\xc2"))]
    df = spark.createDataFrame(table, "doc_id bigint, n_bytes bigint, media binary")
    got = {r.doc_id: r for r in media.media_features(df).collect()}
    assert got[1].payload_bytes == 64 and got[2].feature is None and got[2].media_bytes is None
    assert all(got[i].feature == "broken" and got[i].payload_sha256 is None and got[i].media_bytes == len(table[i - 1][2]) for i in (3, 4, 5, 6))
    assert {r.doc_id for r in media.clips(df).collect()} == {1}
    assert media.media_features(media.store_texts(frame(spark, ["x"]).limit(0))).count() == 0


def test_shots_cut_where_the_picture_changes(spark):
    dark, bright = bytes([10] * 4096), bytes([200] * 4096)
    df = spark.createDataFrame([(1, media.write_avi(dark * 10 + bright * 5)), (2, None)], "doc_id bigint, media binary")
    assert [(r.shot, r.first_frame, r.end_frame, r.start_s, r.end_s) for r in media.clips(df).collect()] == [(0, 0, 10, 0.0, 0.4), (1, 10, 15, 0.4, 0.6)]


def brute_repeats(docs, window):
    words = {i: (t or "").split() for i, t in docs}
    first = {}
    for i, w in words.items():
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


@pytest.mark.parametrize("window,seed", [(10, 4), (12, 12), (50, 20)])
def test_repeats_match_brute_force(spark, window, seed):
    rng = random.Random(window)
    passages = [[f"p{p}w{i}" for i in range(rng.randint(window - 2, 3 * window))] for p in range(6)]
    docs = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, window // 2)
            words += [f"d{i}r{rng.randint(0, 99)}" for _ in range(rng.randint(0, 8))] + p[a : len(p) - rng.randint(0, 5)]
        docs.append((i, " ".join(words)))
    docs += [(60, docs[3][1]), (61, "la " * 40 * 3), (62, "la " * 120), (63, None), (64, "")]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(frame(spark, [t for _, t in docs]), window, seed).collect()}
    assert got == brute_repeats(docs, window)


def test_repeats_with_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    got = substring.remove_repeats(frame(spark, [text, text, text, "other"], [None, 5, 5, 5]), 50).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(0, 60, 0), (5, 1, 0), (5, 60, 0), (5, 60, 0)]
    assert substring.remove_repeats(frame(spark, ["x"]).limit(0)).count() == 0


def test_alike_words_are_told_apart(spark):
    """Words that cancel under polynomial hashes, and words that differ far behind their start."""
    tm = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    other = tm.translate(str.maketrans("ab", "ba"))
    pair = [" ".join([f"w{i}" for i in range(59)] + [w]) for w in (tm, other)]
    far = [" ".join([f"v{i}" for i in range(30)] + ["x" * 65_536 + w + "y" * 65_536] + [f"u{i}" for i in range(29)]) for w in ("ab", "ba")]
    texts = [*pair, *far]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(frame(spark, texts), 50).collect()}
    assert got == brute_repeats(list(enumerate(texts)), 50) and got[1][1] == 59 and got[3][1] == 0
    named = frame(spark, texts[:2]).selectExpr("cast(doc_id as string) doc_id", "text")
    assert sorted(r.n_removed for r in substring.remove_repeats(named, 50).collect()) == [0, 59]


def test_words_that_collide_under_one_hash_stay(spark):
    """Two words of one first hash, each the fiftieth of a window: nothing repeats."""
    start = " ".join(f"w{i}" for i in range(49))
    texts = [f"{start} zTpJPB-6!!!!@!!!", f"{start} wKuDna0H2-D/oALk"]
    assert [r.n_removed for r in substring.remove_repeats(frame(spark, texts)).collect()] == [0, 0]
    assert rows(substring.remove_repeats(frame(spark, [*texts, texts[0]])).select("doc_id", "n_removed")) == [(0, 0), (1, 0), (2, 50)]


def test_vocabularies_of_one_name_are_told_apart(spark, tmp_path):
    import base64

    counts = []
    for folder, pieces in (("a", [b"abab"]), ("b", [])):
        lines = [base64.b64encode(p) + b" " + str(i).encode() for i, p in enumerate([*pieces, *(bytes([b]) for b in range(256))])]
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "v.tiktoken").write_bytes(b"\n".join(lines))
        counts.append(tokens.token_counts(frame(spark, ["abab"]), str(tmp_path / folder / "v.tiktoken")).first().n_tokens)
    assert counts == [1, 4]


def test_keys_that_a_pattern_covers_in_part_go_whole(spark):
    tail = "Zq9/Xk2LmP0vTr7WsY4uBn8Hd3Gf6Jc1"
    texts = ["deadbeef" * 3 + tail, "x7Kp2mQ9Zr" + "AKIA" + "Q7Z2" * 4 + "q8Lw3nVb5T", "my_token=abcd1234", "deadbeef" * 3 + "_key"]
    got = [r.text for r in secrets.redact(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["[SECRET]", "[SECRET]", "my_[SECRET]", "[SECRET]_key"]
    assert brute_secrets(texts[0]) == [(0, 2, 24)] and secrets.entropy_spans(texts[0], brute_secrets(texts[0])) == [(0, 3, 56)]


def test_a_url_of_very_many_labels_is_judged_in_little_memory(spark):
    import tracemalloc

    host = "a." * 50_000 + "example.com"
    got = urls.judge_urls(spark.createDataFrame([(1, f"http://{host}/en/x"), (2, f"http://{'b' * 200_000}/")], "page_id bigint, url string"), URL_RULES)
    assert [(r.rule, r.verdict) for r in got.orderBy("page_id").collect()] == [("example.com/en/", "block"), (None, "allow")]
    tracemalloc.start()
    assert len(urls._suffixes(host.encode(), 15)) == 4
    assert tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()
