"""Benchmark decontamination by canonical templates.

Texts become tokens: letters and digits, case folded; a number with inner
points or commas (3.5, 1,000) is one token.  Numbers, names (capital letters)
and units (after a number) become typed placeholders, so that ``Anna has 3 kg``
and ``Peter has 7 g`` share a template.  A capitalised word that opens a sentence
may be a name or not: there are two templates, and texts are joined on either.
Windows of ``n`` template tokens, at least half of them literal, are hash-joined
with the windows of the benchmark items.  Windows with more slots, and items of
fewer than ``shortest`` tokens, are joined on their literal tokens instead, so
that verbatim passages of any make-up are found.  Template matches of one item in one document
are then held together, over all their alignments: the slot values under the
placeholders must map item to document consistently, one value always to the
same other.  Alignments that contradict the longest ones make up a reading of
their own, as of a second copy.  A document holds an item if one reading covers
``share`` of the item's tokens, or ``enough`` of them.

The benchmark is a table of any size.  Its windows are rows (hash, item, place).
One pass over the documents hashes their windows too and keeps those that a
Bloom filter of at most 2**26 bits lets through; Spark joins them with the
items' windows on the hash.  Pairs of text and item whose joined windows can't
cover enough of the item are left out there; the others are checked token by
token, where the text lies.  The smaller side of a join is broadcast below
``BROADCAST`` bytes, else the join is salted.

Defined cases.  Null or empty texts and items match nothing.  Items shorter
than ``n`` tokens are one window of their own length; those of fewer than
``shortest`` tokens are too unspecific for a template and match verbatim only.  Repeated items and
rows are reported each.  Ids of items and documents may be of any type; an item
without one is left out.  Long texts are scanned whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memjobs.llm._shared import written
from memjobs.llm._words import SEQUENCE_BASES, Sequences, mix, text_blocks, words_of
from memjobs.llm.minhash import folded

N, SHARE, ENOUGH, SHORTEST = 8, 0.5, 13, 5
BROADCAST = 32 << 20  # bytes, as JSON, of what a join may broadcast
LANES, CHUNK = 16, 256  # salts of a join beyond that; items that one row of candidates holds, about
_LEAST_BITS, _MOST_BITS = 15, 26  # of the Bloom filter, as powers of two
_KINDS = {"inside": SHORTEST, "opened": SHORTEST, "literal": 1}  # kinds of windows, with the least tokens of an item that has them

# Units of measure that follow numbers.
UNITS = (
    "mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "cl", "l", "s", "sec", "min", "h", "hour", "hours", "day", "days", "week", "weeks", "month",
    "months", "year", "years", "percent", "pct", "eur", "usd", "euro", "euros", "dollar", "dollars", "cent", "cents", "mph", "kmh", "kw", "kwh",
    "mb", "gb", "tb", "inch", "inches", "foot", "feet", "mile", "miles", "pound", "pounds", "ounce", "ounces",
)
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x1001, 0x1002, 0x1003))
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_INNER = np.zeros(256, bool)
_INNER[[44, 46]] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 58, 63, 10]] = True


def _words_of_text(data, offsets):
    """Words; a point or comma between two digits of one text belongs to the number."""
    out = folded(data)
    inner = np.zeros(len(data), bool)
    inner[1:-1] = _INNER[data[1:-1]] & _DIGIT[data[:-2]] & _DIGIT[data[2:]]
    edges = np.concatenate((offsets, offsets - 1))
    inner[edges[(edges >= 0) & (edges < len(data))]] = False
    out[inner] = data[inner]
    return words_of(out, offsets)


_joined = " ".join(UNITS).encode()
_UNIT_HASHES = np.sort(_words_of_text(np.frombuffer(_joined, np.uint8), np.array([0, len(_joined)])).hash)


def _member(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return table[at] == x if len(table) else np.zeros(len(x), bool)


class Templates:
    """The tokens of a block: literal hashes, and by kind of template the hashes and what is a slot.

    In ``opened`` templates a capitalised word that opens a sentence is a name, in ``inside`` ones a literal.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        w = _words_of_text(data, offsets)
        self.doc, self.value = w.doc, w.hash
        n = len(w.hash)
        digits, stops = (np.concatenate(([0], np.cumsum(t[data], dtype=np.int64))) for t in (_DIGIT | _INNER, _STOP))
        number = (digits[w.end] - digits[w.start]) == (w.end - w.start)
        first = np.ones(n, bool)
        first[1:] = (self.doc[1:] != self.doc[:-1]) | (stops[w.start[1:]] > stops[w.end[:-1]])
        head = data[w.start]
        following = data[np.minimum(w.start + 1, max(len(data) - 1, 0))] if n else head
        capital = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (following >= 0x80) & (following <= 0x9E) & (following != 0x97))
        unit = np.zeros(n, bool)
        unit[1:] = number[:-1] & (self.doc[1:] == self.doc[:-1])
        unit &= _member(w.hash, _UNIT_HASHES)
        self.slot, self.template, self.slots_before, self.sequences = {}, {}, {}, {}
        for kind, name in (("inside", capital & ~first & ~number), ("opened", capital & ~number)):
            self.slot[kind] = number | name | unit
            self.template[kind] = mix(np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, w.hash))))
            self.slots_before[kind] = np.concatenate(([0], np.cumsum(self.slot[kind], dtype=np.int64)))

    def tokens(self, kind: str) -> np.ndarray:
        return self.value if kind == "literal" else self.template[kind]

    def windows(self, kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first token, hash) of the windows inside one text with at least half of their tokens literal.

        ``literal``: the hash of the tokens themselves, for the windows that ``inside`` templates leave out and all that are too short for one.
        """
        literal = kind == "literal"
        if kind not in self.sequences:
            self.sequences[kind] = Sequences(self.tokens(kind), SEQUENCE_BASES[0 if literal else 1])
        grams = self.sequences[kind].grams(n)
        m = len(grams)
        before = self.slots_before["inside" if literal else kind]
        few = 2 * (before[n : n + m] - before[:m]) <= n
        at = np.flatnonzero((self.doc[:m] == self.doc[n - 1 : n - 1 + m]) & ((~few | (n < SHORTEST)) if literal else few))
        return at, grams[at]


def _item_windows(t: Templates, size: np.ndarray, n: int):
    """(kind, length, first tokens, hashes) of the windows of items that documents are joined on; ``size`` has the tokens of each item."""
    for kind, least in _KINDS.items():
        for length in sorted({n} | {int(x) for x in size if least <= x < n}):
            at, h = t.windows(kind, length)
            own = size[t.doc[at]]
            keep = own == length if length < n else own >= n
            if keep.any():
                yield kind, length, at[keep], h[keep]


class Items:
    """A few benchmark items, ready to be probed."""

    def __init__(self, rows: list[tuple], n: int):
        rows = sorted(rows)
        raw = [t.encode() for _, t in rows]
        data = np.frombuffer(b"".join(raw), np.uint8)
        offsets = np.cumsum([0] + [len(x) for x in raw])
        self.keys = [r[0] for r in rows]
        self.t = Templates(data, offsets)
        self.begin = np.searchsorted(self.t.doc, np.arange(len(rows) + 1))
        self.size = np.diff(self.begin)
        self.by_length = {kind: {} for kind in _KINDS}
        for kind, length, at, h in _item_windows(self.t, self.size, n):
            order = np.argsort(h, kind="stable")
            self.by_length[kind][length] = (h[order], at[order])


class _Reading:
    """Alignments of an item in a document under one mapping of slot values: one value always meets the same other, both ways."""

    def __init__(self):
        self.there: dict[int, int] = {}
        self.back: dict[int, int] = {}
        self.covered: set[int] = set()
        self.slots: set[int] = set()

    def takes(self, pairs: list[tuple[int, int]], tokens: set[int], slotted: list[int]) -> bool:
        there: dict[int, int] = {}
        back: dict[int, int] = {}
        for a, b in pairs:
            if self.there.get(a, b) != b or self.back.get(b, a) != a or there.setdefault(a, b) != b or back.setdefault(b, a) != a:
                return False
        self.there |= there
        self.back |= back
        self.covered |= tokens
        self.slots.update(slotted)
        return True


def _matches(t: Templates, items: Items, share: float, enough: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """By document of the block: (item, n_covered, n_item, n_slots)."""
    runs: dict[tuple[int, int], dict[tuple[str, int], set[int]]] = {}
    for kind, lengths in items.by_length.items():
        of_doc, of_item = (x.tokens(kind) for x in (t, items.t))
        for length, (hashes, starts) in lengths.items():
            at, h = t.windows(kind, length)
            hit = np.flatnonzero(_member(h, hashes))
            lo, hi = np.searchsorted(hashes, h[hit], "left"), np.searchsorted(hashes, h[hit], "right")
            for i, a, b in zip(at[hit].tolist(), lo.tolist(), hi.tolist(), strict=True):
                for s in starts[a:b].tolist():
                    if np.array_equal(of_doc[i : i + length], of_item[s : s + length]):
                        tokens = runs.setdefault((int(t.doc[i]), int(items.t.doc[s])), {}).setdefault((kind, i - s), set())
                        tokens.update(range(s, s + length))
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    for (doc, item), lines in runs.items():
        n = int(items.size[item])
        left = []
        for (kind, shift), tokens in sorted(lines.items(), key=lambda x: (-len(x[1]), x[0])):
            places = np.array(sorted(tokens))
            slotted = places[items.t.slot["inside" if kind == "literal" else kind][places]]
            left.append((list(zip(items.t.value[slotted].tolist(), t.value[slotted + shift].tolist(), strict=True)), tokens, slotted.tolist()))
        # Readings in turn, the longest alignment first, as long as what no reading holds could be enough.
        while left and _enough(len(set().union(*(x[1] for x in left))), n, share, enough):
            reading = _Reading()
            left = [x for x in left if not reading.takes(*x)]
            if _enough(len(reading.covered), n, share, enough):
                out.setdefault(doc, []).append((items.keys[item], len(reading.covered), n, len(reading.slots)))
            if not reading.covered or _enough(len(reading.covered), n, share, enough):
                break
    return out


def _enough(covered: int, n: int, share: float, enough: int) -> bool:
    return covered > 0 and (covered >= share * n or covered >= enough)


def _join_key(h: np.ndarray, kind: str, length: int) -> np.ndarray:
    """Windows of different kinds or lengths never meet."""
    salt = (1 + list(_KINDS).index(kind) + len(_KINDS) * length) * SEQUENCE_BASES[1]
    return mix(h + np.uint64(salt % (1 << 64)))


def _windows_of_items(n: int):
    """Rows (item, text) -> a row for each window: item, h, kind, length, start, n_item."""

    def job(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                t = Templates(data, offsets)
                begin = np.searchsorted(t.doc, np.arange(hi - lo + 1))
                size = np.diff(begin)
                for kind, length, at, h in _item_windows(t, size, n):
                    of = t.doc[at]
                    fixed = [pa.array([x] * len(at), k) for x, k in ((kind, pa.string()), (length, pa.int32()))]
                    places = [pa.array(x.astype(np.int32)) for x in (at - begin[of], size[of])]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + of)), pa.array(_join_key(h, kind, length).view(np.int64)), *fixed, *places], names=["item", "h", "kind", "length", "start", "n_item"])

    return job


def _pack(table: pa.Table) -> pa.Table:
    bits = np.zeros(1 << _LEAST_BITS, bool)
    bits[table["bit"].to_numpy()] = True
    return pa.table({"slab": table["slab"][:1].cast(pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()])})


def _bloom(windows: DataFrame) -> tuple[np.ndarray, int]:
    """The packed bits and their power of two: two positions for each hash, 16 bits for a hash while ``_MOST_BITS`` allow it."""
    n = windows.select("h").distinct().count()
    power = min(max((16 * n).bit_length(), _LEAST_BITS), _MOST_BITS)
    mask = F.lit((1 << power) - 1)
    position = F.explode(F.array(F.shiftrightunsigned("h", 64 - power), F.shiftrightunsigned("h", 64 - 2 * power).bitwiseAND(mask)))
    at = windows.select(position.alias("p")).distinct().select(F.shiftright("p", _LEAST_BITS).alias("slab"), F.col("p").bitwiseAND(F.lit((1 << _LEAST_BITS) - 1)).alias("bit"))
    out = np.zeros((1 << power - _LEAST_BITS, 1 << _LEAST_BITS - 3), np.uint8)
    for r in at.groupBy("slab").applyInArrow(_pack, "slab bigint, bits binary").collect():
        out[r.slab] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.reshape(-1), power


def _held(bits: np.ndarray, power: int, h: np.ndarray) -> np.ndarray:
    """The places in ``h`` that the filter lets through."""
    at = np.arange(len(h))
    for shift, mask in ((64 - power, 0xFFFFFFFFFFFFFFFF), (64 - 2 * power, (1 << power) - 1)):
        p = ((h[at] >> np.uint64(shift)) & np.uint64(mask)).astype(np.int64)
        at = at[(bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1]
    return at


def _hits(bloom, lengths: list[tuple[str, int]]):
    """Rows (key, text) -> (key, h) for the distinct windows of a text that pass the filter; ``bloom`` is a broadcast."""

    def job(batches):
        bits, power = bloom.value
        for batch in batches:
            for lo, _, data, offsets in text_blocks(batch.column(1)):
                t = Templates(data, offsets)
                docs, keys = [], []
                for kind, length in lengths:
                    at, h = t.windows(kind, length)
                    h = _join_key(h, kind, length)
                    passed = _held(bits, power, h)
                    docs.append(t.doc[at[passed]])
                    keys.append(h[passed])
                doc, h = np.concatenate(docs), np.concatenate(keys)
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
                if len(h):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + doc[new])), pa.array(h[new].view(np.int64))], names=["key", "h"])

    return job


def _verified(n: int, share: float, enough: int):
    """Rows (doc_id, key, text, items) -> a row for each of the items that the text holds."""

    def job(batches):
        for batch in batches:
            found, row = [], []
            for i, (text, items) in enumerate(zip(batch.column(2), batch.column(3).to_pylist(), strict=True)):
                raw = text.as_py().encode()
                hits = _matches(Templates(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])), Items([(x["item"], x["text"]) for x in items], n), share, enough)
                found += hits.get(0, [])
                row += [i] * len(hits.get(0, []))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32())
            ids = [batch.column(c).take(pa.array(row, pa.int64())) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array([h[c] for h in found], k) for c, k in enumerate(kinds))], names=["doc_id", "key", "item", "n_covered", "n_item", "n_slots"])

    return job


def _meet(left: DataFrame, key: Column, right: DataFrame, on: str, spread: Column, most: int, how: str = "inner") -> DataFrame:
    """``left`` with the written table ``right``, which is broadcast up to ``most`` bytes.

    Beyond that the join is salted by ``spread``, as one key may hold a third of ``left``.
    """
    size = right.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]
    if size <= most:
        return left.join(F.broadcast(right), key == right[on], how)
    dealt = right.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1)))).hint("merge")
    return left.join(dealt, (key == dealt[on]) & (F.pmod(F.xxhash64(spread), F.lit(LANES)) == dealt["lane"]), how)


def _candidates(docs: DataFrame, benchmark: DataFrame, n: int, share: float, enough: int, most: int) -> DataFrame:
    """key, items (item, text): which items a text, named by its digest, might hold; a text of very many has several rows."""
    items = written(benchmark.where("item_id is not null and text is not null").select(F.md5("text").alias("item"), "text").dropDuplicates(["item"]))
    windows = written(items.select("item", "text").mapInArrow(_windows_of_items(n), "item string, h bigint, kind string, length int, start int, n_item int"))
    lengths = sorted((r.kind, r.length) for r in windows.select("kind", "length").distinct().collect())  # at most n of a kind
    windows = windows.drop("kind")
    texts = docs.select(F.md5("text").alias("key"), "text").where("text is not null")
    if not lengths:
        texts, lengths = texts.limit(0), [("inside", n)]
    bloom = docs.sparkSession.sparkContext.broadcast(_bloom(windows))  # 8 MB at most
    hits = texts.mapInArrow(_hits(bloom, lengths), "key string, h bigint")
    joined = _meet(hits.withColumnRenamed("h", "hit"), F.col("hit"), windows, "h", F.col("key"), most)
    whole = joined.groupBy("key", "item").agg(F.first("n_item").alias("n_item"), F.collect_set(F.struct("start", "length")).alias("places"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1)))))
    pairs = written(whole.where((covered >= share * F.col("n_item")) | (covered >= enough)).select("key", F.col("item").alias("of")))
    sided = _meet(pairs, F.col("of"), items, "item", F.col("key"), most).select("key", "item", "text")
    chunks = F.ceil(F.count("*").over(Window.partitionBy("key")) / CHUNK)
    dealt = sided.withColumn("chunk", F.pmod(F.xxhash64("item"), chunks))
    return written(dealt.groupBy("key", "chunk").agg(F.collect_list(F.struct("item", "text")).alias("items")).select(F.col("key").alias("met"), "items"))


def _found(docs: DataFrame, benchmark: DataFrame, n: int, share: float, enough: int, most: int) -> DataFrame:
    """doc_id, key, item, n_covered, n_item, n_slots."""
    texts = docs.select("doc_id", F.md5("text").alias("key"), "text")
    asked = _meet(texts, F.col("key"), _candidates(docs, benchmark, n, share, enough, most), "met", F.col("doc_id"), most)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return asked.select("doc_id", "key", "text", "items").mapInArrow(_verified(n, share, enough), f"doc_id {kind}, key string, item string, n_covered int, n_item int, n_slots int")


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = N, share: float = SHARE, enough: int = ENOUGH, most: int = BROADCAST) -> DataFrame:
    """One row for each document and benchmark item that it holds: doc_id, item_id, n_covered, n_item, n_slots."""
    ids = written(benchmark.where("item_id is not null and text is not null").select("item_id", F.md5("text").alias("of")))
    found = _found(docs, benchmark, n, share, enough, most)
    return _meet(found, F.col("item"), ids, "of", F.col("key"), most).select("doc_id", "item_id", "n_covered", "n_item", "n_slots")


def without_leaks(docs: DataFrame, benchmark: DataFrame, n: int = N, share: float = SHARE, enough: int = ENOUGH, most: int = BROADCAST) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    gone = written(_found(docs, benchmark, n, share, enough, most).select(F.col("key").alias("gone")).distinct())
    return _meet(docs, F.md5(docs["text"]), gone, "gone", docs["doc_id"], most, "left_anti")
