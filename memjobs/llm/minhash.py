"""Near-duplicate documents by improved consistent weighted sampling (ICWS).

Texts become word shingles (five words; letters and digits, case folded, so a
comma or a capital does not make a new word).  A shingle weighs its count in
the text times a damped inverse document frequency: ``1 - idf_share`` plus
``idf_share`` times the mean idf of its words, scaled to 1.  The document
frequencies come from all documents, in a hashed table of fixed size.  The
damping keeps copies together where the copies themselves fill the corpus.

Each distinct text draws ``bands * rows`` ICWS samples; texts that agree on all
samples of a band meet in a bucket.  A link is a pair of texts whose exact
weighted Jaccard similarity is at least the threshold.  Classes are the
connected components of links and exact copies.

One plan serves buckets of any size.  Every member of a bucket is compared with
the bucket's leader, the text that shares most buckets with others.  Then only
buckets are left whose other members lie in several components.  There every
pair of two components is verified, or ruled out by its weights or by an
outline whose bound is at least the similarity.  Large buckets are dealt into
blocks for this, by texts and by bytes; members of the bucket's largest component meet only those of
the others.  A pair is judged in the first bucket it shares, and no more once
links have joined its components.

A bucket with more than a block of texts outside its largest component is
crowded, as by pages of one template that are too unlike for a link.  Its texts
meet by their rarest shingles instead: shingles in order of rarity, up to where
the rest weighs less than the threshold's share of the text.  Two texts of the
threshold's similarity share one of these, so the split is exact, and texts that
share only the template no longer meet.  So no pair of a bucket is lost; only
texts that share no bucket are left to chance (0.001 of pairs at 0.8).

Defined cases.  Null and blank texts and null ids belong to no class but their
own.  Texts under five words are one shingle.  Texts without any word link to
exact copies only.  Repeated rows share a class.  Texts that share a doc_id are
told apart by their digest.  Very long texts are read whole, and a block of a
bucket holds about ``BLOCK_BYTES`` of text or one text.  Ids may be of any ordered type.  Other columns are
ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memjobs.llm._shared import written
from memjobs.llm._words import Sequences, Words, mix, text_blocks, words_of
from memjobs.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 10, 3
IDF_SHARE = 0.2
SLOTS = 1 << 18
_PART = 1 << 14
_UNIT = 1 << 12  # idf is kept in whole 1/4096ths, so sums do not depend on their order
OUTLINE, BLOCK_TEXTS, BLOCK_BYTES = 256, 512, 32 << 20  # slots of an outline; texts and bytes of a block, about
LANES = 64  # tasks that first add up one part of the word table

_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def folded(data: np.ndarray) -> np.ndarray:
    """Letters and digits with ASCII and Latin-1 case folded; other ASCII becomes a space."""
    out = _FOLD[data]
    if len(out) > 1:
        upper = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][upper] += 0x20
    return out


def _folded_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    return words_of(folded(data), offsets)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64)


def _words_once(w: Words, n_docs: int) -> np.ndarray:
    """The slots of a block's words, each once a document."""
    return np.unique((w.doc.astype(np.int64) << 18) | _slot(w.hash)) & (SLOTS - 1)


def _count_slots(slots_of):
    """Documents by slot, in this task: one row for each part of the table, and one (part -1) for the number of documents."""

    def job(batches):
        counts = np.zeros(SLOTS, np.int64)
        n = 0
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(0)):
                n += hi - lo
                counts += np.bincount(slots_of(_folded_words(data, offsets), hi - lo), minlength=SLOTS)
        if n:
            parts = counts.reshape(-1, _PART)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(parts)), -1)), pa.array([x.astype("<u8").tobytes() for x in parts] + [np.array([n], "<u8").tobytes()])], names=["part", "counts"])

    return job


def _add_up(batches):
    """Adds the counts of one part; the rows of a part come in batches."""
    parts: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(counts.as_py(), "<u8")
            parts[part] = parts[part] + x if part in parts else x
    yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], names=["part", "counts"])


def _slot_counts(texts: DataFrame, slots_of) -> tuple[int, np.ndarray]:
    """The number of texts, and of those by slot: a table of fixed size (``SLOTS``), whatever the corpus."""
    schema = "part bigint, counts binary"
    # A task adds up what it has counted, lanes of tasks add up parts of that, and 16 tasks the lanes; a table of fixed size goes to the driver.
    counted = texts.select("text").where("text is not null").mapInArrow(_count_slots(slots_of), schema)
    lanes = counted.repartition("part", F.pmod(F.spark_partition_id(), F.lit(LANES))).mapInArrow(_add_up, schema)
    summed = lanes.repartition(16, "part").mapInArrow(_add_up, schema)
    table = {r.part: np.frombuffer(bytes(r.counts), "<u8") for r in summed.collect()}
    return int(table[-1][0]) if -1 in table else 0, np.concatenate([table.get(i, np.zeros(_PART, "<u8")) for i in range(SLOTS // _PART)])


def word_weights(docs: DataFrame, idf_share: float = IDF_SHARE) -> np.ndarray:
    """Weight of each word slot in 1/4096ths."""
    n, counts = _slot_counts(docs, _words_once)
    idf = np.log((1 + n) / (1 + counts.astype(float))) / np.log(2 + n)
    return np.round(_UNIT * (1 - idf_share + idf_share * np.clip(idf, 0, 1))).astype(np.int32)


def _shingles(w: Words, n_docs: int, weights: np.ndarray):
    """For each document in turn: (distinct shingle hashes ascending, weights)."""
    seq = Sequences(w.hash)
    each = np.zeros(len(w.hash) + 1, np.int64)
    np.cumsum(weights[_slot(w.hash)], out=each[1:])
    bounds = np.searchsorted(w.doc, np.arange(n_docs + 1))
    grams = seq.grams(SHINGLE)
    for d in range(n_docs):
        a, b = bounds[d], bounds[d + 1]
        if b - a >= SHINGLE:
            g = grams[a : b - SHINGLE + 1]
            u, first, counts = np.unique(g, return_index=True, return_counts=True)
            yield u, counts * ((each[first + a + SHINGLE] - each[first + a]) / (SHINGLE * _UNIT))
        elif b > a:
            yield seq.span(np.array([a]), np.array([b])), np.array([(each[b] - each[a]) / ((b - a) * _UNIT)])
        else:
            yield np.zeros(0, np.uint64), np.zeros(0)


@functools.lru_cache(maxsize=1)
def _tables(samples: int):
    """Gamma(2, 1) quantiles for r and c, and a multiplier for each sample: fixed by a seed."""

    def quantiles(n: int) -> np.ndarray:
        p = (np.arange(n) + 0.5) / n
        lo, hi = np.zeros(n), np.full(n, 60.0)
        for _ in range(60):
            mid = (lo + hi) / 2
            below = 1 - np.exp(-mid) * (1 + mid) < p
            lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        return (lo + hi) / 2

    r, c = quantiles(1 << 12), quantiles(1 << 16)
    odd = np.random.default_rng(20).integers(1 << 62, 1 << 63, samples, dtype=np.uint64) | np.uint64(1)
    return r.astype(np.float32), (1 / r).astype(np.float32), np.log(c).astype(np.float32), odd[:, None]


def icws(u: np.ndarray, weights: np.ndarray, samples: int) -> np.ndarray:
    """The samples (k*, t*) of one weighted set, each as a 64-bit hash."""
    r_of, inverse_r, log_c, odd = _tables(samples)
    log_w = np.log(weights).astype(np.float32)
    best = np.full(samples, np.inf, np.float32)
    out = np.zeros(samples, np.uint64)
    every = np.arange(samples)
    for lo in range(0, len(u), 2048):
        x = u[lo : lo + 2048][None, :] * odd
        ri = ((x >> np.uint64(20)) & np.uint64(4095)).astype(np.intp)
        beta = ((x >> np.uint64(32)) & np.uint64(65535)).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(log_w[lo : lo + 2048] * inverse_r[ri] + beta)
        a = log_c[(x >> np.uint64(48)).astype(np.intp)] - r_of[ri] * (t - beta + np.float32(1))
        at = a.argmin(1)
        least = a[every, at]
        better = least < best
        best[better] = least[better]
        out[better] = (mix(u[lo + at] + odd[:, 0]) + t[every, at].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[better]
    return out


def _sketch(weights, bands: int, rows: int):
    """``weights`` is a broadcast."""

    def job(batches):
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for lo, hi, data, offsets in text_blocks(batch.column(2)):
                w = _folded_words(data, offsets)
                out = np.zeros((hi - lo, bands), np.uint64)
                empty = np.zeros(hi - lo, bool)
                salt = np.arange(bands, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
                for d, (u, x) in enumerate(_shingles(w, hi - lo, weights.value)):
                    empty[d] = not len(u)
                    if len(u):
                        s = icws(u, x, bands * rows).reshape(bands, rows)
                        key = salt.copy()
                        for i in range(rows):
                            key = mix(key + s[:, i])
                        out[d] = key
                values = pa.array(out.reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(empty, 0, bands)))).astype(np.int32)), values.filter(pa.array(np.repeat(~empty, bands))))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), keys.slice(lo, hi - lo), lists], names=["doc_id", "key", "bands"])

    return job


def weighted_jaccard(a, b) -> float:
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = float(np.minimum(a[1][i], b[1][j]).sum())
    total = float(a[1].sum() + b[1].sum()) - least
    return least / total if total > 0 else 0.0


def _sets(column, weights: np.ndarray):
    for lo, hi, data, offsets in text_blocks(column):
        yield from _shingles(_folded_words(data, offsets), hi - lo, weights)


def _verify(weights, threshold: float):
    """Rows (a, b, text_a, text_b) -> the links among them.  Consecutive rows of one b, the leader, share its set."""

    def job(batches):
        last, held = None, None
        for batch in batches:
            keys = batch.column(1).to_pylist()
            new = [x != y for x, y in zip(keys, [last, *keys], strict=False)]
            fresh = _sets(batch.column(3).filter(pa.array(new, pa.bool_())), weights.value)
            keep = []
            for a, is_new in zip(_sets(batch.column(2), weights.value), new, strict=True):
                held = next(fresh) if is_new else held
                keep.append(weighted_jaccard(a, held) >= threshold - 1e-9)
            last = keys[-1] if keys else last
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1)], names=["a", "b"])

    return job


def _settled(weights, threshold: float):
    """One block, or two, of a bucket -> the links that join components of it.

    Columns: key, component, band, bands, main, own, apart, text.  ``apart``
    tells whether members with one (main, own) have met in another block.  The
    least of two outlines, added up, is at least the common weight, so the
    bound on the similarity rules out no link.  ``band`` is -1 where texts met
    by a shingle, not by a band.
    """

    def job(table):
        table = table.combine_chunks()
        key, names = table["key"].to_pylist(), table["component"].to_pylist()
        band, apart = table["band"][0].as_py(), table["apart"][0].as_py()
        bands = np.array(table["bands"].to_pylist(), np.int64)
        side = table["own"].to_numpy() * 2 + np.array(table["main"].to_pylist(), np.int64)
        sets = list(_sets(table["text"].combine_chunks() if isinstance(table["text"], pa.ChunkedArray) else table["text"], weights.value))
        total = np.array([x.sum() for _, x in sets])
        outline = np.array([np.bincount((mix(u) >> np.uint64(56)).astype(np.int64), x, OUTLINE) for u, x in sets])
        component = np.unique(np.array(names), return_inverse=True)[1]
        low = threshold - 1e-6
        a, b = [], []
        for i in range(len(key) - 1):
            j = np.arange(i + 1, len(key))
            j = j[(component[j] != component[i]) & (np.minimum(total[j], total[i]) >= low * np.maximum(total[j], total[i]))]
            if apart:
                j = j[side[j] != side[i]]
            if band >= 0 and len(j):
                j = j[(bands[j] == bands[i]).argmax(1) == band]
            if not len(j):
                continue
            least = np.minimum(outline[j], outline[i]).sum(1)
            bound = least / (total[j] + total[i] - least)
            order = np.argsort(-bound, kind="stable")
            for o in order[bound[order] >= low].tolist():
                if component[j[o]] != component[i] and weighted_jaccard(sets[i], sets[j[o]]) >= threshold - 1e-9:
                    component[component == component[j[o]]] = component[i]
                    a.append(key[i])
                    b.append(key[j[o]])
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})

    return job


def _has_words(column) -> Column:
    return F.coalesce(F.col(column).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def _buckets(texts: DataFrame, *names: str) -> DataFrame:
    return texts.select("key", *names, F.posexplode("bands").alias("band", "bucket"))


def _first_links(texts: DataFrame, leaders: DataFrame, weights, threshold: float) -> DataFrame:
    """The links (a, b) of texts with the leaders of their buckets."""
    met = _buckets(texts).join(leaders, "bucket").where("key <> leader").groupBy("key").agg(F.collect_set("leader").alias("leaders"))
    mine = met.join(texts.select("key", F.col("text").alias("text_a")), "key").select(F.col("key").alias("a"), F.explode("leaders").alias("b"), "text_a")
    sided = mine.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    return written(sided.select("a", "b", "text_a", "text_b").mapInArrow(_verify(weights, threshold), "a string, b string"))


def _rarest(weights, counts, threshold: float):
    """Rows (key, text) -> (key, shingles): the rarest shingles of a text, of which it shares one with every text of that similarity."""

    def job(batches):
        for batch in batches:
            out = []
            for u, x in _sets(batch.column(1), weights.value):
                order = np.lexsort((u, counts.value[_slot(u)]))
                rest = x.sum() - np.cumsum(x[order])
                out.append(u[order[: 1 + int((rest >= (threshold - 1e-6) * x.sum()).sum())]].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["key", "shingles"])

    return job


def _mixed(members: DataFrame) -> DataFrame:
    """The buckets with members of several components: bucket, largest, and texts and bytes of all and of the largest component."""
    sizes = members.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    most = F.max(F.struct("n", "component", "bytes")).alias("most")
    several = sizes.groupBy("bucket").agg(F.count("*").alias("k"), F.sum("n").alias("n_all"), F.sum("bytes").alias("bytes_all"), most).where("k > 1")
    return several.select("bucket", F.col("most.component").alias("largest"), "n_all", "bytes_all", F.col("most.n").alias("n_main"), F.col("most.bytes").alias("bytes_main"))


def _split(members: DataFrame, crowded: DataFrame, texts: DataFrame, weights, threshold: float) -> DataFrame:
    """``members`` with those of crowded buckets dealt by their rarest shingles."""
    inside = written(members.join(crowded.select("bucket"), "bucket", "left_semi").select("key", "size", "component").distinct())
    held = texts.join(inside.select("key"), "key", "left_semi").select("key", "text")
    _, counts = _slot_counts(held, lambda w, n: _slot(np.concatenate([u for u, _ in _shingles(w, n, weights.value)])))
    counts = texts.sparkSession.sparkContext.broadcast(counts)  # a table of fixed size
    rarest = held.mapInArrow(_rarest(weights, counts, threshold), "key string, shingles array<bigint>")
    dealt = rarest.join(inside, "key").select("key", "size", F.lit(-1).alias("band"), F.explode("shingles").alias("bucket"), "component")
    # A shingle might equal a bucket of a band.
    apart = F.xxhash64(F.lit("shingle"), "bucket").alias("bucket")
    return members.join(crowded.select("bucket"), "bucket", "left_anti").select("key", "size", "band", "bucket", "component").union(dealt.select("key", "size", "band", apart, "component"))


def _later_links(texts: DataFrame, leaders: DataFrame, labels: DataFrame, weights, threshold: float) -> DataFrame:
    """The links (a, b) that join components of one bucket, of all its members but the leader."""
    named = texts.select("key", "bands", "size").join(labels, F.col("key") == F.col("node"), "left").select("key", "bands", "size", F.coalesce("component", "key").alias("component"))
    members = written(_buckets(named, "size", "component").join(leaders.where("n > 2"), "bucket").where("key <> leader").select("key", "size", "band", "bucket", "component"))
    several = written(_mixed(members))
    crowded = several.where(F.col("n_all") - F.col("n_main") > BLOCK_TEXTS)
    if not crowded.isEmpty():
        members = written(_split(members, crowded, texts, weights, threshold))
        several = written(_mixed(members))

    def blocks(n: Column, size: Column) -> Column:
        return F.ceil(F.greatest(n / BLOCK_TEXTS, size / BLOCK_BYTES))

    main = [F.col("n_main"), F.col("bytes_main")]
    rest = [F.col("n_all") - main[0], F.col("bytes_all") - main[1]]
    dealt = members.join(several, "bucket").withColumn("whole", blocks(F.col("n_all"), F.col("bytes_all")) <= 1).withColumn("main", (F.col("component") == F.col("largest")) & ~F.col("whole"))
    dealt = dealt.withColumn("mains", blocks(*main)).withColumn("others", F.when(F.col("whole"), F.lit(1)).otherwise(blocks(*rest)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("key"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))))

    def meeting(left, right, with_main) -> Column:
        return F.struct(left.cast("bigint").alias("left"), right.cast("bigint").alias("right"), F.lit(with_main).alias("with_main"))

    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    own = F.col("own")
    among = F.transform(upto(F.col("others")), lambda x: meeting(F.least(own, x), F.greatest(own, x), False))
    meetings = (
        F.when(F.col("main"), F.transform(upto(F.col("others")), lambda x: meeting(x, own, True)))
        .when(F.col("whole"), among)
        .otherwise(F.concat(among, F.transform(upto(F.col("mains")), lambda x: meeting(own, x, True))))
    )
    met = dealt.select("key", "band", "bucket", "component", "main", "own", F.explode(meetings).alias("m"))
    apart = F.col("m.with_main") | (F.col("m.left") != F.col("m.right"))
    met = met.select("key", "band", "bucket", "component", "main", "own", "m.left", "m.right", "m.with_main", apart.alias("apart"))
    sided = met.join(texts.select("key", "bands", "text"), "key")
    return written(sided.groupBy("bucket", "left", "right", "with_main").applyInArrow(_settled(weights, threshold), "a string, b string"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, key, class_id, class_key, n_links for each input row.

    key is the text's digest (null for blank texts), class_id the least doc_id
    of the class, class_key the least digest under that id, n_links the number
    of other distinct texts in the class.
    """
    weights = docs.sparkSession.sparkContext.broadcast(word_weights(docs))  # a table of fixed size
    kind = docs.schema["doc_id"].dataType.simpleString()
    member = F.col("doc_id").isNotNull() & _has_words("text")
    keyed = docs.select("doc_id", "text", F.md5("text").alias("key")).where(member)
    sketched = written(keyed.select("doc_id", "key", "text").mapInArrow(_sketch(weights, bands, rows), f"doc_id {kind}, key string, bands array<bigint>"))
    firsts = written(sketched.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")))
    entries = _buckets(firsts)
    shared = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    scores = entries.join(shared, "bucket").groupBy("key").agg(F.sum("n").alias("score"))
    nodes = written(firsts.join(scores, "key"))
    # The same plan at every size: a small list of nodes is not broadcast.
    texts = written(keyed.join(nodes.hint("merge"), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("key", "bands", "score", F.octet_length("text").alias("size"), "text"))
    leaders = _buckets(texts, "score").groupBy("bucket").agg(F.max_by("key", F.struct("score", "key")).alias("leader"), F.count("*").alias("n")).where("n > 1")
    leaders = written(leaders)
    links = _first_links(texts, leaders, weights, threshold)
    labels = components(links)
    more = _later_links(texts, leaders, labels, weights, threshold)
    if not more.isEmpty():
        labels = components(links.union(more))
    lined = firsts.join(labels, F.col("key") == F.col("node"), "left").select("key", "doc_id", F.coalesce("component", "key").alias("component"))
    groups = lined.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("first"), (F.count("*") - 1).alias("n_links"))
    of_text = lined.select("key", "component").join(groups, "component").select("key", F.col("first.doc_id").alias("class_id"), F.col("first.key").alias("class_key"), "n_links")
    found = sketched.select("doc_id", "key").join(of_text, "key").select("doc_id", "key", "class_id", "class_key", "n_links")
    none = F.lit(None).cast("string")
    rest = docs.where(~member).select("doc_id", none.alias("key"), F.col("doc_id").alias("class_id"), none.alias("class_key"), F.lit(0).cast("bigint").alias("n_links"))
    return found.union(rest)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class one text under its least doc_id stays; rows without a class all stay.

    Repeated rows (one doc_id, one text) are reduced to one: the one whose
    columns, written as JSON, come first.
    """
    found = written(classes(docs, **options))
    gone = found.where("class_id <> doc_id or class_key <> key").select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")).distinct()
    kept = docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (F.md5(docs["text"]) == gone["gone_key"]), "left_anti")
    repeated = found.where("key is not null").groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key"))
    if repeated.isEmpty():
        return kept
    same = (kept["doc_id"] == repeated["gone_id"]) & (F.md5(kept["text"]) == repeated["gone_key"])
    first = kept.join(repeated, same, "left_semi").select(F.struct("*").alias("row")).groupBy("row.doc_id", F.md5("row.text").alias("digest")).agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.join(repeated, same, "left_anti").union(first.select("row.*"))
