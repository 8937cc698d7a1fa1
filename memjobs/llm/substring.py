"""Removal of long passages that repeat across documents: seed and extend.

Seeds.  Each window of ``window`` words elects an anchor, the smallest hash
among the ``seed``-word grams inside it (winnowing: equal windows elect equal
anchors).  Consecutive windows of a document with one anchor form a run.

Join.  Runs meet on their anchor.  A run whose whole extent (anchor and the
words to both sides of it) also lies in a document with a smaller id is a
repeat as it stands.  Where an anchor has several differing extents, only one
document for each extent goes on.

Extend.  Those anchors are extended to both sides to every placement of the
window that contains the seed; equal placements in a smaller document are
matches.  Extents and placements alike stand on two hashes of each word, 128 bits over its whole length; the anchor, on
which runs only meet, on one.  Overlapping matches merge to maximal repeats, none shorter than the
window.  No pair of documents is ever written down, so a passage in a third of
all documents costs a few rows for each of them.

Defined cases.  Null text: no words.  Null ``doc_id``: the row neither loses
words nor makes others lose any.  Rows that share a ``doc_id`` never match each
other; their texts are told apart by a 64-bit digest.  Ids may be of any ordered type.  Texts under ``window`` words keep all.  Only ``doc_id`` and ``text``
are read; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memjobs.llm._shared import written
from memjobs.llm._words import SEQUENCE_BASES, WORD_BASES, Sequences, sliding_min, text_blocks, words_of

RUNS = "doc_id {id}, version bigint, anchor bigint, e1 bigint, e2 bigint, start int, n int"
PLACED = "doc_id {id}, version bigint, h1 bigint, h2 bigint, start int"


def _seeds(window: int, seed: int):
    def job(batches):
        for batch in batches:
            ids, versions = batch.column(0), batch.column(2)
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                w = words_of(data, offsets)
                if len(w.hash) < window:
                    continue
                least = sliding_min(Sequences(w.hash).grams(seed), window - seed + 1)
                inside = w.doc[: len(least)] == w.doc[window - 1 : window - 1 + len(least)]
                at = np.flatnonzero(inside)
                if not len(at):
                    continue
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]]) | (w.doc[at[1:]] != w.doc[at[:-1]])
                first = np.flatnonzero(new)
                a = at[first]
                n = np.diff(np.append(first, len(at)))
                second = words_of(data, offsets, WORD_BASES[1]).hash
                extents = [Sequences(h, base).span(a, a + n + window - 1).view(np.int64) for h, base in zip((w.hash, second), SEQUENCE_BASES, strict=True)]
                begins = np.searchsorted(w.doc, np.arange(hi - lo))
                doc = w.doc[a]
                row = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(row), versions.take(row), pa.array(least[a].view(np.int64)), *map(pa.array, extents), pa.array((a - begins[doc]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["doc_id", "version", "anchor", "e1", "e2", "start", "n"],
                )

    return job


def _place(window: int):
    """Every placement of the window in the given runs, with a 128-bit hash."""

    def job(batches):
        for batch in batches:
            ids, versions, runs = batch.column(0), batch.column(2), batch.column(3)
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                hashes = [Sequences(words_of(data, offsets, wb).hash, sb) for wb, sb in zip(WORD_BASES, SEQUENCE_BASES, strict=True)]
                doc = words_of(data, offsets).doc
                begins = np.searchsorted(doc, np.arange(hi - lo))
                part = runs.slice(lo, hi - lo)
                sizes = np.diff(part.offsets.to_numpy())
                flat = part.flatten()
                start, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                owner = np.repeat(np.repeat(np.arange(hi - lo), sizes), n)
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                local = np.repeat(start, n) + within
                at = local + begins[owner]
                row = pa.array(owner + lo)
                for c in range(0, len(at), 1 << 18):
                    s = slice(c, c + (1 << 18))
                    h1, h2 = (x.span(at[s], at[s] + window).view(np.int64) for x in hashes)
                    r = row.slice(c, len(h1))
                    yield pa.RecordBatch.from_arrays([ids.take(r), versions.take(r), pa.array(h1), pa.array(h2), pa.array(local[s].astype(np.int32))], names=["doc_id", "version", "h1", "h2", "start"])

    return job


def _cut(batches):
    for batch in batches:
        ids, texts, spans = batch.column(0), batch.column(1).cast(pa.large_binary()), batch.column(2)
        counts, removed, kept = [], [], []
        for i in range(len(ids)):
            text = texts[i].as_py() or b""
            words = text.split()
            counts.append(len(words))
            found = spans[i].values if spans[i].is_valid else None
            if found is not None and len(found):
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, found.field(0).to_numpy(), 1)
                np.add.at(edge, found.field(1).to_numpy(), -1)
                keep = np.cumsum(edge)[:-1] == 0
                words = [x for x, k in zip(words, keep.tolist(), strict=True) if k]
            removed.append(counts[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def repeats(docs: DataFrame, window: int = 50, seed: int = 20) -> DataFrame:
    """Matched stretches (doc_id, version, start, end) in words; ``version`` tells texts of one id apart."""
    texts = _identified(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    placed_rows = PLACED.format(id=kind)
    runs = written(texts.mapInArrow(_seeds(window, seed), RUNS.format(id=kind)))
    shared = (
        runs.groupBy("anchor")
        .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min(F.struct("e1", "e2")).alias("e_lo"), F.max(F.struct("e1", "e2")).alias("e_hi"))
        .where("lo < hi")
        .select("anchor", (F.col("e_lo") != F.col("e_hi")).alias("differs"))
    )
    met = written(runs.join(shared, "anchor"))
    # Written, so that both sides of the join are plain exchanges and a hot anchor can be split.
    first = written(met.groupBy("anchor", "e1", "e2").agg(F.min("doc_id").alias("first_doc")))
    judged = met.join(first, ["anchor", "e1", "e2"])
    whole = judged.where("first_doc < doc_id").select("doc_id", "version", "start", (F.col("start") + F.col("n") + window - 1).alias("end"))
    open_runs = judged.where("first_doc = doc_id and differs").groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    placed = texts.join(open_runs, ["doc_id", "version"]).select("doc_id", "text", "version", "runs").mapInArrow(_place(window), placed_rows)
    placed = written(placed)
    earliest = written(placed.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc").drop("last_doc"))
    parts = placed.join(earliest, ["h1", "h2"]).where("first_doc < doc_id").select("doc_id", "version", "start", (F.col("start") + window).alias("end"))
    return whole.union(parts)


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("version")).where("doc_id is not null and text is not null")


def remove_repeats(docs: DataFrame, window: int = 50, seed: int = 20) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text (kept words joined by a space)."""
    spans = repeats(docs, window, seed).groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = _identified(docs).join(spans, ["doc_id", "version"], "left").select("doc_id", "text", "spans")
    empty = docs.where("doc_id is null or text is null").select("doc_id", "text", F.lit(None).cast(joined.schema["spans"].dataType).alias("spans"))
    return joined.union(empty).mapInArrow(_cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_text string")
