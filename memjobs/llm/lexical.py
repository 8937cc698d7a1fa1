"""Ranked lexical search by NRA: no random access, only sequential reads of impact-sorted lists.

Documents are dealt over shards of bounded size.  In a shard each term's
postings are sorted by impact; for an item, blocks of its lists are read from
the top, every document seen keeps a lower bound (what was read of it) and an
upper bound (plus what its unread lists can still give), and reading goes on
until each document that may still be among the best k has equal bounds.  So
membership, ties and scores are final in each shard, and a window over the
shards' best gives the ranking.

Rows.  A null text has no terms.  Each row of documents is a document, repeated
rows too; equal scores go to the lesser doc_id, null last, of any ordered type.
Rows of one item_id, null being one, are one item with the terms of all its
different texts.  An item without terms, or none of whose terms occurs, has no
rows.  An empty table gives none.  Texts are read whole, one at a time.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memjobs.llm._shared import written

BLOCK_TERMS = 250_000  # (item, term) rows of the queries that are held at once
SHARD_DOCS, SHARD_POSTINGS = 8192, 2_000_000  # expected size of a shard
FIRST_READ = 64  # postings of each list in the first round; each round reads twice as many
# Bytes that are part of a term (digits, letters, all beyond ASCII), capitals lowered.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text, in order."""
    return text.encode().translate(_TERM_BYTES).split() if text else []


def item_terms(items: DataFrame) -> DataFrame:
    """items (item_id, text) -> (item_id, term, q): q is the term's count in the item."""

    def job(batches):
        for batch in batches:
            rows = [(i, t, n) for i, text in enumerate(batch.column(1).to_pylist()) for t, n in Counter(terms_of(text)).items()]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([r[1].decode() for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["item_id", "term", "q"])

    schema = T.StructType([T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("term", T.StringType()), T.StructField("q", T.LongType())])
    texts = items.select("item_id", "text").distinct()
    return texts.mapInArrow(job, schema).groupBy("item_id", "term").agg(F.sum("q").alias("q"))


def _counted(asked: list[str]):
    """doc_id, text -> doc_id, n, terms (numbers of asked terms), tfs: one row a document, a pass over its whole text."""

    def job(batches):
        number = {t.encode(): i for i, t in enumerate(asked)}
        known = number.keys()
        for batch in batches:
            n, ends, terms, tfs = [], [0], [], []
            for text in batch.column(1):
                found = terms_of(text.as_py())
                n.append(len(found))
                for t, tf in Counter(t for t in found if t in known).items():
                    terms.append(number[t])
                    tfs.append(tf)
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return job


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int) -> list[tuple[int, int]]:
    """The k best (document, score), score over 0, of lists (documents, impacts), each falling in impact; ties to the lesser document.

    ``ceiling`` is what each list can still give a document not read in it: the
    impact of its next posting.  A document stays while its upper bound reaches
    the k-th lower bound; equality keeps it, as a tie may go to it.
    """
    lower = np.zeros(n_docs, np.int64)
    seen = np.zeros((len(lists), n_docs), bool)
    alive = np.arange(n_docs)
    at, step = 0, FIRST_READ
    while True:
        for i, (docs, impacts) in enumerate(lists):
            read = slice(at, at + step)
            lower[docs[read]] += impacts[read]
            seen[i, docs[read]] = True
        at, step = at + step, 2 * step
        ceiling = np.array([impacts[at] if at < len(impacts) else 0 for _, impacts in lists], np.int64)
        own = lower[alive]
        left = ceiling @ ~seen[:, alive]
        least = int(np.partition(own, -k)[-k]) if len(own) >= k else 0
        stay = own + left >= max(least, 1)
        alive, own, left = alive[stay], own[stay], left[stay]
        if not left.any():
            best = np.lexsort((alive, -own))[:k]
            return list(zip(alive[best].tolist(), own[best].tolist(), strict=True))


def _best_of_shard(items: list[list[tuple[int, int]]], k: int):
    """A shard (shard, doc_id, row, terms, impacts) -> item (number), doc_id, row, score: its best k for each item, by NRA."""

    def job(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("row", "ascending")], null_placement="at_end"))
        terms, impacts = (table.column(c).combine_chunks() for c in ("terms", "impacts"))
        doc = np.repeat(np.arange(table.num_rows), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
        terms, impacts = terms.flatten().to_numpy(), impacts.flatten().to_numpy()
        order = np.lexsort((doc, -impacts, terms))
        terms, impacts, doc = terms[order], impacts[order], doc[order]
        present, starts = np.unique(terms, return_index=True)
        ends = np.append(starts[1:], len(terms))
        place = {t: slice(a, b) for t, a, b in zip(present.tolist(), starts.tolist(), ends.tolist(), strict=True)}
        out = [(i, d, s) for i, asked in enumerate(items) if (lists := [(doc[place[t]], impacts[place[t]] * w) for t, w in asked if t in place]) for d, s in nra(lists, table.num_rows, k)]
        at = pa.array([x[1] for x in out], pa.int64())
        return pa.table({"item": pa.array([x[0] for x in out], pa.int32()), "doc_id": table.column("doc_id").take(at), "row": table.column("row").take(at), "score": pa.array([x[2] for x in out], pa.int64())})

    return job


def _search_block(documents: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The ranking for a block of items: asked (item_id, term, q), a bounded stated query set, is held by the driver."""
    rows = asked.orderBy("item_id", "term").collect()
    terms = sorted({r.term for r in rows})
    number = {t: i for i, t in enumerate(terms)}
    doc_type = documents.schema["doc_id"].dataType
    counted = T.StructType([T.StructField("doc_id", doc_type), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType()))])
    docs = written(documents.select("doc_id", "text").mapInArrow(_counted(terms), counted).withColumn("row", F.monotonically_increasing_id()))
    total = docs.agg(F.count_if(F.col("n") > 0).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L"), F.count_if(F.size("terms") > 0).alias("found"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("postings")).first()
    found = docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = {r.term: r.w for r in found.select("term", F.floor(1000 * F.log((2 * F.lit(total.N) + 2).cast("double") / (2 * F.col("df") + 1))).alias("w")).collect()}
    ids = list({r.item_id: None for r in rows})
    at = {x: i for i, x in enumerate(ids)}
    items: list[list[tuple[int, int]]] = [[] for _ in ids]
    for r in rows:
        if weights.get(number[r.term], 0) > 0:
            items[at[r.item_id]].append((number[r.term], r.q * weights[number[r.term]]))
    shards = max(1, math.ceil(total.found / SHARD_DOCS), math.ceil(total.postings / SHARD_POSTINGS))
    m = F.expr(f"25 + (75 * n * {total.N}L) div {max(1, total.L)}L")
    impact = F.zip_with("terms", "tfs", lambda _, tf: F.call_function("div", 1_000_000_000 * tf, 1000 * tf + 8 * F.col("m")))
    held = docs.where(F.size("terms") > 0).withColumn("m", m).select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "row", "terms", impact.alias("impacts"))
    best = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("doc_id", doc_type), T.StructField("row", T.LongType()), T.StructField("score", T.LongType())])
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row"))
    ranked = held.groupBy("shard").applyInArrow(_best_of_shard(items, k), best).withColumn("rank", place).where(F.col("rank") <= k)
    names = documents.sparkSession.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("item", T.IntegerType()), asked.schema["item_id"]]))
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # as many names as the block has items


def search(documents: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """documents (doc_id, text), items (item_id, text) -> item_id, rank, doc_id, score: the k best documents of each item.

    Items are a stated query set: they are taken in blocks of about
    ``block_terms`` distinct terms of items, each a pass over all documents.
    """
    asked = written(item_terms(items))
    blocks = max(1, math.ceil(asked.count() / block_terms))
    parts = [_search_block(documents, asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), k) for b in range(blocks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
