"""Approximate nearest neighbours: a forest of random-projection trees, searched through one shared priority queue, leaves reranked exactly.

The trees are fitted on a bounded sample (``SAMPLE`` vectors in expectation, by
hash of the id); every vector is indexed in each tree.  For inner products,
vectors are scaled and given one more component, so that all are of one length
and the nearest is the one with the largest product.  A query's queue holds
branches of all trees by how far they lie behind the planes that part them from
the query; it visits the ``probes`` best leaves.  How many that must be is
measured: ``SAMPLED_QUERIES`` queries are answered exactly by one pass over all
vectors, and the least number is taken that finds ``recall`` of those answers.
Visited leaves are scored exactly, block by block.

Rows.  A vector that is null, empty, zero, or has a null or non-finite
component takes no part, nor does one without vec_id or of another length than
most (of equally frequent lengths, the greatest).  Of rows with one vec_id the
one with the least vector counts.  Equal vectors are searched as one, with
their 21 least ids: no more can be among a query's 20.  Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memjobs.llm._shared import written

SAMPLE = 32_768
SAMPLED_QUERIES = 64
TREES = 8
DIRECTIONS = 8  # random directions tried at each node: the one along which the sample spreads most is kept
LEAF_SAMPLE = 8  # vectors of the sample that a leaf has at least
BLOCK = 4096  # vectors of a leaf that are scored at once
RECALL = 0.95
SEED = 20


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length as rows of a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def valid_vectors(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part, one for each vec_id."""
    rows = table.select("vec_id", F.col(vector).alias("vector")).where("vec_id is not null and vector is not null and size(vector) > 0")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad & F.exists("vector", lambda x: x != 0)).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = written(rows)
    length = rows.groupBy(F.size("vector").alias("length")).count().agg(F.max_by("length", F.struct("count", "length"))).first()[0]
    return rows.where(F.size("vector") == (length or 0))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(id, vector, ids): each different vector once, its k least ids in order, the least of them naming it."""
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = rows.withColumn("place", place).where(F.col("place") <= k)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("id"), "vector", "ids")


@dataclass
class Forest:
    """Perfect binary trees: ``planes`` (tree, node, component) and ``cuts`` (tree, node), nodes in heap order; leaves are numbered from the left."""

    planes: np.ndarray
    cuts: np.ndarray
    depth: int
    scale: float  # the largest component of all vectors
    radius: float  # the largest length after scaling

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors scaled into the unit ball and given the component that puts them on its surface."""
        x = x / self.scale / self.radius
        return np.concatenate((x, np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", x, x)))[:, None]), axis=1)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(tree, row): the leaf of each vector."""
        x, rows = self.lifted(x), np.arange(len(x))
        out = np.zeros((len(self.planes), len(x)), np.int64)
        for t in range(len(self.planes)):
            side = x @ self.planes[t].T >= self.cuts[t] if self.depth else None
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + side[rows, node]
            out[t] = node - ((1 << self.depth) - 1)
        return out

    def visits(self, query: np.ndarray, probes: int) -> list[tuple[int, int]]:
        """The (tree, leaf) that a query visits, best first, from one queue over the branches of all trees."""
        length = np.linalg.norm(query / self.scale)
        lifted = np.append(query / self.scale / length, 0.0)
        behind = self.planes @ lifted - self.cuts
        queue, out, first_leaf = [(0.0, t, 0) for t in range(len(self.planes))], [], (1 << self.depth) - 1
        while queue and len(out) < probes:
            distance, t, node = heapq.heappop(queue)
            margins = behind[t]
            while node < first_leaf:
                margin = float(margins[node])
                near = 2 * node + 1 + (margin >= 0)
                heapq.heappush(queue, (max(distance, abs(margin)), t, 4 * node + 3 - near))
                node = near
            out.append((t, node - first_leaf))
        return out


def fit_forest(sample: np.ndarray, n: int, scale: float, radius: float, trees: int = TREES, seed: int = SEED) -> Forest:
    """Planes from random directions, cut at the sample's median; about sqrt(n)/4 leaves a tree, each with ``LEAF_SAMPLE`` of the sample."""
    depth = max(0, int(math.log2(max(1.0, min(math.sqrt(n) / 4, len(sample) / LEAF_SAMPLE)))))
    forest = Forest(np.zeros((trees, (1 << depth) - 1, sample.shape[1] + 1)), np.zeros((trees, (1 << depth) - 1)), depth, scale, radius)
    rng, points = np.random.default_rng(seed), forest.lifted(sample)
    for t in range(trees):
        members = {0: np.arange(len(points))}
        for node in range((1 << depth) - 1):
            own = members.pop(node)
            directions = rng.standard_normal((DIRECTIONS, points.shape[1]))
            directions /= np.linalg.norm(directions, axis=1)[:, None]
            along = points[own] @ directions.T
            best = int(along.std(axis=0).argmax()) if len(own) else 0
            cut = float(np.median(along[:, best])) if len(own) else 0.0
            forest.planes[t, node], forest.cuts[t, node] = directions[best], cut
            right = along[:, best] >= cut
            members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]
    return forest


def _best(ids: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, k) positions and scores of each row's k largest products with y; positions are in the order of score, ties by id.

    The matrix product only preselects; what is kept is multiplied again, pair
    by pair, so a score doesn't depend on where its vectors lay in a block.
    """
    k = min(k, len(y))
    rough = x @ y.T
    wide = min(len(y), k + 4)
    top = np.argpartition(-rough, wide - 1, axis=1)[:, :wide]
    exact = np.einsum("ijc,ic->ij", y[top], x)
    order = np.lexsort((ids[top], -exact), axis=1)[:, :k]
    return np.take_along_axis(top, order, 1), np.take_along_axis(exact, order, 1)


HITS = "query bigint, id bigint, score double"


def _exact(queries: tuple[np.ndarray, np.ndarray], k: int):
    """id, vector -> the k best of each batch for each query."""

    def job(batches):
        names, x = queries
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0).to_numpy()
                at, score = _best(ids, x, _matrix(batch.column(1)), k)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, at.shape[1])), pa.array(ids[at].ravel()), pa.array(score.ravel())], names=["query", "id", "score"])

    return job


def exact_search(vectors: DataFrame, queries: tuple[np.ndarray, np.ndarray], k: int) -> DataFrame:
    """query, id, score, place: the k best of all vectors for a bounded block of queries, in one pass."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return vectors.select("id", "vector").mapInArrow(_exact(queries, k), HITS).withColumn("place", place).where(F.col("place") <= k)


def needed_probes(forest: Forest, queries: tuple[np.ndarray, np.ndarray], found: list[tuple[int, np.ndarray]], recall: float) -> int:
    """The least number of visits after which this share of the answers (query, vector) has been in a visited leaf, on average."""
    everything = len(forest.planes) << forest.depth
    order = {int(q): {leaf: i for i, leaf in enumerate(forest.visits(x, everything))} for q, x in zip(*queries, strict=True)}
    if not found:
        return everything
    leaves = forest.leaves(np.array([v for _, v in found]))
    reached = sorted(1 + min(order[q][t, int(leaves[t, i])] for t in range(len(leaves))) for i, (q, _) in enumerate(found))
    return reached[min(len(reached), math.ceil(recall * len(reached))) - 1]


CELL = "tree int, leaf int, block int, kind int, id bigint, vector array<double>"


def _cells(batch: pa.RecordBatch, tree, leaf, block, kind: int, rows: np.ndarray) -> pa.RecordBatch:
    vectors = batch.column(1).cast(pa.list_(pa.float64())).take(pa.array(rows))
    ints = [pa.array(np.asarray(x, np.int32)) for x in (tree, leaf, block, np.full(len(rows), kind))]
    return pa.RecordBatch.from_arrays([*ints, batch.column(0).take(pa.array(rows)), vectors], names=["tree", "leaf", "block", "kind", "id", "vector"])


def _blocks(size: int) -> int:
    return max(1, math.ceil(size / BLOCK))


def _indexed(forest: Forest):
    """id, vector -> id, leaves: the leaf in each tree."""

    def job(batches):
        for batch in batches:
            if batch.num_rows:
                leaves = forest.leaves(_matrix(batch.column(1))).T
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(leaves.ravel().astype(np.int32)), leaves.shape[1]).cast(pa.list_(pa.int32())), batch.column(1)], names=["id", "leaves", "vector"])

    return job


def _dealt(blocks: np.ndarray):
    """id, vector, leaves -> a row for each tree, in a block of its leaf."""

    def job(batches):
        for batch in batches:
            leaves = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            mixed = batch.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            for t in range(leaves.shape[1] if batch.num_rows else 0):
                block = (mixed % blocks[t, leaves[:, t]].astype(np.uint64)).astype(np.int32)
                yield _cells(batch, np.full(batch.num_rows, t), leaves[:, t], block, 0, np.arange(batch.num_rows))

    return job


def _asking(forest: Forest, probes: int, blocks: np.ndarray):
    """id, vector of queries -> a row for each block of each leaf visited."""

    def job(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            to = [(i, t, leaf, b) for i in range(batch.num_rows) for t, leaf in forest.visits(x[i], probes) for b in range(blocks[t, leaf])]
            for lo in range(0, len(to), 1 << 14):
                i, t, leaf, b = np.array(to[lo : lo + (1 << 14)]).T
                yield _cells(batch, t, leaf, b, 1, i)

    return job


def _scored(k: int):
    """Rows sorted by cell, its vectors before its queries -> the k best of the cell's block for each of its queries.  Holds one block."""

    def job(batches):
        now, ids, held = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([c.to_numpy() for c in batch.columns[:4]], axis=1)
            starts = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1)
            names, x = batch.column(4).to_numpy(), _matrix(batch.column(5))
            for lo, hi in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
                if (cell := tuple(keys[lo, :3])) != now:
                    now, ids, held = cell, [], []
                if keys[lo, 3] == 0:
                    ids.append(names[lo:hi])
                    held.append(x[lo:hi])
                elif held:
                    if len(held) > 1:
                        ids, held = [np.concatenate(ids)], [np.concatenate(held)]
                    for q in range(lo, hi, 256):
                        at, score = _best(ids[0], x[q : min(hi, q + 256)], held[0], k)
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[q : min(hi, q + 256)], at.shape[1])), pa.array(ids[0][at].ravel()), pa.array(score.ravel())], names=["query", "id", "score"])

    return job


def search(table: DataFrame, asked: str, k: int = 20, vector: str = "embedding", recall: float = RECALL, trees: int = TREES) -> DataFrame:
    """(vec_id, vector) -> query_id, rank, vec_id, score: the k rows found nearest, by inner product in doubles, to each row for which ``asked`` holds, its own left out."""
    spark = table.sparkSession
    none = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = valid_vectors(table, vector)
    vectors = written(distinct_vectors(rows, k + 1))
    queries = rows.where(asked).select("vec_id", "vector")
    asking = written(vectors.select("id", "vector").join(queries.select("vector").distinct(), "vector", "left_semi").select("id", "vector"))
    n = vectors.count()
    n_asking = asking.count()
    if not n_asking:
        return none
    scale = vectors.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0]
    radius = math.sqrt(vectors.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x / float(scale)) * (x / float(scale))))).first()[0])
    share = lambda size, of: F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 40)) < int((1 << 40) * min(1.0, size / of))
    sample = vectors.where(share(SAMPLE, n)).select("id", "vector").toArrow().combine_chunks()
    sample = _matrix(sample.column(1).combine_chunks()) if sample.num_rows else np.zeros((0, len(vectors.first().vector)))
    forest = fit_forest(sample, n, float(scale), radius, trees)
    few = asking.where(share(SAMPLED_QUERIES, n_asking)).orderBy("id").collect() or asking.limit(1).collect()
    few = (np.array([r.id for r in few]), np.array([r.vector for r in few], np.float64))
    answers = exact_search(vectors, few, k + 1).join(vectors.select("id", "vector"), "id").where("id <> query").select("query", "vector").collect()
    probes = needed_probes(forest, few, [(r.query, np.array(r.vector, np.float64)) for r in answers], recall)
    leaves = written(vectors.select("id", "vector").mapInArrow(_indexed(forest), "id bigint, leaves array<int>, vector " + vectors.schema["vector"].dataType.simpleString()))
    blocks = np.ones((trees, 1 << forest.depth), np.int64)
    for r in leaves.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count().where(F.col("count") > BLOCK).collect():  # at most a row a leaf
        blocks[r.tree, r.leaf] = _blocks(r["count"])
    cells = leaves.select("id", "vector", "leaves").mapInArrow(_dealt(blocks), CELL).unionAll(asking.mapInArrow(_asking(forest, probes, blocks), CELL))
    hits = cells.repartition("tree", "leaf", "block").sortWithinPartitions("tree", "leaf", "block", "kind").mapInArrow(_scored(k + 1), HITS)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    best = hits.repartition("query").groupBy("query", "id").agg(F.first("score").alias("score")).withColumn("place", place).where(F.col("place") <= k + 1)
    named = best.join(vectors.select("id", "ids"), "id").select("query", "score", F.explode("ids").alias("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    near = named.withColumn("place", rank).where(F.col("place") <= k + 1).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    # Copies of one query vector share one answer; the join's larger side has a row for each of them and can be split.
    named_queries = queries.join(asking.select(F.col("id").alias("query"), "vector"), "vector").select("vec_id", "query")
    own = F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))
    answered = named_queries.withColumnRenamed("vec_id", "query_id").join(near, "query").select("query_id", F.posexplode(F.slice(own, 1, k)).alias("at", "x"))
    return answered.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")
