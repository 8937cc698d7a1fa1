"""Nearest vectors by cosine: exact search in groups, and an inverted-file index whose probed cells are searched exactly.

Queries are a stated set, taken in blocks of bounded bytes.  A block goes to the
executors; each batch of vectors is multiplied with it group by group and keeps
k rows for each query, so vectors are neither shuffled nor joined and a hot
project is no hot key.  Vectors of another length than the query's, null and
zero ones are nobody's neighbours; queries like that have none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from memjobs.sources.tables import remove, shared_folder, written

BLOCK_BYTES = 32 << 20  # of query vectors that are held at once
CHUNK = 512  # queries multiplied with a batch at a time
DIGITS = 9  # similarities are equal if they are so to this many places; ties go to the lesser id
# The inverted-file index: the fitted sample's size in expectation, rounds of fitting, sampled queries that measure recall.
SAMPLE, ROUNDS, SAMPLED_QUERIES = 20_000, 8, 64


def ranked(scored: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "memory_id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest of each row; equal ones in order of position."""
    n = sims.shape[1]
    k = min(k, n)
    order = np.rint(sims * 10**DIGITS).astype(np.int64) * (1 << 22) - np.arange(n)
    return np.argpartition(-order, k - 1, axis=1)[:, :k] if k < n else np.broadcast_to(np.arange(n), sims.shape)


class Block:
    """Queries: ids, vectors, and the rows of each group that asks."""

    def __init__(self, ids: pa.Array, matrix: np.ndarray, groups: dict):
        self.ids, self.matrix, self.groups = ids, matrix, groups
        self.norms = np.linalg.norm(matrix, axis=1)


def _search_groups(held, k: int):
    """(memory_id, group, vector) -> request_id, memory_id, score: the k best of each batch for each query of the row's group."""

    def job(batches):
        block = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.take(pc.sort_indices(batch.column(0)))
            groups = batch.column(1).dictionary_encode()
            codes, names = groups.indices.to_numpy(zero_copy_only=False), groups.dictionary.to_pylist()
            order = np.argsort(codes, kind="stable")
            edges = np.searchsorted(codes[order], np.arange(len(names) + 1))
            x = _matrix(batch.column(2))
            norms = np.linalg.norm(x, axis=1)
            for g, name in enumerate(names):
                asking, rows = None if name is None else block.groups.get(name), order[edges[g] : edges[g + 1]]
                for lo in range(0, len(asking) if asking is not None else 0, CHUNK):
                    q = asking[lo : lo + CHUNK]
                    sims = np.round((block.matrix[q] @ x[rows].T) / (block.norms[q][:, None] * norms[rows][None, :] + 1e-10), DIGITS)
                    at = _top(sims, k)
                    yield pa.RecordBatch.from_arrays(
                        [block.ids.take(pa.array(np.repeat(q, at.shape[1]))), batch.column(0).take(pa.array(rows[at].ravel())), pa.array(np.take_along_axis(sims, at, 1).ravel())],
                        names=["request_id", "memory_id", "score"],
                    )

    return job


def _blocks(queries: DataFrame, group: str | None):
    """The queries in blocks of about ``BLOCK_BYTES``: one where a first look already holds them all."""
    named = queries.select("request_id", (F.lit(0) if group is None else F.col(group)).alias("group"), F.col("vector").cast("array<double>").alias("vector"))
    named = named.where(F.col("vector").isNotNull() & F.exists("vector", lambda v: v != 0))
    kind = to_arrow_type(queries.schema["request_id"].dataType)
    length = named.select(F.size("vector")).first()
    if length is None:
        return
    most = max(1, BLOCK_BYTES // (8 * length[0]))
    first = named.limit(most + 1).collect()
    blocks = 1
    if len(first) > most:
        named = written(named)
        blocks = math.ceil(named.count() / most)
    for b in range(blocks):
        rows = first if blocks == 1 else named.where(F.pmod(F.xxhash64("request_id"), F.lit(blocks)) == b).collect()
        by_length: dict[int, list] = {}
        for r in rows:
            by_length.setdefault(len(r.vector), []).append(r)
        for n, same in by_length.items():
            groups: dict = {}
            for i, r in enumerate(same):
                groups.setdefault(r.group, []).append(i)
            yield n, Block(pa.array([r.request_id for r in same], kind), np.array([r.vector for r in same], np.float64), {g: np.array(i) for g, i in groups.items()})


def _found(vectors: DataFrame, blocks, k: int, request_type: T.DataType) -> DataFrame:
    """vectors (memory_id, group, vector), searched for each (length, block)."""
    schema = T.StructType([T.StructField("request_id", request_type), T.StructField("memory_id", vectors.schema["memory_id"].dataType), T.StructField("score", T.DoubleType())])
    out = None
    for length, block in blocks:
        held = vectors.sparkSession.sparkContext.broadcast(block)  # BLOCK_BYTES at most
        rows = vectors.where((F.size("vector") == length) & F.exists("vector", lambda v: v != 0))
        part = rows.mapInArrow(_search_groups(held, k), schema)
        out = part if out is None else out.union(part)
    return ranked(vectors.sparkSession.createDataFrame([], schema) if out is None else out, k)


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """request_id, memory_id, score, rank: the k nearest of all vectors (memory_id, vector) to each query (request_id, vector)."""
    return _found(vectors.select("memory_id", F.lit(0).alias("group"), "vector"), _blocks(queries, None), k, queries.schema["request_id"].dataType)


def vector_candidates(vectors: DataFrame, requests: DataFrame, k: int = 50) -> DataFrame:
    """request_id, memory_id, score, rank: the k nearest of the request's own project; vectors (memory_id, project_id, vector), requests (request_id, project_id, vector)."""
    return _found(vectors.select("memory_id", F.col("project_id").alias("group"), "vector"), _blocks(requests, "project_id"), k, requests.schema["request_id"].dataType)


@dataclass
class VectorIndex:
    """``centroids``: unit rows, fitted on a sample.  ``folder``: every vector under its nearest centroid, a folder a cell.  ``probes``: cells that a query visits to reach the recall asked for."""

    centroids: np.ndarray
    table: DataFrame
    folder: str
    probes: int

    def drop(self) -> None:
        remove(self.table.sparkSession, self.folder)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Spherical k-means on a bounded sample; a centroid that loses all its rows stays where it was."""
    points = _unit(sample)
    centroids = points[np.random.default_rng(seed).choice(len(points), cells, replace=False)]
    for _ in range(rounds):
        nearest = (points @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        centroids = np.where(np.linalg.norm(sums, axis=1)[:, None] > 0, _unit(sums), centroids)
    return centroids


def _assign(centroids: np.ndarray):
    def job(batches):
        for batch in batches:
            if batch.num_rows:
                cell = (_unit(_matrix(batch.column(1))) @ centroids.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["memory_id", "vector", "cell"])

    return job


def ivf_index(vectors: DataFrame, recall: float = 0.95, k: int = 10, cells: int | None = None) -> VectorIndex:
    """An index of all vectors (memory_id, vector) of the commonest length.

    About sqrt(n) cells, fitted on ``SAMPLE`` rows in expectation, by hash of
    the id.  ``probes`` is measured: ``SAMPLED_QUERIES`` rows are searched
    exactly, and the least number of cells is taken that holds this share of
    their k nearest.
    """
    spark = vectors.sparkSession
    rows = vectors.select("memory_id", F.col("vector").cast("array<double>").alias("vector")).where(F.col("vector").isNotNull() & F.exists("vector", lambda v: v != 0))
    lengths = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    length, n = lengths if lengths else (0, 0)
    rows = rows.where(F.size("vector") == length)
    share = lambda most: F.pmod(F.xxhash64("memory_id"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, most / max(1, n)))
    sample = [r[0] for r in rows.where(share(SAMPLE)).select("vector").collect()]
    sample = np.array(sample, np.float64) if sample else np.zeros((0, length))
    cells = min(cells or max(1, round(math.sqrt(n))), max(1, len(sample)))
    centroids = fit_centroids(sample, cells) if len(sample) else np.zeros((1, length))
    folder = shared_folder(spark, "cells")
    placed = rows.mapInArrow(_assign(centroids), T.StructType([rows.schema["memory_id"], rows.schema["vector"], T.StructField("cell", T.IntegerType())]))
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(folder)  # large cells are split, small ones meet in a task
    table = spark.read.schema(placed.schema).parquet(folder)
    asked = table.where(share(SAMPLED_QUERIES)).select(F.col("memory_id").alias("request_id"), "vector")
    near = vector_search(table, asked, k + 1).where("request_id <> memory_id")
    cell_of = table.select("memory_id", "cell")
    answers = near.join(cell_of, "memory_id").join(asked, "request_id").select("vector", "cell").collect()
    place = sorted(1 + int(np.flatnonzero(_visit(np.array([r.vector]), centroids, cells)[0] == r.cell)[0]) for r in answers)
    probes = place[min(len(place), math.ceil(recall * len(place))) - 1] if place else cells
    return VectorIndex(centroids, table, folder, probes)


def _visit(queries: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """The nearest cells of each query, nearest first."""
    return np.argsort(-(queries @ centroids.T), axis=1, kind="stable")[:, :probes]


def ivf_search(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
    """request_id, memory_id, score, rank: the k nearest of the vectors in the cells that each query visits; only those cells are read."""
    probes = min(probes or index.probes, len(index.centroids))
    blocks, read = [], set()
    for length, block in _blocks(queries, None):
        if length == index.centroids.shape[1]:
            visited = _visit(block.matrix, index.centroids, probes)
            block.groups = {int(c): np.flatnonzero((visited == c).any(axis=1)) for c in np.unique(visited)}
            read |= block.groups.keys()
            blocks.append((length, block))
    cells = index.table.where(F.col("cell").isin(sorted(read))) if len(read) < len(index.centroids) else index.table
    return _found(cells.select("memory_id", F.col("cell").alias("group"), "vector"), blocks, k, queries.schema["request_id"].dataType)
