"""Connected components of a link table, by min-label hooking and pointer jumping in joins."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memjobs.llm._shared import written


def _stars(batches):
    """The links of one partition as stars: every node but the least of its group, with that least one."""
    parent: dict = {}

    def find(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    names, kind = ("a", "b"), None
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        nodes = [x for x in parent if parent[x] != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], names=names)


def components(links: DataFrame) -> DataFrame:
    """links (a, b), a <> b -> (node, component) of the nodes that links touch; component is the least node.

    The links of each partition are first drawn together to stars, which
    changes no component.  Each round then hooks every node to its least
    neighbour, shortens the chains once, and contracts the links; it ends when
    none is left.  A star takes one round, a chain of n nodes about log n.
    """
    labels = None
    links = links.select("a", "b")
    links = written(links.mapInArrow(_stars, links.schema).distinct())
    while True:
        both = links.union(links.select("b", "a"))
        hooked = both.groupBy(F.col("a").alias("child")).agg(F.least(F.min("b"), F.first("a")).alias("parent"))
        up = hooked.select(F.col("child").alias("parent"), F.col("parent").alias("grand"))
        step = written(hooked.join(up, "parent").select("child", F.col("grand").alias("parent")))
        if labels is None:
            labels = step.select(F.col("child").alias("node"), F.col("parent").alias("component"))
        else:
            moved = labels.join(step, F.col("component") == F.col("child"), "left")
            labels = written(moved.select("node", F.coalesce("parent", "component").alias("component")))
        a, b = step.select(F.col("child").alias("a"), F.col("parent").alias("pa")), step.select(F.col("child").alias("b"), F.col("parent").alias("pb"))
        links = links.join(a, "a").join(b, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        links = written(links.mapInArrow(_stars, links.schema).distinct())
        if links.isEmpty():
            return labels
