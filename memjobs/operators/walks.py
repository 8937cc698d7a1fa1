"""Walks over link tables, hop by hop, from many seeds at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memjobs.sources.tables import written

HUB = 4096  # edges of a node that one task follows; those of a hub lie in as many blocks as it takes


def _blocked(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with ``block``, hubs with ``blocks``): a hub's edges are spread by hash of their ends."""
    edges = written(edges)
    hubs = written(edges.groupBy("node").count().where(F.col("count") > HUB).select("node", F.ceil(F.col("count") / HUB).cast("int").alias("blocks")))
    if hubs.isEmpty():
        return edges.withColumn("block", F.lit(0)), hubs
    spread = edges.join(hubs, "node", "left").withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("next"), F.col("blocks")).cast("int")))
    return written(spread.select("node", "next", "block")), hubs


def walk(seeds: DataFrame, edges: DataFrame, max_hops: int) -> DataFrame:
    """(group, node): what each group reaches from its seeds in rounds 0..max_hops-1.

    seeds: group, node, hops, the group's own number of rounds.  edges: node,
    next, both of any one type, equal rows counting once.  Each frontier is
    written, so a round starts from a table and not from all rounds before; the
    loop ends early where a frontier is empty.  A hub's edges meet a copy of the
    frontier in each of their blocks, so no task follows more than ``HUB`` of them
    for a row.
    """
    frontier = written(seeds.select("group", "node", "hops").where("hops > 0").groupBy("group", "node").agg(F.max("hops").alias("hops")))
    visited = frontier.select("group", "node")
    if max_hops < 2:
        return visited
    spread, hubs = _blocked(edges.select("node", "next").distinct())
    for hop in range(1, max_hops):
        on = frontier.where(F.col("hops") > hop).join(hubs, "node", "left").select("group", "node", "hops", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"))
        reached = on.join(spread, ["node", "block"]).select("group", F.col("next").alias("node"), "hops").groupBy("group", "node").agg(F.max("hops").alias("hops"))
        frontier = written(reached.join(visited, ["group", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        visited = visited.union(frontier.select("group", "node"))
    return visited
