"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations alone.

Targets.  Sources in code-point order (null last) take the weights in turn and
share all words; a target stops at ``repeats`` times its source's words and the
excess goes to the others by weight: the water level is the largest of
(total - caps below) / (weights from here on) over sources by cap per weight.

Queue.  Each source is shuffled by a digest of ``doc_id`` and repeated up to
``repeats`` times.  A copy is a packet; the one that straddles the target is
sent as two.  A packet's virtual finish time is the source's words up to its
end, divided by the target.  Packets are sorted globally by finish time and
the sort is truncated where the running total reaches the budget.

Both running totals are two-level: sums per range first (digest prefixes
within a source, ranges of virtual time over all), then a window inside each
range, so a source with a third of all rows is spread over many tasks.

Defined cases.  Null or blank text has size 0 and is never taken.  Null
``doc_id`` shuffles as the text ``null``; repeated rows are rows of their own.
Empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memjobs.llm._shared import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
REPEATS = 3
SEED = "mix"
ROWS_IN_RANGE = 200_000
LEAST_DIGITS = 2  # at least 256 ranges in a source, so that one with a third of all rows is spread at every size
WORDS_IN_RANGE = 5_000_000
BROADCAST_SOURCES = 50_000  # rows of a few dozen bytes


def source_targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target, rank: one row per source.  The windows run over this table of sources, not over documents."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order)
    weighed = total.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    by_ratio = Window.partitionBy().orderBy(F.col("source_size") * repeats / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    cap = F.col("source_size") * repeats
    left = F.sum("source_size").over(whole) - (F.sum(cap).over(by_ratio) - cap)
    rest = F.sum("weight").over(whole) - (F.sum("weight").over(by_ratio) - F.col("weight"))
    level = weighed.withColumn("level", left.cast("double") / rest.cast("double"))
    return level.withColumn("target", F.least(cap.cast("double"), F.max("level").over(whole) * F.col("weight"))).select("source", "source_size", "target", "rank")


def _joined(df: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    side = F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources
    return df.join(side, df["source"].eqNullSafe(side["source"])).drop(side["source"])


def mix(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, (keep), source, size, source_size, target, taken."""
    sized = docs.select(
        "doc_id", *keep, "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("digest"),
    )
    rows = written(sized)
    sources = written(source_targets(rows, weights, repeats).coalesce(1))
    n_sources, total = sources.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    n_rows = rows.count()

    # Position of each document in its shuffled source.
    digits = max(LEAST_DIGITS, math.ceil(math.log(max(2, n_rows / ROWS_IN_RANGE), 16)))
    ranged = rows.where("size > 0").withColumn("range", F.substring("digest", 1, digits))
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(F.col("source").alias("o_source"), F.col("range").alias("o_range"), before.alias("offset"))
    within = Window.partitionBy("source", "range").orderBy("digest", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("range") == F.col("o_range")))
    placed = placed.withColumn("position", F.col("offset") + F.sum("size").over(within) - F.col("size"))

    # Packets: copies, the one across the target cut in two; none begins at or after virtual time 1, which serves the whole budget.
    copies = _joined(placed.select("doc_id", *keep, "source", "size", "position"), sources, n_sources).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    start = F.col("copy") * F.col("source_size") + F.col("position")
    copies = copies.withColumn("start", start).withColumn("end", F.col("start") + F.col("size")).where("start < target").withColumn("cut", F.floor("target"))
    inside = (F.col("start") < F.col("cut")) & (F.col("cut") < F.col("end"))
    halves = F.array(F.struct(F.col("start").alias("a"), F.col("cut").alias("b")), F.struct(F.col("cut").alias("a"), F.col("end").alias("b")))
    packets = copies.withColumn("packet", F.explode(F.when(inside, halves).otherwise(F.array(F.struct(F.col("start").alias("a"), F.col("end").alias("b"))))))
    packets = packets.select("doc_id", *keep, "source", "source_size", "target", "rank", "size", "position", F.col("packet.b").alias("end"), (F.col("packet.b") - F.col("packet.a")).alias("words"), (F.col("packet.b") / F.col("target")).alias("finish"))

    # The global sort by finish time, its running total, and the cut at the budget.
    ranges = total // WORDS_IN_RANGE + 1
    packets = packets.withColumn("range", F.least(F.floor(F.col("finish") * ranges), F.lit(ranges)))
    ahead = F.coalesce(F.sum("range_words").over(Window.partitionBy().orderBy("v_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    served = packets.groupBy(F.col("range").alias("v_range")).agg(F.sum("words").alias("range_words")).select("v_range", ahead.alias("served"))
    in_range = Window.partitionBy("range").orderBy("finish", "rank", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queue = packets.join(served, F.col("range") == F.col("v_range"))
    running = F.col("served") + F.sum("words").over(in_range)
    taken = F.least(F.col("words"), F.greatest(F.lit(0), F.lit(total) - (running - F.col("words"))))
    queued = queue.withColumn("taken", taken).groupBy("rank", "position").agg(F.sum("taken").alias("taken"))
    placed_rank = _joined(placed.select("doc_id", *keep, "source", "size", "position"), sources, n_sources)
    out = placed_rank.join(queued, ["rank", "position"], "left").select("doc_id", *keep, "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    blank = _joined(rows.where("size = 0"), sources, n_sources).select("doc_id", *keep, "source", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken"))
    return out.union(blank)


def mixed_documents(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """The mix itself: each taken copy as a row of ``docs`` with ``copy`` and ``copy_words``; a copy cut at the budget has its text cut.

    Rows with equal doc_id, text and source count as one document: the one
    whose columns, written as JSON, come first.  Columns of the
    input named ``copy`` or ``copy_words`` are replaced.
    """
    version = F.xxhash64("text", "source")
    repeated = docs.groupBy("doc_id", version.alias("version")).agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("r_id"), F.col("version").alias("r_version"))
    repeated = written(repeated)
    if not repeated.isEmpty():
        same = docs["doc_id"].eqNullSafe(repeated["r_id"]) & (version == repeated["r_version"])
        firsts = docs.join(repeated, same, "left_semi").select(F.struct("*").alias("row")).groupBy("row.doc_id", F.xxhash64("row.text", "row.source").alias("version")).agg(F.min_by("row", F.to_json("row")).alias("row"))
        docs = docs.join(repeated, same, "left_anti").union(firsts.select("row.*"))
    numbered = docs.select("doc_id", "source", "text", version.alias("version"))
    taken = mix(numbered, weights, repeats, seed, ("version",)).where("taken > 0")
    taken = taken.select(F.col("doc_id").alias("t_id"), F.col("version").alias("t_version"), F.struct("size", F.col("taken").alias("words")).alias("t"))
    packed = docs.select(F.struct("*").alias("row"))
    joined = packed.join(taken, F.col("row.doc_id").eqNullSafe(F.col("t_id")) & (F.xxhash64("row.text", "row.source") == F.col("t_version")))
    copies = joined.select("row", "t", F.explode(F.sequence(F.lit(1), F.ceil(F.col("t.words") / F.col("t.size")).cast("int"))).alias("copy"))
    words = F.least(F.col("t.size"), F.col("t.words") - (F.col("copy") - 1) * F.col("t.size"))
    cut = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), F.lit(1), words.cast("int")), " ")
    text = F.when(words < F.col("t.size"), cut).otherwise(F.col("row.text"))
    names = [c for c in docs.columns if c not in ("copy", "copy_words")]
    return copies.select(*[(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in names], F.col("copy"), words.alias("copy_words"))
