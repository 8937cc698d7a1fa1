"""Conversation structure repair: the cheapest edits after which roles alternate, by square-root checkpointed dynamic programming.

A conversation is read in order as one byte a row.  The backward pass keeps the
vector of state costs only at about every square root of its rows; walking
forward, a block's vectors are recomputed from the checkpoint behind it, and of
the edits that keep to the least cost the one with the ASCII-least initial is
taken.  So costs take memory as the square root of a conversation.

Rows.  ``conv_id`` may be null: null is a conversation of its own.  Null roles and texts
are one space, so such a text is blank and such a role is rewritten or deleted.
Rows of one turn come in the order of role and text; rows repeated whole are
duplicates.  Tables may be empty and have further columns.

Scale.  A conversation's rows reach one task, as its result does: one audit
cell, and a digest that is sequential over its whole text.  That task streams
over sorted rows: it holds a byte a row, and texts up to ``SPOOL_BYTES``, the
rest lie in a temporary file of the task until its conversation ends.  Whether a
row was seen before is found by a grouped minimum before that, not by a set.
"""

from __future__ import annotations

import hashlib
import math
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPOOL_BYTES = 32 << 20
# Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# States of the role pattern ``(s?(ua)+)?``, read so far: nothing, a system row, up to a user row, up to an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a row that is kept, by state and the row's role initial.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state after a row that is inserted or given a role: only one role fits.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = "sua"
NEVER = 1 << 60
_TEXT = r"[^\x20\x09-\x0D]"


def _options(code: int) -> tuple[list[int | None], bool, int]:
    """A row's byte: the state after keeping it by state before, whether it may stay at all, and what it costs undeleted."""
    role, broken, truncated = code & 3, code & 4, code & 8
    kept = [KEPT.get((s, INITIALS[role - 1])) if role else None for s in range(4)]
    return kept, not broken, TRUNCATED if truncated else 0


_OPTIONS = [_options(c) for c in range(16)]


def _settled(cost: list[int]) -> tuple[int, int, int, int]:
    """Costs from each state when rows may also be inserted before going on."""
    user = min(cost[USER], cost[ASSISTANT] + INSERT)
    assistant = min(cost[ASSISTANT], cost[USER] + INSERT)
    return min(cost[START], user + INSERT), min(cost[SYSTEM], user + INSERT), user, assistant


_END = _settled([0, NEVER, NEVER, 0])


def _back(code: int, after: tuple[int, ...]) -> tuple[int, int, int, int]:
    """The state costs before a row from those after it."""
    kept, stays, extra = _OPTIONS[code]
    cost = []
    for s in range(4):
        best = after[s] + DELETE
        if stays:
            best = min(best, after[NEXT[s]] + REROLE + extra)
            if kept[s] is not None:
                best = min(best, after[kept[s]] + extra)
        cost.append(best)
    return _settled(cost)


def cheapest_edits(codes: bytes) -> tuple[int, Iterator[tuple[str, int]]]:
    """The least cost, and the edits in order with the state after each: initials D, I, K, R, the ASCII-least of all cheapest."""
    n = len(codes)
    size = max(1, math.isqrt(n))
    marks: dict[int, tuple[int, ...]] = {n: _END}
    cost = _END
    for i in range(n - 1, -1, -1):
        cost = _back(codes[i], cost)
        if i % size == 0:
            marks[i] = cost

    def walk():
        s = START
        for lo in range(0, n, size):
            hi = min(n, lo + size)
            costs = [marks[hi]]
            for i in range(hi - 1, lo - 1, -1):
                costs.append(_back(codes[i], costs[-1]))
            costs.reverse()
            i = lo
            while i < hi:
                kept, stays, extra = _OPTIONS[codes[i]]
                now, after = costs[i - lo], costs[i - lo + 1]
                if after[s] + DELETE == now[s]:
                    i += 1
                    yield "D", s
                elif now[NEXT[s]] + INSERT == now[s]:
                    s = NEXT[s]
                    yield "I", s
                elif stays and kept[s] is not None and after[kept[s]] + extra == now[s]:
                    s, i = kept[s], i + 1
                    yield "K", s
                else:
                    s, i = NEXT[s], i + 1
                    yield "R", s
        while s not in (START, ASSISTANT):
            s = NEXT[s]
            yield "I", s

    return cost[START], walk()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the contract's damage by the checksum of ``conv_id:turn``: rows dropped, emptied, cut, repeated, or given the role user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"), copies.alias("copies")).where("kind <> 0")
    return rows.select("conv_id", "turn", "role", "text", F.explode("copies").alias("_copy")).drop("_copy")


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with ``blank``, ``open`` (a text that ends without a stop), ``digest`` of role and text, and ``first``, the least turn of that digest in the conversation, nulls being least."""
    last = F.regexp_extract("text", rf"({_TEXT})[\x20\x09-\x0D]*\z", 1)
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    marked = rows.select("conv_id", "turn", "role", "text", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open"), digest.alias("digest"))
    first = marked.where("not blank").groupBy("conv_id", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    # A join by digest meets a hot conversation in many tasks; a repeated row's key can be split.
    first = first.select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), F.col("first.turn").alias("first"))
    return marked.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left").drop("_conv", "_digest")


class _Conversation:
    """What a task holds of the conversation that it reads."""

    def __init__(self):
        self.codes, self.rows = bytearray(), tempfile.SpooledTemporaryFile(SPOOL_BYTES)
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = self.last = self.before = None

    def add(self, turn, role: str, text: str, blank: bool, open_: bool, digest: bytes, first) -> None:
        repeated = not blank and (turn != first or self.last == (turn, digest))
        self.last = (turn, digest)
        truncated = open_ and not blank and not repeated
        initial = role[:1]
        self.blank += blank
        self.duplicate += repeated
        self.truncated += truncated
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        if turn is not None:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        self.codes.append((INITIALS.find(initial) + 1 if initial else 0) | (4 if blank or repeated else 0) | (8 if truncated else 0))
        for part in (role, text):
            raw = part.encode()
            self.rows.write(len(raw).to_bytes(8, "little") + raw)

    def _read(self) -> bytes:
        return self.rows.read(int.from_bytes(self.rows.read(8), "little"))

    def repaired(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, digest of the repaired rows."""
        cost, edits = cheapest_edits(bytes(self.codes))
        self.rows.seek(0)
        audit, digest, empty = bytearray(), hashlib.sha256(), True
        for edit, state in edits:
            audit += edit.encode()
            role, text = (b"", b"") if edit == "I" else (self._read(), self._read())
            if edit == "D":
                continue
            name = role if edit == "K" else NAMES[state].encode()
            digest.update((b"" if empty else b"\n") + name + b":")
            digest.update(text)
            empty = False
        self.rows.close()
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit.decode(), digest.hexdigest()


RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _repair(batches):
    """Sorted rows of whole conversations -> a row for each."""
    current, ids, kind, out = None, None, None, []

    def batch_of():
        columns = [pa.array([r[0] for r in out], kind)] + [pa.array([r[1 + i] for r in out], pa.string() if name in ("audit", "repaired_sha256") else pa.int64()) for i, name in enumerate(RESULT)]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", *RESULT])

    for batch in batches:
        kind = batch.column(0).type
        for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if current is None or conv != ids:
                if current is not None:
                    out.append((ids, *current.repaired()))
                current, ids = _Conversation(), conv
            current.add(*row)
        if out:
            yield batch_of()
            out = []
    if current is not None:
        out.append((ids, *current.repaired()))
        yield batch_of()


def repair(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) -> conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    marked = _marked(rows).select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", "blank", "open", "digest", F.col("first").cast("bigint").alias("first"))
    longs = [T.StructField(n, T.StringType() if n in ("audit", "repaired_sha256") else T.LongType()) for n in RESULT]
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *longs])
    return marked.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_repair, schema)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Each conversation of the table after damage and repair; one that has lost all rows has zeros, an empty audit and the digest of nothing."""
    done = repair(damaged(conversations))
    ids = conversations.select(F.col("conv_id").alias("_conv")).distinct()
    joined = ids.join(done, F.col("_conv").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("_conv", "conv_id")
    empty: dict[str, Column] = {n: F.coalesce(n, F.lit(0).cast("bigint")) for n in RESULT[:6]} | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))}
    return joined.withColumns(empty).select("conv_id", *RESULT)
