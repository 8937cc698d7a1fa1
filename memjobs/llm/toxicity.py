"""Toxicity by compression distance.

Two zstandard dictionaries are trained apart, on ordinary and on toxic text.
A window's distance is its compressed length with the ordinary dictionary less
that with the toxic one.  A window is a folded word.  Windows of several words
work too, a little worse with the same dictionaries (the README has figures),
and far more of them are distinct, so that compressing equal windows of a task
once saves less.  Every character is written as two bytes, and a constant block
stands before the window, so that short windows gain by matches and the frame
is never stored raw.

A window is a hit if its distance reaches the threshold.  A document's
statistic is the log likelihood ratio of its hits, normalised by its windows:
``hits * log(1 + excess / (rate * windows))``, with ``rate`` the share of hits
in ordinary windows and ``excess`` the hits that toxic documents have beyond
it.  Calibrated levels, as many as the sample tells apart, up to ``LEVELS``,
turn the statistic into a probability by isotonic regression.  All of this, and
which of ``TOXIC_BYTES`` the toxic dictionary takes, is fitted on sampled rows
that the dictionaries have not seen, weighted to the share of toxic labels; rows
that are held out take part in nothing.

The sample is bounded: at most ``toxic_rows`` and ``ordinary_rows`` labelled
ids, by order of a hash, one text for each id, and texts of ``sample_bytes`` at
most.  Every document is scored over its whole text.  Only the text enters a
score.

Defined cases.  Null and empty texts have no hits.  Without toxic labels to
learn from, every score is 0.  Repeated rows get equal scores.  Null labels are
left out; of repeated labels of one id all count.  A null id is not held out.
Ids may be of any type; where documents and labels differ in it, they are compared
as strings.
"""

from __future__ import annotations

import bisect
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memjobs.llm.minhash import folded

TOXIC_ROWS, ORDINARY_ROWS = 2_000, 4_000
TOXIC_BYTES, ORDINARY_BYTES = (8_192, 12_288, 16_384), 112_640  # of the toxic sizes, the one that fits unseen rows best
SAMPLE_BYTES = 32_768  # longer texts are scored, but not learned from
TRAIN_WORDS = 4  # words in a training window
LEVELS = 64
CUTOFF = 0.3
MEMO = 400_000
_PAD = b"\0" * 64
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_SECOND = ((np.arange(256) + 101) & 255).astype(np.uint8)


def words(text: bytes) -> list[bytes]:
    return _WORDS.findall(folded(np.frombuffer(text, np.uint8)).tobytes())


def widened(window: bytes) -> bytes:
    a = np.frombuffer(window, np.uint8)
    return np.stack([a, _SECOND[a]], 1).tobytes()


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    threshold: int = 1
    rate: float = 1.0
    excess: float = 0.0
    edges: list[float] = field(default_factory=list)  # least statistic of each level but the lowest
    levels: list[float] = field(default_factory=lambda: [0.0])

    def compressors(self):
        settings = zstandard.ZstdCompressionParameters(
            compression_level=19, strategy=zstandard.STRATEGY_BTULTRA2, window_log=18, hash_log=15, chain_log=16, search_log=7, min_match=3, target_length=32,
            write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        for content in (self.ordinary, self.toxic):
            kept = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            kept.precompute_compress(compression_params=settings)
            yield zstandard.ZstdCompressor(compression_params=settings, dict_data=kept).compress

    def distances(self, plain: dict[bytes, int] | None = None):
        """A function from a list of windows to their distances, with a bounded memory of those seen.

        ``plain`` keeps lengths under the ordinary dictionary for other models with the same one.
        """
        if not self.toxic:
            return lambda found: [0] * len(found)
        ordinary, toxic = self.compressors()
        memo: dict[bytes, int] = {}

        def of(found: list[bytes]) -> list[int]:
            out = []
            for w in found:
                d = memo.get(w)
                if d is None:
                    if len(memo) >= MEMO:
                        memo.clear()
                    x = _PAD + widened(b" " + w + b" ")
                    length = None if plain is None else plain.get(w)
                    if length is None:
                        length = len(ordinary(x))
                        if plain is not None:
                            plain[w] = length
                    d = memo[w] = length - len(toxic(x))
                out.append(d)
            return out

        return of

    def statistic(self, distances: list[int]) -> float:
        hits = sum(d >= self.threshold for d in distances)
        return hits * math.log1p(self.excess / (self.rate * len(distances))) if hits else 0.0

    def score(self, distances: list[int]) -> float:
        return self.levels[bisect.bisect_right(self.edges, self.statistic(distances))]


def isotonic(values: np.ndarray, toxic: np.ndarray, weight: np.ndarray, most: int = LEVELS) -> list[list[float]]:
    """[least value, probability] of ascending levels: adjacent values pool until probabilities ascend."""
    values = np.round(values, 9)
    distinct, at = np.unique(values, return_inverse=True)
    grouped = np.minimum(np.arange(len(distinct)) * most // max(1, len(distinct)), np.arange(len(distinct))) if len(distinct) > most else np.arange(len(distinct))
    pools: list[list[float]] = []
    for g in np.unique(grouped):
        inside = grouped[at] == g
        pools.append([float(values[inside].min()), float(weight[inside & toxic].sum()), float(weight[inside].sum())])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, hit, all_ = pools.pop()
            pools[-1][1] += hit
            pools[-1][2] += all_
    return [[low, hit / all_] for low, hit, all_ in pools]


def _dictionary(windows: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, windows, k=24, d=8).as_bytes()[-(size - 256) :]
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b"".join(windows)[-size:]


def fit(rows: list[tuple[int, str | None, int]], shares: tuple[float, float]) -> Model:
    """rows: (id, text, label); shares: true numbers of ordinary and toxic labels."""
    rows = sorted(rows, key=lambda r: (r[0], r[2], r[1] or ""))
    known = [(words((text or "").encode()), label) for _, text, label in rows]
    by_label = [[w for w, label in known if label == side] for side in (0, 1)]
    learn = [x[: max(1, len(x) * 2 // 3)] for x in by_label]
    test = [x[len(y) :] or x for x, y in zip(by_label, learn, strict=True)]
    if not by_label[0] or not by_label[1]:
        return Model()
    windows = [[widened(b" " + b" ".join(w[i : i + TRAIN_WORDS]) + b" ") for w in texts for i in range(0, len(w), TRAIN_WORDS)] for texts in learn]
    ordinary, plain, best = _dictionary(windows[0], ORDINARY_BYTES), {}, []
    for size in TOXIC_BYTES:
        model = Model(_dictionary(windows[1], size), ordinary)
        best.append((_calibrate(model, model.distances(plain), test, shares), model))
    return max(best, key=lambda x: x[0])[1]


def _calibrate(model: Model, distances, test: list[list[list[bytes]]], shares: tuple[float, float]) -> float:
    """Sets the model's threshold, rates and levels by texts (by label) that its dictionaries have not seen; gives their likelihood."""
    found = [[distances(w) for w in side] for side in test]
    toxic = np.repeat([False, True], [len(x) for x in found])
    weight = np.repeat([shares[k] / len(found[k]) for k in (0, 1)], [len(x) for x in found])
    tried = []
    for threshold in range(2, 16):
        hits, windows = ([np.array([f(d) for d in side]) for side in found] for f in (lambda d: sum(x >= threshold for x in d), len))
        model.threshold, model.rate = threshold, (hits[0].sum() + 0.5) / max(1, windows[0].sum())
        model.excess = max(0.1, float(hits[1].mean() - model.rate * windows[1].mean()))
        values = np.array([model.statistic(d) for side in found for d in side])
        pools = isotonic(values, toxic, weight)
        p = np.array([x[1] for x in pools])[np.searchsorted([x[0] for x in pools], np.round(values, 9), "right") - 1]
        p = np.clip(p, 0.5 / len(p), 1 - 0.5 / len(p))
        likelihood = float((weight * np.log(np.where(toxic, p, 1 - p))).sum())
        tried.append((likelihood, threshold, model.rate, model.excess, [x[0] - 1e-9 for x in pools[1:]], [x[1] for x in pools]))
    most = max(x[0] for x in tried)
    alike = [x for x in tried if x[0] >= most - 1e-9 * abs(most)]  # of equally good thresholds the one in the middle
    _, model.threshold, model.rate, model.excess, model.edges, model.levels = alike[len(alike) // 2]
    return most


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model of the labelled rows that are not held out."""
    usable = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("label_id").isNotNull() & ~held_out("label_id"))
    totals = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}
    if not totals.get(0) or not totals.get(1):
        return Model()
    order = [F.xxhash64("label_id"), F.col("label_id")]
    picked = [usable.where(F.col("label") == side).orderBy(*order).limit(n) for side, n in ((1, toxic_rows), (0, ordinary_rows))]
    sample = F.broadcast(picked[0].union(picked[1]))  # toxic_rows + ordinary_rows rows of two numbers at most
    short = docs.select("doc_id", "text").where(F.octet_length("text") <= sample_bytes)
    # One text of each id and label, whatever the rows of an id: at most toxic_rows + ordinary_rows texts of sample_bytes reach the driver.
    alike = docs.schema["doc_id"].dataType == labels.schema["doc_id"].dataType
    same = F.col("doc_id") == F.col("label_id") if alike else F.col("doc_id").cast("string") == F.col("label_id").cast("string")
    rows = short.join(sample, same).groupBy("label_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("label_id", "text", "label").collect()
    return fit([tuple(r) for r in rows], (totals[0], totals[1]))


def _score(model: Model):
    def job(batches):
        distances = model.distances()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.large_binary())
            scores = [model.score(distances(words(t.as_py() or b""))) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return job


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for each input row."""
    out = docs.select("doc_id", "text").mapInArrow(_score(model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic."""

    at = docs.columns.index("text")

    def job(batches):
        distances = model.distances()
        for batch in batches:
            texts = batch.column(at).cast(pa.large_binary())
            yield batch.filter(pa.array([model.score(distances(words(t.as_py() or b""))) < CUTOFF for t in texts], pa.bool_()))

    return docs.mapInArrow(job, docs.schema)
