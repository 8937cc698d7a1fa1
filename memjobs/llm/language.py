"""Language identification of pages by Bayesian evidence fusion.

Evidence for a page's language, multiplied:

- text: byte trigrams of the visible, case-folded text under a model counted
  over all labelled documents, tempered because neighbouring trigrams repeat
  each other;
- the declared markup language, by its probability given the language, counted
  over all other pages from their text posteriors;
- address suffix and host: one prior, smoothed from all pages to suffix,
  registered domain and host, by grouped sums of the other pages' text
  posteriors.  The suffix enters here alone, and a page's own posterior is left
  out on every level, so nothing counts twice.

Posteriors enter the sums as whole numbers of ``UNIT`` parts, as rows of
(page, language), so sums don't depend on their order and any number of
languages is modelled: trigram counts are one row for each language, and pages
are scored against blocks of ``BLOCK_LANGUAGES`` languages.

Defined cases.  Null or empty html gives flat text evidence; a null URL shares
the empty host.  Missing declarations are a value of their own; the first
``<html`` tag counts.  An element that is never closed hides nothing.  Without
any labelled document the language is ``und``.  Ties go to the first language
in code-point order.  Repeated pages are judged alike, each as a page.  Empty
tables of pages give no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memjobs.llm._shared import written
from memjobs.llm._words import text_blocks
from memjobs.llm.minhash import folded

SLOTS = 1 << 14
TEMPER, MOST = 0.05, 60.0  # share of the log likelihood that counts, and its largest span in nats
KAPPA = 4.0  # pages that a level's parent weighs
UNIT = 1 << 20
BLOCK_LANGUAGES = 256  # languages whose log probabilities are broadcast at once: 16 MB
_HELD = 64  # languages that a counting task holds before it hands counts on
_OPEN = re.compile(rb"<(script|style|nav|head)\b")
_LANG = re.compile(rb"""\blang\s*=\s*["']?([a-z]+)""")
_ENTITY = re.compile(rb"&(?:[a-z]+|#[0-9]+);")


def _trigrams(data: np.ndarray) -> np.ndarray:
    """Slot of each trigram; runs of spaces are one space."""
    x = folded(data)
    x = x[np.append(True, (x[1:] != 32) | (x[:-1] != 32))] if len(x) else x
    if len(x) < 3:
        return np.zeros(0, np.int64)
    x = x.astype(np.uint32)
    return (((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


def visible(html: bytes) -> bytes:
    """The text between tags, without scripts, styles, navigation, heads, comments and entities: one pass over the bytes."""
    low, out, at, unclosed = html.lower(), [], 0, set()
    while (tag := low.find(b"<", at)) >= 0:
        out.append(html[at:tag])
        at = -1
        opened = _OPEN.match(low, tag)
        closing = b"-->" if low.startswith(b"<!--", tag) else b"</" + opened[1] if opened else None
        if closing and closing not in unclosed:
            end = low.find(closing, tag + 1)
            if end < 0:
                unclosed.add(closing)
            else:
                at = low.find(b">", end) + 1 or -1
        if at < 0:
            at = low.find(b">", tag) + 1
            if not at:
                out.append(html[tag:])
                at = len(html)
    out.append(html[at:])
    return _ENTITY.sub(b" ", b" ".join(out))


def declared_language(html: bytes) -> str:
    low = html.lower()
    tag = low.find(b"<html")
    end = low.find(b">", tag) if tag >= 0 else -1
    found = _LANG.search(low, tag, end if end >= 0 else len(low)) if tag >= 0 else None
    return found[1].decode() if found else ""


def _count(batches):
    """Trigram counts by language, as they fill up or at the end of a task."""
    held: dict[str, np.ndarray] = {}

    def rows():
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([x.astype("<i8").tobytes() for x in held.values()], pa.binary())], names=["lang", "counts"])
        held.clear()

    for batch in batches:
        lang = batch.column(1).to_pylist()
        for lo, _, data, offsets in text_blocks(batch.column(0)):
            for d in range(len(offsets) - 1):
                if lang[lo + d] not in held:
                    if len(held) >= _HELD:
                        yield from rows()
                    held[lang[lo + d]] = np.zeros(SLOTS, np.int64)
                held[lang[lo + d]] += np.bincount(_trigrams(data[offsets[d] : offsets[d + 1]]), minlength=SLOTS)
    yield from rows()


def _add(batches):
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(counts.as_py(), "<i8")
            sums[lang] = sums[lang] + x if lang in sums else x
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["lang", "counts"])


def text_model(docs: DataFrame) -> DataFrame:
    """(lang, counts): trigram counts of every language, from all documents that name one."""
    labelled = docs.select("text", "lang").where("text is not null and lang is not null")
    schema = "lang string, counts binary"
    lanes = labelled.mapInArrow(_count, schema).repartition("lang", F.pmod(F.spark_partition_id(), F.lit(64))).mapInArrow(_add, schema)
    return written(lanes.repartition("lang").mapInArrow(_add, schema))


def _opened(batches):
    """Pages (page_id, host, html) -> (page_id, host, declared, html as visible text, scores so far: none)."""
    for batch in batches:
        raw = [x.as_py() or b"" for x in batch.column(2).cast(pa.large_binary())]
        declared = pa.array([declared_language(x) for x in raw], pa.string())
        none = pa.array([[]] * batch.num_rows, pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), declared, pa.array([visible(x) for x in raw], pa.binary()), none], names=["page_id", "host", "declared", "shown", "scores"])


def _scored(model):
    """Adds the scores of one block of languages."""

    def job(batches):
        log_p = model.value
        for batch in batches:
            scores = []
            for shown, have in zip(batch.column(3), batch.column(4).to_pylist(), strict=True):
                slots = _trigrams(np.frombuffer(shown.as_py(), np.uint8))
                scores.append(np.concatenate((np.array(have, np.float32), TEMPER * log_p[:, slots].sum(1, dtype=np.float64))).astype(np.float32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(scores, pa.list_(pa.float32()))], names=["page_id", "host", "declared", "shown", "scores"])

    return job


def _posteriors(batches):
    """Scores within ``MOST`` of the best, and the posterior in whole parts as lists of (language, parts)."""
    part = pa.list_(pa.struct([("l", pa.int32()), ("n", pa.int64())]))
    for batch in batches:
        scores, parts = [], []
        for row in batch.column(4).to_pylist():
            x = np.array(row, np.float64)
            x = np.maximum(x - x.max(), -MOST)
            p = np.rint(UNIT * np.exp(x) / np.exp(x).sum()).astype(np.int64)
            scores.append(x)
            parts.append([{"l": int(i), "n": int(p[i])} for i in np.flatnonzero(p)])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scores, pa.list_(pa.float64())), pa.array(parts, part)], names=["page_id", "host", "declared", "scores", "parts"])


def fuse(scores: np.ndarray, own: np.ndarray, everything: np.ndarray, levels: list[np.ndarray], declared: np.ndarray, n_declared: int) -> np.ndarray:
    """The posterior of one page: counts of ``UNIT`` parts by language, the page's own among them."""
    prior = (everything - own + UNIT / len(own)) / (everything.sum() - own.sum() + UNIT)
    for counts in levels:
        others = counts - own
        prior = (others + KAPPA * UNIT * prior) / (others.sum() + KAPPA * UNIT)
    said = (declared - own + UNIT / n_declared) / (everything - own + UNIT)
    total = scores + np.log(prior) + np.log(said)
    p = np.exp(total - total.max())
    return p / p.sum()


def _fused(languages: list[str], everything: np.ndarray, n_declared: int):
    def dense(rows) -> np.ndarray:
        out = np.zeros(len(languages), np.int64)
        for r in rows or ():
            out[r["l"]] = r["n"]
        return out

    def job(batches):
        for batch in batches:
            picked, probability, text = [], [], []
            for r in batch.select(["scores", "parts", "n_suffix", "n_domain", "n_host", "n_declared"]).to_pylist():
                scores = np.array(r["scores"])
                p = fuse(scores, dense(r["parts"]), everything, [dense(r[x]) for x in ("n_suffix", "n_domain", "n_host")], dense(r["n_declared"]), n_declared)
                picked.append(languages[int(p.argmax())])
                probability.append(float(p.max()))
                text.append(languages[int(scores.argmax())])
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), pa.array(picked, pa.string()), pa.array(probability, pa.float64()), batch.column("declared"), pa.array(text, pa.string())], names=["page_id", "host", "lang", "probability", "declared", "text_lang"])

    return job


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, host, lang, probability, declared, text_lang for each page."""
    context = pages.sparkSession.sparkContext
    model = text_model(docs)
    languages = sorted(r.lang for r in model.select("lang").collect())
    kind = pages.schema["page_id"].dataType.simpleString()
    host = F.lower(F.coalesce(F.regexp_extract("url", r"://([^/?#:]*)", 1), F.lit("")))
    base = pages.select("page_id", host.alias("host"), "html")
    opened = base.mapInArrow(_opened, f"page_id {kind}, host string, declared string, shown binary, scores array<float>")
    if not languages:
        und = F.lit("und")
        return opened.select("page_id", "host", und.alias("lang"), F.lit(1.0).alias("probability"), "declared", und.alias("text_lang"))
    for lo in range(0, len(languages), BLOCK_LANGUAGES):
        block = languages[lo : lo + BLOCK_LANGUAGES]
        counts = {r.lang: np.frombuffer(bytes(r.counts), "<i8") for r in model.where(F.col("lang").isin(block)).collect()}
        table = np.array([counts[x] for x in block]) + 0.5
        opened = opened.mapInArrow(_scored(context.broadcast(np.log(table / table.sum(1, keepdims=True)).astype(np.float32))), opened.schema)
    parts = "array<struct<l:int,n:bigint>>"
    slim = opened.mapInArrow(_posteriors, f"page_id {kind}, host string, declared string, scores array<double>, parts {parts}")
    labels = F.split("host", r"\.")
    slim = written(slim.withColumn("suffix", F.element_at(labels, -1)).withColumn("domain", F.array_join(F.slice(F.concat(F.array(F.lit("")), labels), -2, 2), ".")))

    def sums(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys, "l").agg(F.sum("n").alias("n"))

    def lists(rows: DataFrame, name: str, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.collect_list(F.struct("l", "n")).alias(name))  # a row for each language at most

    long = slim.select("host", "domain", "suffix", "declared", F.inline("parts"))
    by_host = written(sums(long, "host", "domain", "suffix"))
    by_suffix = sums(by_host, "suffix")
    everything = np.zeros(len(languages), np.int64)
    for r in sums(by_host).collect():  # a row for each language
        everything[r.l] = r.n
    said = written(lists(sums(long, "declared"), "n_declared", "declared"))
    priors = lists(by_host, "n_host", "host", "domain", "suffix").join(lists(sums(by_host, "domain"), "n_domain", "domain"), "domain").join(lists(by_suffix, "n_suffix", "suffix"), "suffix")
    # Written, so that a hot host or declaration meets plain exchanges that can be split.
    priors = written(priors.select("host", "n_host", "n_domain", "n_suffix"))
    joined = slim.select("page_id", "host", "declared", "scores", "parts").join(priors, "host").join(said, "declared")
    return joined.mapInArrow(_fused(languages, everything, max(1, said.count())), f"page_id {kind}, host string, lang string, probability double, declared string, text_lang string")
