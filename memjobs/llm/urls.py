"""URL filters over a sorted digest array.

The rules are laid out once as a file: 64-bit xxhash keys of ``host + path`` in
ascending order, verdicts, offsets and the full strings.  It lies in the shared
folder; Spark ships it to every executor (``addFile``), where it is memory-mapped.  A URL probes the
array for each host suffix with each rule-path length, by vectorised binary
search; every hit is confirmed against the stored string, so colliding keys
cannot decide.  The longest confirmed rule wins; on equal length the longer
host.  Without a rule the verdict is ``default``.

Defined cases.  Null URL or none with ``://``: empty host and path, no rule.
A host of any length is probed with its suffixes up to the longest stored host only.
Of rules with one host and path and two verdicts, ``block`` wins.
Only A-Z are lower-cased, in the host alone; ports and user names stay part of
the host.  Repeated rows are judged alike; other columns are passed by.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memjobs.llm._shared import shipped

_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VERDICTS = ("allow", "block")
OUT = "host string, path string, rule string, verdict string"


def split_url(url: str | None) -> tuple[str, str]:
    found = _URL.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def digest_bytes(rules: list[tuple[str, str, str]]) -> bytes:
    """rules: (host, path, verdict).  Layout, little endian: n, m; n keys; n+1 offsets; n host lengths; n verdicts; m path lengths; strings."""
    verdicts: dict[tuple[str, str], int] = {}
    for h, p, v in rules:
        verdicts[h, p] = max(verdicts.get((h, p), 0), VERDICTS.index(v))
    rows = sorted((xxhash.xxh64_intdigest((h + p).encode()), (h + p).encode(), len(h.encode()), v) for (h, p), v in verdicts.items())
    lengths = sorted({len(p.encode()) for _, p, _ in rules})
    blob = b"".join(r[1] for r in rows)
    parts = [
        np.array([len(rows), len(lengths)], "<u8"),
        np.array([r[0] for r in rows], "<u8"),
        np.cumsum([0] + [len(r[1]) for r in rows]).astype("<u8"),
        np.array([r[2] for r in rows], "<u8"),
        np.array([r[3] for r in rows], "<u8"),
        np.array(lengths, "<u8"),
    ]
    return b"".join(x.tobytes() for x in parts) + blob


class DigestArray:
    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, m = (int(x) for x in raw[:16].view("<u8"))
        words = raw[16 : 16 + 8 * (4 * n + 1 + m)].view("<u8")
        self.keys, self.offsets, self.host_len, self.verdict, self.path_lengths = np.split(words, [n, 2 * n + 1, 3 * n + 1, 4 * n + 1])
        self.strings = raw[16 + 8 * (4 * n + 1 + m) :]

    def string(self, i: int) -> bytes:
        return self.strings[int(self.offsets[i]) : int(self.offsets[i + 1])].tobytes()

    def probe(self, candidates: list[tuple[bytes, int]]) -> np.ndarray:
        """For each (host + path, host length): the index of the stored rule, or -1."""
        out = np.full(len(candidates), -1, np.int64)
        if not len(self.keys) or not candidates:
            return out
        keys = np.fromiter((xxhash.xxh64_intdigest(s) for s, _ in candidates), np.uint64, len(candidates))
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        for c in np.flatnonzero(hi > lo):
            text, host = candidates[c]
            for i in range(lo[c], hi[c]):  # equal keys: all of them
                if int(self.host_len[i]) == host and self.string(i) == text:
                    out[c] = i
                    break
        return out


def _suffixes(host: bytes, longest: int) -> list[bytes]:
    """The host and its parent domains, those of at most ``longest`` bytes: as long as a stored host can be."""
    if len(host) > longest:
        host = host[-longest - 1 :].partition(b".")[2]
    out = []
    while host:
        out.append(host)
        host = host.partition(b".")[2]
    return out


def _judge(name: str, default: str):
    def job(batches):
        array = DigestArray(SparkFiles.get(name))
        lengths = [int(x) for x in array.path_lengths]
        longest = int(array.host_len.max(initial=0))
        for batch in batches:
            hosts, paths, candidates, owner = [], [], [], []
            for row, url in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                host, path = split_url(url)
                hosts.append(host)
                paths.append(path)
                h, p = host.encode(), path.encode()
                for suffix in _suffixes(h, longest):
                    for n in lengths:
                        if n <= len(p):
                            candidates.append((suffix + p[:n], len(suffix)))
                            owner.append(row)
            best: list[tuple[int, int, int]] = [(-1, -1, -1)] * len(hosts)
            found = array.probe(candidates)
            for c in np.flatnonzero(found >= 0):
                text, n = candidates[c]
                best[owner[c]] = max(best[owner[c]], (len(text), n, int(found[c])))
            rules = [array.string(i).decode() if i >= 0 else None for _, _, i in best]
            verdicts = [VERDICTS[int(array.verdict[i])] if i >= 0 else default for _, _, i in best]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(x, pa.string()) for x in (hosts, paths, rules, verdicts))],
                names=[*batch.schema.names[:-1], "host", "path", "rule", "verdict"],
            )

    return job


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: key, host, path, rule, verdict.  ``rules``: (host, path, allow or block)."""
    name = shipped(pages.sparkSession, "url-rules", digest_bytes(rules))
    rows = pages.select(key, F.col(url).cast("string").alias("url"))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(_judge(name, default), f"`{key}` {kind}, {OUT}")
