"""Token counts by a unigram model over a public vocabulary, with shared prefixes.

The vocabulary is a file of byte pieces with ranks (path is a parameter, never
copied).  A piece of rank r scores -log(r + 2); a pre-token's segmentation is
the one of the highest total score, and on equal scores the one of fewer
pieces.  The distinct pre-tokens of a task are inserted in a trie; forward
scores are computed once for each node, so once per shared prefix, and the
piece count of the best path is stored at terminal nodes.  The trie of a task
is dropped and begun anew beyond ``max_nodes``, looked at after every
``STEP`` pre-tokens: a bound on memory that changes no count.  Pre-tokens over
``LONGEST`` bytes share no prefix worth keeping: the same scores are computed
for them in one forward pass, which keeps as many positions as the longest
piece has bytes.

Spark ships the vocabulary file to the executors under a digest of its content, so files of one name in two folders are
two vocabularies; its path is one of the driver.

Defined cases.  Null or empty text, empty table: 0 pre-tokens, 0 tokens, no rows.  Repeated rows are counted each.  Every byte is a
piece of its own, so any text has a segmentation.
"""

from __future__ import annotations

import base64
import functools
import math
import re

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from memjobs.llm._shared import shipped

# Fixed value: the usual pre-token pattern of byte-level vocabularies.
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONGEST, STEP = 256, 4096
#: The same splits for texts within the first Latin blocks, by the standard library's engine, which takes half the time.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_LATIN = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+").findall
_BEYOND = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]").search  # other blocks; separators and numbers that the two engines class apart
_ANY = regex.compile(PRETOKEN).findall


def pretokens(text: str) -> list[str]:
    return _ANY(text) if _BEYOND(text) else _LATIN(text)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[bytes, float], int]:
    with open(path, "rb") as lines:
        pieces = {base64.b64decode(a): -math.log(int(b) + 2) for a, b in map(bytes.split, lines)}
    return pieces, max(map(len, pieces))


class CountingTrie:
    """Node i: depth, children by byte, best score and piece count of its prefix, count at terminals."""

    def __init__(self, pieces: dict[bytes, float], longest: int):
        self.pieces, self.longest = pieces, longest
        self.children: list[dict[int, int]] = [{}]
        self.score, self.count = [0.0], [0]
        self.terminal: dict[str, int] = {}
        self._starts: set[bytes] | None = None

    def __len__(self) -> int:
        return len(self.children)

    def tokens(self, pretoken: str) -> int:
        found = self.terminal.get(pretoken)
        if found is None:
            word = pretoken.encode("utf-8", "surrogatepass")
            if len(word) > LONGEST:
                return self._forward(word)
            found = self.terminal[pretoken] = self._insert(word)
        return found

    def _forward(self, word: bytes) -> int:
        """The same best path for one long word: each position hands its score on to the ends of the pieces that begin there."""
        if self._starts is None:
            self._starts = {p[:n] for p in self.pieces for n in range(1, len(p) + 1)}
        pieces, starts, ring = self.pieces, self._starts, self.longest + 1
        none = (-math.inf, 0)
        best = [none] * ring
        best[0] = (0.0, 0)
        for begin in range(len(word)):
            score, count = best[begin % ring]
            best[begin % ring] = none
            for end in range(begin + 1, min(len(word), begin + self.longest) + 1):
                piece = word[begin:end]
                if piece not in starts:
                    break
                s = pieces.get(piece)
                if s is not None:
                    best[end % ring] = max(best[end % ring], (score + s, count - 1))
        return -best[len(word) % ring][1]

    def _insert(self, word: bytes) -> int:
        children, score, count, pieces = self.children, self.score, self.count, self.pieces
        node, path = 0, [0]
        for end in range(1, len(word) + 1):
            below = children[node].get(word[end - 1])
            if below is None:
                best = (-math.inf, 0)
                for begin in range(max(0, end - self.longest), end):
                    s = pieces.get(word[begin:end])
                    if s is not None:
                        at = path[begin]
                        best = max(best, (score[at] + s, -count[at] - 1))
                below = children[node][word[end - 1]] = len(children)
                children.append({})
                score.append(best[0])
                count.append(-best[1])
            node = below
            path.append(node)
        return count[node]


def _count(name: str, max_nodes: int):
    def job(batches):
        pieces, longest = vocabulary(SparkFiles.get(name))
        trie = CountingTrie(pieces, longest)
        for batch in batches:
            counted, tokens = [], []
            for text in batch.column(1):
                found = pretokens(text.as_py() or "")
                counted.append(len(found))
                n = 0
                for lo in range(0, len(found), STEP):
                    have, part = trie.terminal, found[lo : lo + STEP]
                    try:
                        n += sum([have[x] for x in part])
                    except KeyError:
                        n += sum([trie.tokens(x) for x in part])
                    if len(trie) > max_nodes:
                        trie = CountingTrie(pieces, longest)
                tokens.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counted, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    return job


def token_counts(docs: DataFrame, vocabulary_path: str, max_nodes: int = 400_000) -> DataFrame:
    """doc_id, n_pretokens, n_tokens for each input row."""
    rows = docs.select("doc_id", "text")
    with open(vocabulary_path, "rb") as file:
        name = shipped(docs.sparkSession, "vocabulary", file.read())
    return rows.mapInArrow(_count(name, max_nodes), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_pretokens bigint, n_tokens bigint")
