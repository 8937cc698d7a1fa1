"""Secret scans: fixed patterns plus sliding-window entropy.

Pattern kinds are ``assign``, ``access`` and ``hex``.  The ``entropy`` kind
takes candidate strings (runs of token characters), sorts each into a
character class, and slides a window over it, keeping the Shannon entropy by
incremental counts: one character enters and one leaves, and n*H changes by
two table look-ups.  A candidate is a secret if the largest window entropy
reaches its class's threshold, unless the allow-list suppresses it.  Where
pattern spans cover a candidate in part, it is judged whole if what they leave
of it is more than words and numbers, so no key is found by halves.

Defined cases.  Null text: empty, no spans.  Spans are in code points, end
exclusive, ordered by start, then kind in the order listed.  Texts of any
length are scanned whole.  Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")


def _either_case(words: str) -> str:
    return re.sub(r"[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words)


# The pattern kinds.
ASSIGN = re.compile("(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the same as filtering [0-9a-f]+
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
SHORTEST = {"assign": 6, "access": 20}

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Bits a character that the window of a candidate must reach, by class; a window of 20 reaches 4.32 at most.
THRESHOLDS = {"hex": 3.0, "alphanumeric": 3.6, "base64": 3.8}
#: Strings that look random and are no secrets: identifiers of content, padding.
ALLOWED = tuple(re.compile(p) for p in (r"(?i)(example|sample|dummy|placeholder|changeme)", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"^(.{1,4})\1+.{0,3}$"))
#: Paths are allowed too, but only if all their pieces are words, numbers or of low entropy: keys hold slashes as well.
_PATH = re.compile(r"^[/_=+-]|//|/.*/.*/")
_PIECE = re.compile(r"(?:(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}|[A-Za-z])\d{0,4}|\d+)?")
_NLOGN = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def character_class(text: str) -> str | None:
    """None: letters or digits alone are words and numbers, not keys."""
    digits, letters = any(c.isdigit() for c in text), any(c.isalpha() for c in text)
    if not (digits and letters):
        return None
    if all(c in "0123456789abcdefABCDEF" for c in text):
        return "hex"
    return "alphanumeric" if text.isalnum() else "base64"


def largest_entropy(text: str, window: int = WINDOW) -> float:
    """The largest Shannon entropy, in bits a character, of any window."""
    counts: dict[str, int] = {}
    weight = best = 0.0
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        weight += _NLOGN[n + 1] - _NLOGN[n]
        if i >= window:
            old = text[i - window]
            n = counts[old]
            counts[old] = n - 1
            weight += _NLOGN[n - 1] - _NLOGN[n]
        if i >= window - 1:
            best = max(best, math.log2(window) - weight / window)
    return best


def is_path(text: str) -> bool:
    return bool(_PATH.search(text)) and all(_is_plain(piece) for piece in text.split("/"))


def _is_plain(piece: str) -> bool:
    """A piece of a path: words and numbers, or long and of low entropy in its own windows."""
    if all(_PIECE.fullmatch(x) for x in re.split(r"[_=+-]", piece)):
        return True
    kind = character_class(piece)
    return len(piece) >= WINDOW and kind is not None and largest_entropy(piece) < THRESHOLDS[kind]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end)."""
    out = []
    low = text.encode("utf-8", "surrogatepass").lower()  # ASCII letters only
    if any(x in low for x in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= SHORTEST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= SHORTEST["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def entropy_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out = []
    held = iter(sorted((s, e) for s, _, e in base))
    near, ahead = [], next(held, None)  # base spans that reach into the candidate
    for m in CANDIDATE.finditer(text):
        while ahead and ahead[0] < m.end():
            near.append(ahead)
            ahead = next(held, None)
        near = [x for x in near if x[1] > m.start()]
        if near and all(_is_plain(x) for x in _uncovered(text, m.start(), m.end(), near)):
            continue
        kind = character_class(m[0])
        if kind and largest_entropy(m[0]) >= THRESHOLDS[kind] and not any(p.search(m[0]) for p in ALLOWED) and not is_path(m[0]):
            out.append((m.start(), 3, m.end()))
    return out


def _uncovered(text: str, start: int, end: int, spans: list[tuple[int, int]]) -> list[str]:
    """What spans, in order of their starts, leave of a stretch of text."""
    out, at = [], start
    for s, e in spans:
        if s > at:
            out.append(text[at:s])
        at = max(at, e)
    return [*out, text[at:end]] if at < end else out


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans) -> str:
    """Overlapping spans become one ``[SECRET]``."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def _scan(redact: bool):
    def job(batches):
        for batch in batches:
            rows = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "text")}
            for text in batch.column(batch.num_columns - 1):
                text = text.as_py()
                base = base_spans(text or "")
                spans = sorted(base + entropy_spans(text or "", base))
                for i, k in enumerate(("n_assign", "n_access", "n_hex")):
                    rows[k].append(sum(x[1] == i for x in base))
                rows["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                rows["spans"].append(_joined(spans))
                if redact:
                    rows["text"].append(redacted(text, spans) if text else text)
            arrays = [pa.array(rows[k], pa.int64() if k[:2] == "n_" else pa.string()) for k in list(rows)[: 5 + redact]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*batch.schema.names[:-1], *list(rows)[: 5 + redact]])

    return job


FOUND = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id with counts by pattern kind, the digest of the pattern spans and all spans."""
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(_scan(False), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {FOUND}")


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns with every span of ``text`` replaced; ``n_chars``, where present, follows."""
    names = docs.columns
    rest = [F.col(f"`{c}`") for c in names if c != "text"]
    packed = docs.select(F.struct(*rest).alias("rest"), F.col("text"))
    out = packed.mapInArrow(_scan(True), f"rest {packed.schema['rest'].dataType.simpleString()}, {FOUND}, text string")
    value = {"text": F.col("text"), "n_chars": F.when(F.col("spans") == "", F.col("rest.`n_chars`")).otherwise(F.length("text").cast("bigint"))}
    return out.select(*[value.get(c, F.col(f"rest.`{c}`")).alias(c) for c in names])
