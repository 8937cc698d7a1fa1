"""Goals and errors in session text: ordered Python patterns in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Patterns in their order of use.
GOALS = [
    r"(?:we need to|we should|we must|we want to|we have to)\s+(.{5,200})",
    r"(?:next we should|next we need to|then we should)\s+(.{5,200})",
    r"(?:the goal is|our goal is|the objective is)\s+(?:to\s+)?(.{5,200})",
    r"(?:let's fix|let's implement|let's add|let's refactor)\s+(.{5,200})",
    r"(?:need to investigate|need to debug|need to fix|need to implement)\s+(.{5,200})",
    r"(?:continue from|continue working on|resume work on)\s+(.{5,200})",
    r"(?:priority|blocker|must have|should have)\s*[:-]?\s*(.{5,200})",
]
SPECULATION = [
    r"^(?:I think|Maybe|Perhaps|It might|One option|Alternatively)",
    r"^(?:If we|We could|We might|Another idea|Let's consider)",
]
ERRORS = [
    r"(?:failed because|error:|error\s+\(|exception:|bug:|crash:|panic:|segfault:?)\s*(.{5,300})",
    r"(?:test failed|tests failed|build failed|deploy failed)\s*(.{5,300})",
    r"(?:got error|got an error|encountered error|ran into error)\s*(.{5,300})",
    r"(?s:(?:traceback|stack trace|stacktrace)\s*[:\n]\s*(.{10,500}))",
    r"(?:TypeError|ValueError|KeyError|IndexError|AttributeError|RuntimeError|AssertionError)\s*[:\-]?\s*(.{5,300})",
    r"(?:mypy error|tsc error|eslint error|lint error|clippy error)\s*[:\-]?\s*(.{5,300})",
    r"(?:\b\w+Error\b|\b\w+Exception\b)\s*[:\-]?\s*(.{5,300})",
]
TRACE = r"(Traceback \(most recent call last\):.*?\n(?:  File .+\n(?:    .+\n)*)*(?:\w+Error:.*?\n?.*?)(?=\n\n|\n[A-Z]|\Z))"
MOST = 5
#: What a text has in it wherever a pattern fits: others needn't go through Python.
MAY_AIM = r"(?i)we |should|must|need|goal|objective|let's|continue|resume|priority|blocker"
MAY_FAIL = r"(?i)fail|error|exception|bug:|crash:|panic:|segfault|trace"

_GOALS, _ERRORS, _SPECULATION = ([re.compile(p, re.I) for p in x] for x in (GOALS, ERRORS, SPECULATION))
_TRACE, _TAIL = re.compile(TRACE, re.I | re.S), re.compile(r"[.!?;,]+$")


def _statements(patterns, text: str):
    for pattern in patterns:
        for m in pattern.finditer(text):
            found = m[1].strip()
            if len(found) >= 5:
                yield found


def goals(text: str | None) -> list[str]:
    if not text:
        return []
    found = [_TAIL.sub("", x) for x in _statements(_GOALS, text) if not any(p.match(x) for p in _SPECULATION)]
    return _ordered(found, str.lower)


def errors(text: str | None) -> list[str]:
    if not text:
        return []
    traces = [m[1].strip()[:500] for m in _TRACE.finditer(text)] if "traceback" in text.lower() else []
    return _ordered([x for x in traces if x] + [_TAIL.sub("", x) for x in _statements(_ERRORS, text)], lambda x: x.lower()[:80])


def _ordered(found: list[str], key) -> list[str]:
    """The first of each key, in order."""
    first: dict[str, str] = {}
    for x in found:
        first.setdefault(key(x), x)
    return list(first.values())[:MOST]


@F.pandas_udf(ArrayType(StringType()))
def _goals_of(text: pd.Series) -> pd.Series:
    return text.map(goals, na_action=None)


@F.pandas_udf(ArrayType(StringType()))
def _errors_of(text: pd.Series) -> pd.Series:
    return text.map(errors, na_action=None)


def extract_goals(text: Column) -> Column:
    return _goals_of(F.when(text.rlike(MAY_AIM), text))


def extract_errors(text: Column) -> Column:
    return _errors_of(F.when(text.rlike(MAY_FAIL), text))
