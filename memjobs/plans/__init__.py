"""Registered queries, by subject."""

from memjobs.plans import breadth, compositions, evaluating, projects, relating, upkeep, writing

_SUBJECTS = (upkeep, writing, relating, projects, evaluating, breadth, compositions)


def queries():
    return {k: f for subject in _SUBJECTS for k, f in subject.QUERIES.items()}


def oracles():
    return {k: sql for subject in _SUBJECTS for k, sql in subject.ORACLES.items()}
