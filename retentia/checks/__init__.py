"""Registered queries, each with an independent SQL statement where SQL can say it."""

from retentia.checks import (  # noqa: F401  (imported for their registrations)
    aggregates,
    encoding,
    evaluation,
    outputs,
    relational,
    scalars,
    scans,
)
from retentia.checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
