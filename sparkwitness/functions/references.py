"""Relation words and `#N` references inside a line of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that open a relation line, and the class each one names.
CLOSING_WORDS = ["close", "closes", "closed", "fix", "fixes", "fixed", "resolve", "resolves", "resolved"]


def refs(line: Column) -> Column:
    """Numbers of the `#N` references of a line, in order; no leading zero."""
    # Fixed value: the form of a reference.
    found = F.regexp_extract_all(line, F.lit(r"(?<![A-Za-z0-9_.-])#([1-9][0-9]*)\b"), F.lit(1))
    return F.transform(found, lambda n: n.cast("long"))


def mentions(line: Column, number: Column) -> Column:
    """True when `#number` occurs as a whole number, whatever stands before the mark."""
    found = F.regexp_extract_all(line, F.lit("#([1-9][0-9]*)"), F.lit(1))
    return F.array_contains(found, number.cast("string"))


def relation_of(line: Column) -> Column:
    """Relation class of a line, or null when the line opens no relation."""
    closing = r"(?i)^\s*(?:" + "|".join(CLOSING_WORDS) + r")\s+\S"
    return (
        F.when(line.rlike(closing), "closes")
        .when(line.rlike(r"(?i)^\s*follow[- ]up to"), "follow_up_to")
        .when(line.rlike(r"(?i)^\s*(?:continuation from|deployment continuation)"), "continuation_from")
        .when(line.rlike(r"(?i)^\s*parent:"), "parent")
        .when(line.rlike(r"(?i)^\s*related:"), "related")
    )
