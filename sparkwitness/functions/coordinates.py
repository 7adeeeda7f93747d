"""Three-valued comparison of required and actual coordinates.

A requirement struct has fields ``repository, revision, work, scope_mode, scope_path``; a
context has ``repository, revision, work, path``.  Null requirement: the dimension is not
asked.  Null actual: the answer is unknown, which is different from a mismatch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import scope_matches

DIMENSIONS = ["repository", "revision", "work", "scope"]
REQUIREMENT_FIELDS = ["repository", "revision", "work", "scope_mode", "scope_path"]
CONTEXT_FIELDS = ["repository", "revision", "work", "path"]


def exact_status(required: Column, actual: Column) -> Column:
    """applies / invalid / unknown for one coordinate that is required."""
    return (
        F.when(actual.isNull(), "unknown").when(actual == required, "applies").otherwise("invalid")
    )


def _dimension(name: str, required: Column, actual: Column, matched: Column) -> Column:
    status = (
        F.when(actual.isNull(), "missing").when(matched, "matched").otherwise("mismatched")
    )
    return F.when(
        required.isNotNull(),
        F.struct(
            F.lit(name).alias("dimension"),
            status.alias("status"),
            required.alias("required"),
            actual.alias("actual"),
        ),
    )


def dimension_evaluations(req, ctx) -> Column:
    """Array of the evaluated dimensions, absent requirements left out.

    ``req`` and ``ctx`` map a field name to a Column.
    """
    cells = [
        _dimension(d, req(d), ctx(d), req(d) == ctx(d)) for d in ["repository", "revision", "work"]
    ]
    scope = F.concat(req("scope_mode"), F.lit(":"), req("scope_path"))
    cells.append(
        _dimension(
            "scope",
            scope,
            ctx("path"),
            scope_matches(req("scope_mode"), req("scope_path"), ctx("path")),
        )
    )
    return F.array_compact(F.array(*cells))


def has_requirement(req) -> Column:
    return F.coalesce(*[req(f) for f in ["repository", "revision", "work", "scope_path"]]).isNotNull()


def overall_status(req, ctx) -> Column:
    """Any mismatch -> invalid, else any missing -> unknown, else applies."""
    mismatch, missing = [], []
    for d in ["repository", "revision", "work"]:
        mismatch.append(F.coalesce(req(d) != ctx(d), F.lit(False)))
        missing.append(req(d).isNotNull() & ctx(d).isNull())
    mismatch.append(
        F.coalesce(~scope_matches(req("scope_mode"), req("scope_path"), ctx("path")), F.lit(False))
    )
    missing.append(req("scope_path").isNotNull() & ctx("path").isNull())
    any_of = lambda flags: reduce(lambda a, b: a | b, flags)
    return F.when(any_of(mismatch), "invalid").when(any_of(missing), "unknown").otherwise("applies")


def fields(prefix: str):
    """Accessor for columns named ``<prefix><field>``, or ``<prefix>.<field>`` inside a struct."""
    return lambda name: F.col(prefix + name)
