"""Repository-relative paths and component-wise scopes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_canonical_path(path: Column) -> Column:
    """True for a non-empty relative path without empty, `.` or `..` components."""
    bad_component = F.exists(F.split(path, "/", -1), lambda c: c.isin("", ".", ".."))
    return F.coalesce(
        (path != "")
        & ~path.contains("\\")
        & ~path.contains("\x00")
        & ~bad_component,
        F.lit(False),
    )


def covers(scope: Column, path: Column) -> Column:
    """A scope covers itself and everything below it, component by component."""
    return (path == scope) | path.startswith(F.concat(scope, F.lit("/")))


def scope_matches(mode: Column, scope: Column, path: Column) -> Column:
    return F.when(mode == "exact", path == scope).when(mode == "prefix", covers(scope, path))


def paths_overlap(a: Column, b: Column) -> Column:
    """Symmetric scope overlap: either path covers the other."""
    return covers(a, b) | covers(b, a)


def ancestors(path: Column, include_self: bool = True) -> Column:
    """All component prefixes of a path, root-most first, as an array."""
    parts = F.split(path, "/", -1)
    last = F.size(parts) if include_self else F.size(parts) - 1
    prefixes = F.transform(
        F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
        lambda i: F.array_join(F.slice(parts, 1, i), "/"),
    )
    return F.when(last >= 1, prefixes).otherwise(F.array().cast("array<string>"))
