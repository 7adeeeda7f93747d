"""Scope joins as equi-joins.

``path = scope OR path LIKE scope/%`` plans as a nested loop.  Exploding the path into its
ancestors turns the same predicate into a hash or sort-merge join on equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors


def with_ancestors(df: DataFrame, path: str, out: str, include_self: bool = True) -> DataFrame:
    return df.withColumn(out, F.explode(ancestors(F.col(path), include_self)))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], lpath: str, rpath: str) -> DataFrame:
    """Rows of both sides where either path covers the other; equal paths appear once."""
    left_below = with_ancestors(left, lpath, "_scope").join(
        right.withColumn("_scope", F.col(rpath)), keys + ["_scope"]
    )
    right_below = with_ancestors(right, rpath, "_scope", include_self=False).join(
        left.withColumn("_scope", F.col(lpath)), keys + ["_scope"]
    )
    return left_below.drop("_scope").unionByName(right_below.drop("_scope"))
