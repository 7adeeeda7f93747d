"""Ordered prefixes over groups of any size.

A plain running window sorts and walks one group in one task.  Here a group is cut into blocks
of its own ordering; block totals are small and are accumulated first, and each block then
runs on its own with the total of everything before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_before(
    df: DataFrame,
    keys: list[str],
    block: Column,
    order: list[Column],
    value: Column,
    combine,
    out: str,
) -> DataFrame:
    """``combine`` (F.sum or F.max) of ``value`` over the earlier rows of the group.

    ``block`` must not decrease along ``order``; rows before the first give null.
    """
    tagged = df.withColumn("_block", block).withColumn("_value", value)
    totals = tagged.groupBy(*keys, "_block").agg(combine("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = totals.select(*keys, "_block", combine("_total").over(earlier).alias("_carried"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    local = tagged.withColumn("_local", combine("_value").over(inside))
    joined = local.join(carried, keys + ["_block"], "left")
    if combine is F.sum:
        merged = F.when(
            F.col("_carried").isNull() & F.col("_local").isNull(), F.lit(None)
        ).otherwise(F.coalesce("_carried", F.lit(0)) + F.coalesce("_local", F.lit(0)))
    else:
        merged = F.greatest("_carried", "_local")
    return joined.withColumn(out, merged).drop("_block", "_value", "_carried", "_local")
