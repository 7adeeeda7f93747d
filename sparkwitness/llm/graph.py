"""Connected components of a link table, by alternating large and small stars.

Every round is two joins of a node with its smallest neighbour; a hub is on the side of a join
that AQE may split, and its minimum is a partial aggregate.  Rounds grow with the logarithm of the
longest chain.  Only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(links: DataFrame, small: bool) -> DataFrame:
    """One step over links (u, v): each node hands its neighbours its smallest neighbour."""
    if small:  # from the larger end only
        near = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        near = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = near.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    joined = near.join(low, "u")
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", F.col("low").alias("v")))
    else:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (u, v) of orderable ids -> (id, component): the smallest id reachable, links' ends only.

    Null ends and self links are left out; repeated links and both directions are welcome.
    """
    links = links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = stored(links, "links")  # read several times below
    state = None
    while True:
        links = stored(_star(_star(links, small=False), small=True), "components")
        seen = links.select(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()
        if state == tuple(seen):
            break
        state = tuple(seen)
    ends = links.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    centres = links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return ends.union(centres)
