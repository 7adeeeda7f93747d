"""Overlap of concurrent work.

``work_items(snapshot_id, id, head_sha, activity, ...)``, ``work_paths(snapshot_id, id, path)``
with distinct rows, and ``currents(snapshot_id, id)``: the items each snapshot is asked about, one or
several, each answered on its own.
Only rows of the current item meet the others, so a path shared by very many items yields one
row per other item and not all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import covers

HEADS_UP_LIMIT = 12


def in_scope(paths: DataFrame, scope: str | None) -> DataFrame:
    """Rows below a literal scope; the prefix test reaches the scan."""
    if scope is None:
        return paths
    return paths.where(covers(F.lit(scope), F.col("path")))


def change_overlap(paths_a: DataFrame, paths_b: DataFrame, pairs: DataFrame, scope: str | None = None) -> DataFrame:
    """Shared paths of each ``pairs(pair_id, a, b)`` of change sets, with both sizes.

    ``paths_a(a, path)`` and ``paths_b(b, path)``.  A pair without shared paths keeps one row
    with a null path.
    """
    left = in_scope(paths_a, scope).select("a", "path").distinct()
    right = in_scope(paths_b, scope).select("b", "path").distinct()
    size_a = left.groupBy("a").agg(F.count(F.lit(1)).alias("size_a"))
    size_b = right.groupBy("b").agg(F.count(F.lit(1)).alias("size_b"))
    shared = pairs.join(left, "a").join(right, ["b", "path"]).select("pair_id", "path")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    sized = (
        pairs.join(size_a, "a", "left").join(size_b, "b", "left")
        .select("pair_id", "a", "b", zero("size_a"), zero("size_b"))
    )
    # Inner and anti join instead of one outer join: a pair with very many shared paths stays splittable.
    quiet = sized.join(shared, "pair_id", "left_anti").withColumn("path", F.lit(None).cast("string"))
    return shared.join(sized, "pair_id").select(*quiet.columns).unionByName(quiet)


def _current_paths(work_paths: DataFrame, currents: DataFrame) -> DataFrame:
    return work_paths.join(currents, ["snapshot_id", "id"]).select(
        "snapshot_id", F.col("id").alias("current_id"), "path"
    )


def inventory_overlap(
    work_items: DataFrame, work_paths: DataFrame, currents: DataFrame, scope: str | None = None
) -> DataFrame:
    """Paths the current item shares with another item; self is the same id."""
    scoped = in_scope(work_paths, scope)
    kind = F.when(F.col("activity") == "unresolved", "path_overlap_activity_unknown").otherwise("path_overlap")
    activity = work_items.select("snapshot_id", F.col("id").alias("other_id"), "activity")
    return (
        scoped.withColumnRenamed("id", "other_id")
        .join(_current_paths(scoped, currents), ["snapshot_id", "path"])
        .where(F.col("other_id") != F.col("current_id"))
        .join(activity, ["snapshot_id", "other_id"])
        .select("snapshot_id", "current_id", "other_id", "path", "activity", kind.alias("finding_kind"))
    )


def inventory_counts(work_items: DataFrame, currents: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Candidates examined and excluded per snapshot, and its number of overlaps."""
    is_self = F.col("id") == F.col("current_id")
    examined = (
        work_items.join(currents.withColumnRenamed("id", "current_id"), "snapshot_id")
        .groupBy("snapshot_id", "current_id")
        .agg(
            F.count_if(~is_self).alias("candidates_examined"),
            F.count_if(is_self).alias("self_candidates_excluded"),
        )
    )
    found = overlaps.groupBy("snapshot_id", "current_id").agg(F.count(F.lit(1)).alias("_n"))
    return examined.join(found, ["snapshot_id", "current_id"], "left").select(
        "snapshot_id", "current_id", "candidates_examined", "self_candidates_excluded",
        F.coalesce("_n", F.lit(0).cast("long")).alias("direct_overlaps"),
    )


def smallest(rows: DataFrame, keys: list[str], order: list, k: int, tie: str, shares: int = 64) -> DataFrame:
    """The ``k`` first rows of each key in ``order``, with ``rank`` and the number of all rows of the key, ``total``.

    In two steps, so that a key of any size is never in one task: rows are dealt by ``tie`` into ``shares`` of a key, each
    keeps its own k first and counts itself, and those few are ranked again.
    """
    dealt = rows.withColumn("_share", F.pmod(F.xxhash64(tie), F.lit(shares)))
    share = Window.partitionBy(*keys, "_share")
    few = (
        dealt.withColumn("_rank", F.row_number().over(share.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(share))
        .where(F.col("_rank") <= k)
    )
    whole = Window.partitionBy(*keys)
    return (
        few.withColumn("rank", F.row_number().over(whole.orderBy(*order)).cast("long"))
        .withColumn("total", F.sum(F.when(F.col("_rank") == 1, F.col("_n")).otherwise(0)).over(whole))
        .where(F.col("rank") <= k).drop("_share", "_rank", "_n")
    )


def heads_up(
    work_items: DataFrame,
    work_paths: DataFrame,
    focus_paths: DataFrame,
    currents: DataFrame,
    limit: int = HEADS_UP_LIMIT,
) -> DataFrame:
    """Other work on changed or intended paths, largest overlap first, with the omitted count.

    Self is the same id or the same head.  ``focus_paths(snapshot_id, path)`` is the caller's
    stated intent, for every current item of the snapshot.  Each overlap list is bounded by the current item's own paths.
    """
    heads = work_items.select("snapshot_id", "id", "head_sha")
    me = heads.join(currents.select("snapshot_id", "id"), ["snapshot_id", "id"]).select(
        "snapshot_id", F.col("id").alias("current_id"), F.col("head_sha").alias("_my_head"),
        F.explode(F.array(F.struct(F.lit(True).alias("own"), F.col("id").alias("id")), F.struct(F.lit(False).alias("own"), F.lit("").alias("id")))).alias("_asks"),
    ).select("*", F.col("_asks.own").alias("_own"), F.col("_asks.id").alias("_of")).drop("_asks")
    # A current item takes its own changed paths and the focus of its snapshot, in one join.
    offered = work_paths.select("snapshot_id", F.lit(True).alias("_own"), F.col("id").alias("_of"), "path").unionByName(
        focus_paths.select("snapshot_id", F.lit(False).alias("_own"), F.lit("").alias("_of"), "path"))
    effective = offered.join(me, ["snapshot_id", "_own", "_of"]).groupBy("snapshot_id", "current_id", "_my_head", "path").agg(
        F.bool_or("_own").alias("_changed"), F.bool_or(~F.col("_own")).alias("_focus"))
    listed = lambda flag, name: F.sort_array(
        F.collect_list(F.when(F.col(flag), F.col("path")) if flag else F.col("path"))
    ).alias(name)
    found = (
        work_paths.join(effective, ["snapshot_id", "path"])
        .where(F.col("id") != F.col("current_id"))
        .join(heads, ["snapshot_id", "id"])
        .where(F.col("head_sha") != F.col("_my_head"))
        .groupBy("snapshot_id", "current_id", "id")
        .agg(
            F.count(F.lit(1)).alias("overlap_size"),
            listed(None, "overlap_paths"),
            listed("_changed", "changed_overlap_paths"),
            listed("_focus", "focus_overlap_paths"),
        )
    )
    best = smallest(found, ["snapshot_id", "current_id"], [F.desc("overlap_size"), F.col("id")], limit, tie="id")
    return best.select(
        "snapshot_id", "current_id", F.col("id").alias("other_id"), "rank",
        "overlap_size", "overlap_paths", "changed_overlap_paths", "focus_overlap_paths",
        F.greatest(F.col("total") - limit, F.lit(0)).alias("omitted"),
    )


def has_overlap(work_paths: DataFrame, currents: DataFrame) -> DataFrame:
    """Cheap exact prefilter: does any other item touch a path of the current one?"""
    mine = _current_paths(work_paths, currents).alias("m")
    others = work_paths.alias("o")
    same = (F.col("m.snapshot_id") == F.col("o.snapshot_id")) & (F.col("m.path") == F.col("o.path"))
    hit = (
        mine.join(others, same & (F.col("m.current_id") != F.col("o.id")), "left_semi")
        .select("snapshot_id", F.col("current_id").alias("id"))
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    return currents.join(hit, ["snapshot_id", "id"], "left").select(
        "snapshot_id", F.col("id").alias("current_id"), F.coalesce("_hit", F.lit(False)).alias("overlaps")
    )
