"""Evidence under a byte budget.

``rows(target, class, rank, bytes)``: ``rank`` orders the rows of a class, best first.  Evicting the
least valuable row until the rest fits equals keeping the longest prefix, by value, that fits; the
prefix is a running sum, taken in blocks so that one target may have any number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import running_before

# Classes from the most to the least protected.  ``core`` is never evicted.
KEEP_ORDER = [
    "core",
    "companion_exclusion_detail",
    "recent_history_summary",
    "historical_companion_relation",
    "historical_counterexample",
    "historical_support_example",
    "scope_recent_history_summary",
]
RANK_BLOCK = 1024


def _priority() -> Column:
    return F.coalesce(*[F.when(F.col("class") == c, F.lit(i)) for i, c in enumerate(KEEP_ORDER)])


def pack_evidence(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Every row with ``kept``; ``budgets(target, budget)`` in bytes.

    Kept is null for targets whose protected core alone exceeds the budget.
    """
    ranked = rows.withColumn("_priority", _priority())
    core = rows.groupBy("target").agg(F.sum(F.when(F.col("class") == "core", F.col("bytes")).otherwise(0)).alias("_core"))
    optional = F.when(F.col("class") == "core", 0).otherwise(F.col("bytes"))
    block = F.col("_priority") * F.lit(1 << 40).cast("long") + F.floor(F.col("rank") / RANK_BLOCK)
    order = [F.col("_priority"), F.col("rank")]
    before = running_before(ranked, ["target"], block, order, optional, F.sum, "_before")
    used = F.col("_core") + F.coalesce("_before", F.lit(0)) + optional
    kept = F.when(F.col("_core") > F.col("budget"), None).otherwise(
        (F.col("class") == "core") | (used <= F.col("budget"))
    )
    return (
        before.join(core, "target").join(budgets, "target")
        .select("target", "class", "rank", "bytes", kept.alias("kept"))
    )


def packet_summary(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """Bytes kept per target, or the size its protected core would need."""
    sums = packed.groupBy("target").agg(
        F.sum(F.when(F.col("kept"), F.col("bytes"))).alias("kept_bytes"),
        F.sum("bytes").alias("candidate_bytes"),
        F.sum(F.when(F.col("class") == "core", F.col("bytes")).otherwise(0)).alias("core_bytes"),
        F.bool_or(F.col("kept").isNull()).alias("_overflow"),
    )
    return sums.join(budgets, "target").select(
        "target", "budget", "candidate_bytes", "core_bytes", "kept_bytes",
        F.when(F.col("_overflow"), "protected_core_too_large").otherwise("packed").alias("status"),
    )


def eviction_counts(packed: DataFrame) -> DataFrame:
    return (
        packed.where(~F.col("kept")).groupBy("target", "class")
        .agg(F.count(F.lit(1)).alias("evicted"), F.sum("bytes").alias("evicted_bytes"))
    )


def pack_scoped(rows: DataFrame, protected: DataFrame, budgets: DataFrame) -> DataFrame:
    """As :func:`pack_evidence` with scope rows evicted first and selected commits never.

    ``rows`` also carry ``sha`` (null but for scope rows); ``protected(target, sha)``.
    """
    chosen = protected.select("target", "sha").distinct().withColumn("_protected", F.lit(True))
    scope = F.col("class") == KEEP_ORDER[-1]
    tagged = rows.join(chosen, ["target", "sha"], "left").withColumn("_safe", scope & F.col("_protected").isNotNull())
    as_core = tagged.withColumn("class", F.when(F.col("_safe"), "core").otherwise(F.col("class")))
    # A protected row keeps its identity through a rank of its own below zero.
    moved = as_core.withColumn("rank", F.when(F.col("_safe"), -1 - F.col("rank")).otherwise(F.col("rank")))
    packed = pack_evidence(moved.select("target", "class", "rank", "bytes"), budgets)
    safe = (F.col("class") == "core") & (F.col("rank") < 0)
    return packed.select(
        "target",
        F.when(safe, KEEP_ORDER[-1]).otherwise(F.col("class")).alias("class"),
        F.when(safe, -1 - F.col("rank")).otherwise(F.col("rank")).alias("rank"),
        "bytes", safe.alias("protected"), "kept",
    )


def absent_protected(rows: DataFrame, protected: DataFrame) -> DataFrame:
    """Selected commits that the scope window does not contain: an error of the request."""
    window = rows.where(F.col("class") == KEEP_ORDER[-1]).select("target", "sha")
    return protected.select("target", "sha").distinct().join(window, ["target", "sha"], "left_anti")


def cap_companions(companions: DataFrame, k: int = 8, e: int = 2) -> DataFrame:
    """The ``k`` best companions per anchor, ``e`` examples each, and what was left out."""
    best = Window.partitionBy("repository", "anchor").orderBy(F.desc("support"), "path")
    total = companions.groupBy("repository", "anchor").agg(
        F.greatest(F.count(F.lit(1)) - k, F.lit(0)).alias("omitted_companions")
    )
    against = F.col("opportunities") - F.col("support")
    return (
        companions.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .join(total, ["repository", "anchor"])
        .select(
            "repository", "anchor", "path", F.col("rank").cast("long").alias("rank"), "support", "opportunities", "support_percent",
            F.slice("examples", 1, e).alias("examples"),
            F.greatest(F.col("support") - e, F.lit(0)).alias("examples_omitted"),
            F.slice("counterexamples", 1, e).alias("counterexamples"),
            F.greatest(against - e, F.lit(0)).alias("counterexamples_omitted"),
            "omitted_companions",
        )
    )
