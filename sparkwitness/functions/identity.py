"""Canonical identifiers and order-free content fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Digits of a member's hash by which the levels of a digest tree group, below the root.
TREE_DIGITS = (6, 3)
SMALL_BAG = 64  # members that a row may gather; changes no digest


def is_canonical_atom(value: Column, max_bytes: int = 512) -> Column:
    """Non-empty, unpadded, free of NUL and at most ``max_bytes`` bytes."""
    return F.coalesce(
        (value != "")
        & ~value.rlike(r"^\s|\s$")
        & ~value.contains("\x00")
        & (F.octet_length(value) <= max_bytes),
        F.lit(False),
    )


def is_git_sha(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{40}$"), F.lit(False))


def is_snapshot_id(value: Column) -> Column:
    return F.coalesce(value.rlike("^sha256:[0-9a-f]{64}$"), F.lit(False))


def is_repository_name(value: Column) -> Column:
    """`owner/name` with exactly one separator and safe characters on both sides."""
    # Fixed value: the form of a repository name.
    return F.coalesce(value.rlike("^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$"), F.lit(False))


def framed(*values: Column) -> Column:
    """Length-delimited concatenation; a null component differs from an empty one."""
    pieces = []
    for v in values:
        text = v.cast("string")
        pieces.append(
            F.when(text.isNull(), F.lit("-;")).otherwise(
                F.concat(F.octet_length(text).cast("string"), F.lit(":"), text, F.lit(";"))
            )
        )
    return F.concat(*pieces)


def digest(*values: Column) -> Column:
    return F.sha2(framed(*values), 256)


def bag_digest(rows: DataFrame, keys: list[str], member: Column, version: str, out: str = "digest", mostly_small: bool = False) -> DataFrame:
    """(keys, ``out``, members): identity of each group's bag of member digests, as the root of a digest tree.

    Members are grouped by the leading ``TREE_DIGITS`` of their own hash, sorted and hashed there; those hashes are grouped
    by fewer digits and hashed again, up to one per key.  Every step is a hash over whole digests, so a colliding bag would be a collision
    of SHA-256; a group of any size is spread over 16^6 leaves, and no task holds more than a leaf's members or 16^3
    hashes.  With ``mostly_small``, for rows that are cheap to read again, groups of at most ``SMALL_BAG`` members get the same root within
    their row, after one shuffle.  Order of rows cannot matter; a repeated member does, so callers de-duplicate first when they want set
    semantics.  Null members are left out; a group without members has no row.
    """
    given = rows.select(*keys, member.alias("_item")).where(F.col("_item").isNotNull())
    if mostly_small:
        large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SMALL_BAG)
        large = large.select(*[F.col(f"`{k}`").alias(f"_large{i}") for i, k in enumerate(keys)])
        same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_large{i}")) for i, k in enumerate(keys)]
        roots = _small_roots(given.join(large, same, "left_anti"), keys).unionByName(_large_roots(given.join(large, same, "left_semi"), keys))
    else:
        roots = _large_roots(given, keys)
    return roots.select(*keys, F.sha2(F.concat_ws("|", F.lit(version), F.col("members").cast("string"), "_items"), 256).alias(out), "members")


def _large_roots(given: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _items, members) of groups of any size, a shuffle per level."""
    listed = lambda items: F.array_join(F.sort_array(F.collect_list(items)), ",")
    level = given.withColumn("_n", F.lit(1).cast("long")).withColumn("_at", F.col("_item"))
    for digits in TREE_DIGITS:
        level = (
            level.groupBy(*keys, F.substring("_at", 1, digits).alias("_at"))
            .agg(listed("_item").alias("_items"), F.sum("_n").alias("_n"))
            .select(*keys, "_at", F.sha2(F.concat("_at", F.lit(":"), "_items"), 256).alias("_item"), "_n")
        )
    return level.groupBy(*keys).agg(listed("_item").alias("_items"), F.sum("_n").alias("members"))


def _small_roots(given: DataFrame, keys: list[str]) -> DataFrame:
    """The same of groups of at most ``SMALL_BAG`` members: gathered in one shuffle, all levels within the row."""
    rows = given.groupBy(*keys).agg(F.collect_list("_item").alias("_list"))
    n = F.size("_list")
    alone = F.size(F.array_distinct(F.transform("_list", lambda i: F.substring(i, 1, TREE_DIGITS[-1])))) == n
    node = lambda item, at, digits: F.sha2(F.concat(F.substring(at, 1, digits), F.lit(":"), item), 256)

    def branch(member: Column) -> Column:
        """The last level's hash above a member that shares no node with another."""
        item = member
        for digits in TREE_DIGITS:
            item = node(item, member, digits)
        return item

    level = F.transform("_list", lambda i: F.struct(i.alias("at"), i.alias("item")))
    for digits in TREE_DIGITS:
        level = _next_level(level, digits)
    top = F.when(alone, F.transform("_list", branch)).otherwise(F.transform(level, lambda p: p["item"]))
    return rows.select(*keys, F.array_join(F.sort_array(top), ",").alias("_items"), n.cast("long").alias("members"))


def _next_level(level: Column, digits: int) -> Column:
    leading = lambda p: F.substring(p["at"], 1, digits)
    below = lambda at: F.array_join(F.sort_array(F.transform(F.filter(level, lambda p: leading(p) == at), lambda p: p["item"])), ",")
    one = lambda at: F.struct(at.alias("at"), F.sha2(F.concat(at, F.lit(":"), below(at)), 256).alias("item"))
    return F.transform(F.array_distinct(F.transform(level, leading)), one)
