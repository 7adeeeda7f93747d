"""Mixing sources to target weights by pivotal dependent rounding.

Sources share a budget of words by weight, none above ``most`` times its own size (the excess is
shared again).  A document of a source is due ``target / size`` copies: the whole part is certain, the
fraction is rounded so that the words a source gives stay at its target.

Rounding is a tree.  Level 0 cuts each source into buckets of about ``FAN`` documents and walks
each bucket from its largest document down: the document's fraction is paired with the pool of all
smaller ones, and words move from one to the other, at random and fair in expectation, until one of
them is integral.  Words in the bucket are preserved exactly, and the one fraction that remains is
normally its smallest document.  Upper levels pair the remaining fractions in buckets of buckets, until
one is left per source.  A hot source is many buckets; nothing else of it meets in one task.
Built-in expressions throughout.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, words_of

FAN = 64
# Fixed values of the contract.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n) -> the same with ``target``: weights by code point order, null last.

    A source is full exactly when ``most * size / weight`` is at most the common level at which the
    rest absorb the budget, so one pass over the sources in that order finds the level.  The window
    runs over one row per source, a summary.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    given = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("_w", F.element_at(given, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    everything = Window.partitionBy()
    by_level = Window.orderBy("_full_at", F.col("source").asc_nulls_last())
    spread = (
        ranked.withColumn("_full_at", F.col("source_size") * F.lit(most) / F.col("_w"))
        .withColumn("_budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("_wall", F.sum("_w").over(everything))
        .withColumn("_full", F.coalesce(F.sum(F.col("source_size") * F.lit(most)).over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_wfull", F.coalesce(F.sum("_w").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        # the level if this source and all after it are not full
        .withColumn("_level", (F.col("_budget") - F.col("_full")) / (F.col("_wall") - F.col("_wfull")))
        .withColumn("_open", F.col("_full_at") > F.col("_level"))
    )
    first = F.min(F.when(F.col("_open"), F.struct("_full_at", "_level"))).over(everything)["_level"]
    return spread.withColumn("_first", first).select(
        "source", "source_size", "n",
        F.when(F.col("_first").isNull(), F.col("source_size") * F.lit(most))
        .otherwise(F.least(F.col("source_size") * F.lit(most), F.col("_first") * F.col("_w"))).alias("target"),
    )


def _uniform(*columns) -> Column:
    """A number in [0, 1) fixed by the given columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _fold_pool(items: Column, row: str) -> Column:
    """Level 0: (p, items largest first, all at p) -> decisions, and the fraction that remains.

    State: the pool's fraction ``p``, the words ``rest`` in the pool, decisions, remaining item.
    """
    decided, left = f"array<struct<row:{row},one:int>>", f"struct<row:{row},p:double>"
    start = F.struct(
        F.element_at(items, 1)["p"].alias("p"),
        F.aggregate(items, F.lit(0.0), lambda a, x: a + x["row"]["size"]).alias("rest"),
        F.array().cast(decided).alias("done"), F.lit(None).cast(left).alias("left"),
    )

    def step(s, x):
        size = x["row"]["size"].cast("double")
        rest = s["rest"] - size
        p = s["p"]
        up = F.least(size * (1 - p), p * rest)  # words into the document, out of the pool
        down = F.least(size * p, (1 - p) * rest)
        rises = x["u"] * (up + down) < down
        moved = F.when(rises, up).otherwise(-down)
        now = p + moved / size
        pool = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p - moved / F.greatest(rest, F.lit(1e-9))))
        # which side became integral is known from the minimum that was taken
        whole = F.when(rises, size * (1 - p) <= p * rest).otherwise(size * p <= (1 - p) * rest)
        pool_whole = F.when(rises, p * rest <= size * (1 - p)).otherwise((1 - p) * rest <= size * p)
        pool = F.when(pool_whole, F.when(rises, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(pool)
        settled = (p <= 0) | (p >= 1)
        one = F.when(settled, F.when(p >= 1, 1).otherwise(0)).otherwise(F.when(rises, 1).otherwise(0)).cast("int")
        mark = F.array(F.struct(x["row"].alias("row"), one.alias("one")))
        last = ~settled & (rest <= 0)  # nothing left to pair with
        take = settled | (~last & whole)
        return F.struct(
            F.when(settled | last, p).otherwise(pool).alias("p"), rest.alias("rest"),
            F.when(take, F.concat(s["done"], mark)).otherwise(s["done"]).alias("done"),
            F.when(take, s["left"]).otherwise(F.struct(x["row"].alias("row"), F.when(last, p).otherwise(now).alias("p"))).alias("left"),
        )

    return F.aggregate(items, start, step, lambda s: F.struct(s["done"], s["left"]))


def _fold_pairs(items: Column, row: str) -> Column:
    """Upper levels: pair the carried fraction with the next, keep the words of the two together."""
    decided, left = f"array<struct<row:{row},one:int>>", f"struct<row:{row},p:double>"
    start = F.struct(F.array().cast(decided).alias("done"), F.lit(None).cast(left).alias("left"))

    def step(s, x):
        a, b = s["left"], x
        sa, sb = a["row"]["size"].cast("double"), b["row"]["size"].cast("double")
        up = F.least(sa * (1 - a["p"]), sb * b["p"])
        down = F.least(sa * a["p"], sb * (1 - b["p"]))
        rises = x["u"] * (up + down) < down
        a_whole = F.when(rises, sa * (1 - a["p"]) <= sb * b["p"]).otherwise(sa * a["p"] <= sb * (1 - b["p"]))
        b_whole = F.when(rises, sb * b["p"] <= sa * (1 - a["p"])).otherwise(sb * (1 - b["p"]) <= sa * a["p"])
        pa = a["p"] + F.when(rises, up).otherwise(-down) / sa
        pb = b["p"] - F.when(rises, up).otherwise(-down) / sb
        da = F.array(F.struct(a["row"].alias("row"), F.when(rises, 1).otherwise(0).cast("int").alias("one")))
        db = F.array(F.struct(b["row"].alias("row"), F.when(rises, 0).otherwise(1).cast("int").alias("one")))
        first = a["row"].isNull()
        return F.struct(
            F.when(first, s["done"])
            .when(a_whole & b_whole, F.concat(s["done"], da, db))
            .when(a_whole, F.concat(s["done"], da)).otherwise(F.concat(s["done"], db)).alias("done"),
            F.when(first, F.struct(b["row"].alias("row"), b["p"].alias("p")))
            .when(a_whole & b_whole, F.lit(None).cast(left))
            .when(a_whole, F.struct(b["row"].alias("row"), pb.alias("p")))
            .otherwise(F.struct(a["row"].alias("row"), pa.alias("p"))).alias("left"),
        )

    return F.aggregate(items, start, step, lambda s: F.struct(s["done"], s["left"]))


def mix(
    documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0,
    key: str | None = None,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of documents (doc_id, text, source).

    Null text has size 0; a null source is a source of its own, last.  Documents without words get no
    fraction.  Rows that repeat a doc_id are numbered and decided each on their own.  An
    empty table gives no rows.  Other columns are ignored, but for ``key``: a bigint column that tells rows of
    one id (null, say) apart and is returned too, so that decisions find back to their rows.
    """
    own = [key] if key else []
    row_type = "struct<" + ",".join(f"`{c}`:bigint" for c in ["h", "size", "doc_id", "base", "k", *own]) + ">"
    sized = documents.select("doc_id", "source", words_of(F.col("text")).alias("size"), *own)
    sized = stored(sized, "mixing-sizes")  # ids and sizes only
    # Rows that agree in all of this are told apart by a number, so that each is decided on its own.
    twins = sized.groupBy("doc_id", "source", "size", *own).agg(F.count("*").alias("_times"))
    items = twins.select("doc_id", "source", "size", *own, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))).alias("k"))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    shares = stored(targets(per_source, weights, share, most), "mixing-targets")
    largest = shares.agg(F.max("n")).first()[0] or 0
    levels = max(1, math.ceil(math.log(max(largest, 2), FAN) - 1e-9))

    s = shares.withColumnRenamed("source", "_source")
    # One row per source with a bounded record; Spark broadcasts it or not by its measured size.
    joined = items.join(s, items["source"].eqNullSafe(s["_source"])).drop("_source")
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.least(F.floor(due), F.lit(int(most))).cast("long")
    joined = joined.withColumn("_due", due).withColumn("base", base).withColumn("p", F.col("_due") - F.col("base"))
    plain = (F.col("size") == 0) | (F.col("p") <= 0)
    certain = joined.where(plain).select("doc_id", "source", "size", *own, F.col("base").alias("copies"))

    h = F.xxhash64("doc_id", "k", "size", *own, F.lit(seed))
    width = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(FAN))).cast("long")
    level = joined.where(~plain).select(
        "source", F.pmod(F.xxhash64("doc_id", "k", *own, F.lit(seed + 1)), width).alias("bucket"),
        F.struct(h.alias("h"), "size", "doc_id", "base", "k", *own).alias("row"), "p",
    )
    decided = []
    for depth in range(levels):
        u = _uniform(F.col("row.h"), F.lit(depth), F.lit(seed + 2)).alias("u")
        grouped = level.groupBy("source", "bucket").agg(
            F.sort_array(F.collect_list(F.struct(F.struct("row.size", "row.h", "row.doc_id", "row.base", "row.k", *[f"row.{c}" for c in own]).alias("at"), "row", "p", u)), asc=False).alias("items")
        )  # a bucket holds about FAN rows
        fold = _fold_pool if depth == 0 else _fold_pairs
        done = stored(grouped.select("source", "bucket", fold(F.col("items"), row_type).alias("f")).select(
            "source", "bucket", F.col("f.done").alias("done"), F.col("f.left").alias("left")
        ), f"mixing-level-{depth}")
        decided.append(done.select("source", F.explode("done").alias("d")).select(
            F.col("d.row.doc_id").alias("doc_id"), "source", F.col("d.row.size").alias("size"),
            *[F.col(f"d.row.{c}").alias(c) for c in own], (F.col("d.row.base") + F.col("d.one")).alias("copies"),
        ))
        level = done.where(F.col("left").isNotNull()).select(
            "source", F.floor(F.col("bucket") / FAN).cast("long").alias("bucket"), F.col("left.row").alias("row"), F.col("left.p").alias("p"),
        )
    final = level.select(
        F.col("row.doc_id").alias("doc_id"), "source", F.col("row.size").alias("size"), *[F.col(f"row.{c}").alias(c) for c in own],
        (F.col("row.base") + (_uniform(F.col("row.h"), F.lit(seed + 3)) < F.col("p")).cast("long")).alias("copies"),
    )
    out = certain
    for part in [*decided, final]:
        out = out.unionByName(part)
    return out.join(s, out["source"].eqNullSafe(s["_source"])).select("doc_id", "source", "size", "source_size", "target", "copies", *own)
