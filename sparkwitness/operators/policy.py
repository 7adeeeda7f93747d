"""Order policies over acquire and release events.

``events(session, seq, action, guard, resource)``: ``seq`` counts up within a session, a guard names
what is released later, a resource is what the policy ranks.  Events of one ``seq`` may have a ``position``, which orders them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import running_before

# Steps of a session that are folded together, and blocks of a part: a part is BLOCK * FAN steps.
BLOCK = 1024
FAN = 1024


def unique_ranks(ranks: DataFrame) -> DataFrame:
    """``ranks(resource, rank)`` with exactly one rank; ambiguous resources are left out."""
    return ranks.groupBy("resource").agg(F.min("rank").alias("rank"), F.max("rank").alias("_max")).where(
        F.col("rank") == F.col("_max")
    ).drop("_max")


def _place(events: DataFrame) -> list[Column]:
    return [F.col("seq"), (F.col("position") if "position" in events.columns else F.lit(0)).cast("long").alias("position")]


def _dropped(held: Column, pops: Column, pushed: Column) -> Column:
    """Entries of ``held`` whose guard is neither popped nor pushed anew."""
    again = F.transform(pushed, lambda p: p["guard"])
    return F.filter(held, lambda h: ~F.array_contains(pops, h["guard"]) & ~F.array_contains(again, h["guard"]))


def _then(one: Column, two: Column) -> Column:
    """What two stretches of events do, one after the other.  Associative."""
    return F.struct(
        F.array_union(one["pops"], two["pops"]).alias("pops"),
        F.concat(_dropped(one["held"], two["pops"], two["held"]), two["held"]).alias("held"),
    )


def held_pairs(events: DataFrame, block: int = BLOCK, fan: int = FAN, carry: tuple[str, ...] = ()) -> DataFrame:
    """For each acquisition, the most recently acquired resource that is still held.

    (session, seq, position, held, acquired), and ``held_c`` / ``acquired_c`` for each column c of ``carry``.

    A session is cut into blocks.  What a block does to the held stack is a small summary, the guards it releases and the last
    entry of each guard it leaves held, and summaries combine: blocks into parts, parts over the session.  The stack before
    each block follows from those, and every block then runs on its own.  A guard's older entries never show above its newest and
    go with it, so a summary has one entry per guard.  Events are read twice, whatever the length of a session.
    """
    entry = F.struct("resource", *carry)
    slot = events.select("session", *_place(events), "action", "guard", entry.alias("what"), F.floor(F.col("seq") / block).alias("block"))
    what = slot.schema["what"].dataType.simpleString()
    blocks = slot.groupBy("session", "block").agg(F.sort_array(F.collect_list(F.struct("seq", "position", "action", "guard", "what"))).alias("_events"))

    held_type = f"array<struct<guard:string,what:{what}>>"
    none = F.array().cast(held_type)
    nothing = F.struct(F.array().cast("array<string>").alias("pops"), none.alias("held"))
    without = lambda held, e: F.filter(held, lambda h: h["guard"] != e["guard"])
    taken = lambda held, e: F.array_append(without(held, e), F.struct(e["guard"].alias("guard"), e["what"].alias("what")))

    def summarise(acc, e):
        released = F.struct(F.array_union(acc["pops"], F.array(e["guard"])).alias("pops"), without(acc["held"], e).alias("held"))
        return F.when(e["action"] == "release", released).otherwise(F.struct(acc["pops"].alias("pops"), taken(acc["held"], e).alias("held")))

    parts = (
        blocks.select("session", "block", F.aggregate("_events", nothing, summarise).alias("does"))
        .groupBy("session", F.floor(F.col("block") / fan).alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("block", "does"))).alias("_blocks"))
        .withColumn("_does", F.aggregate("_blocks", nothing, lambda acc, b: _then(acc, b["does"])))
    )
    before = Window.partitionBy("session").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.aggregate(F.collect_list("_does").over(before), nothing, _then)
    step = lambda acc, b: F.struct(
        _then(acc["does"], b["does"]).alias("does"),
        F.array_append(acc["out"], F.struct(b["block"].alias("block"), acc["does"]["held"].alias("_held"))).alias("out"),
    )
    no_starts = F.array().cast(f"array<struct<block:bigint,_held:{held_type}>>")
    starts = parts.withColumn("_start", start).select(
        "session", F.inline(F.aggregate("_blocks", F.struct(F.col("_start").alias("does"), no_starts.alias("out")), step, lambda acc: acc["out"])))

    def walk(acc, e):
        top = F.try_element_at(acc["held"], F.lit(-1))
        pair = F.struct(e["seq"].alias("seq"), e["position"].alias("position"), top["what"].alias("held"), e["what"].alias("acquired"))
        return F.when(
            e["action"] == "release", F.struct(without(acc["held"], e).alias("held"), acc["pairs"].alias("pairs"))
        ).otherwise(F.struct(
            taken(acc["held"], e).alias("held"),
            F.when(top.isNull(), acc["pairs"]).otherwise(F.array_append(acc["pairs"], pair)).alias("pairs"),
        ))

    no_pairs = F.array().cast(f"array<struct<seq:bigint,position:bigint,held:{what},acquired:{what}>>")
    found = blocks.join(starts, ["session", "block"]).select(
        "session", F.inline(F.aggregate("_events", F.struct(F.col("_held").alias("held"), no_pairs.alias("pairs")), walk, lambda acc: acc["pairs"])))
    return found.select(
        "session", "seq", "position", F.col("held.resource").alias("held"), F.col("acquired.resource").alias("acquired"),
        *[F.col(f"{role}.{c}").alias(f"{role}_{c}") for c in carry for role in ("held", "acquired")],
    )


def successor_violations(events: DataFrame, ranks: DataFrame, followers: DataFrame, block: int = BLOCK) -> DataFrame:
    """Acquisitions whose rank may not follow the rank held on top.

    ``followers(rank, follower)``.  Resources without a unique rank are no acquisitions here.  An event carries its rank,
    so the ranks are looked up once.
    """
    ranked = events.join(unique_ranks(ranks), "resource", "left")
    counted = ranked.where((F.col("action") == "release") | ((F.col("action") == "acquire") & F.col("rank").isNotNull()))
    allowed = followers.select(F.col("rank").alias("held_rank"), F.col("follower").alias("acquired_rank")).distinct()
    return (
        held_pairs(counted, block, carry=("rank",))
        .join(allowed, ["held_rank", "acquired_rank"], "left_anti")
        .select("session", "seq", "position", "held", "acquired", "held_rank", "acquired_rank")
    )


def rank_violations(events: DataFrame, ranks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Acquisitions ranked lower than the highest rank so far; ``ranks(resource, level)``."""
    levels = ranks.groupBy("resource").agg(F.min("level").alias("level"), F.max("level").alias("_m")).where("level = _m").drop("_m")
    acquired = events.where(F.col("action") == "acquire").join(levels, "resource")
    with_high = running_before(
        acquired, ["session"], F.floor(F.col("seq") / block), [F.col("seq")], F.col("level"), F.max, "highest"
    )
    return with_high.where(F.col("level") < F.col("highest")).select("session", "seq", "resource", "level", "highest")


def policy_decisions(pairs: DataFrame, ranks: DataFrame, followers: DataFrame, levels: DataFrame) -> DataFrame:
    """allow / deny / unknown of ``pairs(held, acquired)`` under both encodings.

    The successor policy knows ``ranks(resource, rank)`` and ``followers(rank, follower)``; the
    numeric one allows an equal or higher ``levels(resource, level)``.
    """
    known = unique_ranks(ranks)
    side = lambda df, role, value: df.select(F.col("resource").alias(role), F.col(value).alias(f"_{role}_{value}"))
    allowed = followers.select(
        F.col("rank").alias("_held_rank"), F.col("follower").alias("_acquired_rank"), F.lit(True).alias("_ok")
    ).distinct()
    both = lambda value: F.col(f"_held_{value}").isNotNull() & F.col(f"_acquired_{value}").isNotNull()
    verdict = lambda known_, ok: F.when(~known_, "unknown").when(F.coalesce(ok, F.lit(False)), "allow").otherwise("deny")
    return (
        pairs.join(side(known, "held", "rank"), "held", "left")
        .join(side(known, "acquired", "rank"), "acquired", "left")
        .join(side(levels, "held", "level"), "held", "left")
        .join(side(levels, "acquired", "level"), "acquired", "left")
        .join(allowed, ["_held_rank", "_acquired_rank"], "left")
        .select(
            "held", "acquired",
            verdict(both("rank"), F.col("_ok")).alias("successor_decision"),
            verdict(both("level"), F.col("_acquired_level") >= F.col("_held_level")).alias("numeric_decision"),
        )
    )


def expand_effects(events: DataFrame, helper_effects: DataFrame) -> DataFrame:
    """Calls replaced by the acquisitions the helper hands back, under the call's binding.

    A call is an event with ``action = 'call'`` whose resource names the helper;
    ``helper_effects(helper, position, resource)``.  Effects keep the call's ``seq`` and stand there in the order of their
    ``position``, of which there may be any number; other events have position 0.  Every event is read once.
    """
    effects = helper_effects.select(F.col("helper").alias("_helper"), F.col("position").cast("long").alias("_position"), F.col("resource").alias("_effect"))
    call = F.col("action") == "call"
    joined = events.withColumn("_called", F.when(call, F.col("resource"))).join(effects, F.col("_called") == F.col("_helper"), "left")
    return joined.where(~call | F.col("_helper").isNotNull()).select(
        "session", "seq", F.coalesce("_position", F.lit(0).cast("long")).alias("position"), F.when(call, "acquire").otherwise(F.col("action")).alias("action"), "guard",
        F.when(call, F.col("_effect")).otherwise(F.col("resource")).alias("resource"), F.when(call, "helper").otherwise("direct").alias("origin"),
    )
