"""Unified diff texts and line membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .splits import file_name, read_delimited

LINE_BLOCK = 1024
# Lines of a split are walked in chunks of 2^CHUNK_BITS, so that a split is many groups and no task sorts a whole one.
CHUNK_BITS = 13
# Starts the line that names a change, in a text of several.
CHANGE = "\x1e"
# What a line is: a header of a change, file or hunk, an added line, or another that the new file has.
_CHANGE, _FILE, _HUNK, _ADDED, _MOVES = range(5)


def _runs(body):
    """Runs of added lines of one hunk: deletions do not advance the new file's line number."""
    start = F.struct(F.lit(0).cast("long").alias("line"), F.array().cast("array<struct<start:long,end:long>>").alias("runs"))

    def step(acc, text):
        added = text.startswith("+") & ~text.startswith("+++")
        removed = text.startswith("-") & ~text.startswith("---")
        last = F.try_element_at(acc["runs"], F.lit(-1))
        here = acc["line"]
        joined = F.when(
            F.coalesce(last["end"] + 1 == here, F.lit(False)),
            F.concat(
                F.slice(acc["runs"], F.lit(1), F.greatest(F.size(acc["runs"]) - 1, F.lit(0))),
                F.array(F.struct(last["start"].alias("start"), here.alias("end"))),
            ),
        ).otherwise(F.array_append(acc["runs"], F.struct(here.alias("start"), here.alias("end"))))
        return (
            F.when(added, F.struct((here + 1).alias("line"), joined.alias("runs")))
            .when(removed | text.startswith("\\") , acc)
            .otherwise(F.struct((here + 1).alias("line"), acc["runs"].alias("runs")))
        )

    return F.aggregate(body, start, step, lambda acc: acc["runs"])


def changed_ranges(diffs: DataFrame) -> DataFrame:
    """Merged added-line ranges of ``diffs(change_id, diff)`` per path.

    A text is cut in front of its file and hunk headers; hunks are rows from there on, and only
    hunk headers, not lines, are shuffled.
    """
    pieces = diffs.select(
        "change_id", F.posexplode(F.split("diff", r"(?md)^(?=@@|\+\+\+ )", -1)).alias("pos", "piece")
    ).where(F.col("piece").startswith("@@") | F.col("piece").startswith("+++ "))
    head = F.regexp_replace(F.substring_index("piece", "\n", 1), "\r+$", "")
    is_hunk = F.col("piece").startswith("@@")
    first = F.substring_index(F.regexp_extract("_head", r"\s\++(\S*)", 1), ",", 1)
    body = F.slice("_body", F.lit(2), F.size("_body"))
    # Without a context line in front of the last addition, the usual export, the added lines of a
    # hunk are one run and need no fold.
    is_added = lambda s: s.startswith("+") & ~s.startswith("+++")
    keeps_place = lambda s: (s.startswith("-") & ~s.startswith("---")) | s.startswith("\\")
    first_other = F.array_position(F.transform(body, lambda s: ~is_added(s) & ~keeps_place(s)), True)
    after_last = F.array_position(F.reverse(F.transform(body, is_added)), True)
    plain = (after_last == 0) | (first_other == 0) | (first_other > F.size(body) - after_last + 1)
    added = F.size(F.filter(body, is_added))
    one_run = F.filter(
        F.array(F.struct(F.lit(0).cast("long").alias("start"), (added - 1).cast("long").alias("end"))), lambda r: r["end"] >= 0
    )
    earlier = Window.partitionBy("change_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    hunks = (
        pieces.select(
            "change_id", "pos", "piece", head.alias("_head"), F.when(is_hunk, F.split("piece", "\n", -1)).alias("_body")
        )
        .select(
            "change_id", "pos",
            F.when(~is_hunk, F.substr("_head", F.lit(5))).alias("_named"),
            F.when(is_hunk & first.rlike("^[0-9]+$"), first.cast("long")).alias("_first"),
            F.when(is_hunk, F.when(plain, one_run).otherwise(_runs(body))).alias("_runs"),
        )
        .withColumn("path", F.last("_named", ignorenulls=True).over(earlier))
        .where((F.col("path") != "/dev/null") & F.col("_first").isNotNull())
        .select("change_id", "path", "pos", "_first", F.posexplode("_runs").alias("run", "r"))
        .select(
            "change_id", "path", "pos", "run",
            (F.col("_first") + F.col("r.start")).alias("start"), (F.col("_first") + F.col("r.end")).alias("end"),
        )
    )
    order = Window.partitionBy("change_id", "path").orderBy("pos", "run")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.col("start") > F.max("end").over(before) + 1, F.lit(True))
    return (
        hunks.withColumn("_opens", opens.cast("int"))
        .withColumn("_island", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("change_id", "path", "_island")
        .agg(F.min_by("start", F.struct("pos", "run")).alias("start"), F.max("end").alias("end"))
        .select("change_id", "path", "start", "end")
    )


def ranges_of_files(spark: SparkSession, path: str) -> DataFrame:
    """(change_id, path, start, end): merged added-line ranges of diff texts in files of any size.

    A line ``CHANGE`` + id starts a change; lines before the first belong to the change named like the file.  Files
    are read in splits, line by line, and walked in chunks of lines, so a diff of any length is many tasks: each chunk finds its
    own headers, and what holds at its first line, the change, path, hunk and line number, is carried from the chunks before it, a row each.
    From a chunk on there is a row per run of added lines; those of one path of one change are merged in one sorted group.
    """
    starts = lambda head: F.col("value").startswith(head)
    rest = lambda at: F.regexp_replace(F.substr("value", F.lit(at)), "\r+$", "")
    first = F.substring_index(F.regexp_extract("value", r"\s\++(\S*)", 1), ",", 1)
    stays = (starts("-") & ~starts("---")) | starts("\\")
    kind = (
        F.when(starts(CHANGE), _CHANGE).when(starts("+++ "), _FILE).when(starts("@@"), _HUNK)
        .when(starts("+") & ~starts("+++"), _ADDED).when(~stays, _MOVES)
    )
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    part = ["chunk", "split", "name"]
    # Lines that neither head anything nor move the new file's line number are left out before the shuffle.
    kinds = read_delimited(spark, path, "\n", named=False).withColumn("kind", kind.cast("byte")).where("kind IS NOT NULL").select(
        "name", "split", F.shiftright("place", CHUNK_BITS).alias("chunk"), "place", "kind",
        F.when(is_(_CHANGE), rest(2)).when(is_(_FILE), rest(5)).alias("note"),
        F.when(is_(_HUNK) & first.rlike("^[0-9]+$"), first.cast("long")).alias("first"),
    )
    here = Window.partitionBy(*part).orderBy("place")
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    latest = lambda test, what: F.last(F.when(test, what), ignorenulls=True).over(upto)
    head = F.struct("first", "moved")
    walked = kinds.withColumn("moved", F.sum(is_(_ADDED, _MOVES).cast("int")).over(upto)).select(
        *part, "place", "kind", "moved", F.lead("kind").over(here).alias("_next"),
        # A header replaces what stands below it: a change its path, a path its hunk.
        latest(is_(_CHANGE), F.col("note")).alias("change"),
        latest(is_(_CHANGE, _FILE), F.struct(F.when(is_(_FILE), F.col("note")).alias("path"))).alias("file"),
        latest(is_(_CHANGE, _FILE, _HUNK), head).alias("hunk"),
        latest(~is_(_ADDED), F.col("moved")).alias("_other"),
    )
    # A chunk is one row with a run's last line each, and its own last line, where stands what it hands on.
    closes = is_(_ADDED) & ~F.col("_next").eqNullSafe(_ADDED)
    added = F.when(closes, F.col("moved") - F.coalesce("_other", F.lit(0)))
    chunks = (
        walked.where(closes | F.col("_next").isNull()).groupBy(*part)
        .agg(F.collect_list(F.struct("place", "moved", added.alias("added"), "change", "file", "hunk", F.col("_next").isNull().alias("last"))).alias("lines"))
        # Read twice, computed once: both readers take all of it, so they share this exchange, whose keys have an order of their
        # own as Spark would leave out an exchange like the one before.
        .repartition(*reversed(part))
    )
    order = Window.partitionBy("name").orderBy("split", "chunk")
    earlier, since = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    carried = (
        chunks.select(*part, F.filter("lines", lambda line: line["last"])[0].alias("end"), F.exists("lines", lambda line: line["added"] > 0).alias("_adds"))
        .withColumn("_passed", F.sum("end.moved").over(since) - F.col("end.moved"))
        .withColumn("_at", F.when(F.col("end.hunk").isNotNull(), F.struct(F.col("end.hunk.first").alias("first"), (F.col("_passed") + F.col("end.hunk.moved")).alias("moved"))))
        .select(
            *part, "_adds", "_passed", F.last("end.change", True).over(earlier).alias("_change"), F.last("end.file", True).over(earlier).alias("_file"),
            F.last("_at", True).over(earlier).alias("_hunk"), file_name(spark, path, F.col("name")).alias("_name"),
        )
        .where("_adds").drop("_adds")
    )
    run = lambda field: F.col(f"run.{field}")
    after = F.when(run("hunk").isNotNull(), run("hunk.first") + run("moved") - run("hunk.moved")).otherwise(
        F.col("_hunk.first") + F.col("_passed") - F.col("_hunk.moved") + run("moved"))
    runs = (
        chunks.join(carried, part, "left").withColumn("run", F.explode_outer("lines"))
        .select(
            "name", "split", run("place").alias("place"), F.coalesce(run("change"), "_change", "_name").alias("change_id"),
            F.coalesce(run("file"), "_file")["path"].alias("path"), (after - run("added")).alias("start"), (after - 1).alias("end"),
        )
        .where(F.col("path").isNotNull() & (F.col("path") != "/dev/null") & F.col("start").isNotNull())
    )
    # Runs to ranges over the chunks of a change.  Ranges open at ever later lines and reach ever further, and a range's runs follow
    # each other, so its last run holds all of it and no group is built.
    along = Window.partitionBy("name", "change_id", "path").orderBy("split", "place")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    opened = runs.withColumn("_opens", F.when(F.coalesce(F.col("start") > reach + 1, F.lit(True)), F.col("start")))
    return opened.select(
        "change_id", "path", F.max("_opens").over(upto).alias("start"), F.max("end").over(upto).alias("end"),
        F.lead(F.col("_opens").isNotNull(), 1, True).over(along).alias("_closes"),
    ).where("_closes").drop("_closes")


def facts_in_ranges(facts: DataFrame, ranges: DataFrame, keys: list[str], block: int = LINE_BLOCK) -> DataFrame:
    """Facts whose line lies in a changed range of the same ``keys``.

    Lines and ranges meet in blocks of lines, so a path with very many of both is spread over
    tasks and compares only neighbours.
    """
    blocks = F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.col("end") / block)))
    spans = ranges.select(*keys, F.col("start").alias("_start"), F.col("end").alias("_end"), blocks.alias("_block"))
    placed = facts.withColumn("_block", F.floor(F.col("line") / block))
    on = [placed[k] == spans[k] for k in keys] + [
        placed["_block"] == spans["_block"], placed["line"].between(spans["_start"], spans["_end"]),
    ]
    return placed.join(spans, on, "left_semi").drop("_block")
