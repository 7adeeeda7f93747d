"""URL filters: explicit host and path rules, and a path-template tree for what they leave open.

Per host, a path is a walk down a tree of segments.  Level by level, a segment keeps its own
branch, or is generalised: digits become ``<n>``; branches without labels share ``*``; and labelled branches whose
share of blocked urls does not differ significantly from their siblings' merge into ``~``.  That holds for any number of
siblings, and labelled and unlabelled branches never share one.  The rules label the urls they decide.  A url is rejected when the smoothed share of blocked urls in its template is above one half; the share is drawn
towards the mean of two others: what the branch above it shows on its own host, handed down the tree level by level, and
what the url's shape (segments with digits as ``<n>``) shows on all hosts.  So a url whose template has no labels is rejected
when both together speak against it, and neither alone rejects it.  Built-in expressions throughout; every table after
the first aggregation is one row per distinct (host, path) or smaller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# Fixed values of the contract: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(_rest(url), r"^[^/?#]*", ""), r"^[^?#]*", 0)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def _ruled(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones win
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def templates(urls: DataFrame, depth: int = 4, z: float = 2.0, strength: float = 4.0) -> DataFrame:
    """(host, path, n, labelled, blocked), one row per host and path -> the same with ``template``, ``shape`` and ``above``.

    Segments below ``depth`` are generalised as one.  ``above`` is the share of blocked urls that a row's branches hand down:
    each is drawn towards the one above it, the host's towards 0.
    """
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = urls.withColumn("_segments", F.transform(segments, lambda s: F.regexp_replace(s, "[0-9]+", "<n>")))
    rows = rows.withColumn("template", F.lit("")).withColumn("shape", F.array_join("_segments", "/")).withColumn("above", F.lit(0.0))
    for level in range(depth):
        seen = rows.withColumn("_segment", F.coalesce(F.get("_segments", F.lit(level)), F.lit("")))
        children = seen.groupBy("host", "template", "_segment").agg(
            F.sum("labelled").alias("l"), F.sum("blocked").alias("b"),
        )
        parents = children.groupBy("host", "template").agg(F.sum("l").alias("all_l"), F.sum("b").alias("all_b"))
        l, b = F.col("l").cast("double"), F.col("b").cast("double")
        rest_l, rest_b = F.col("all_l") - l, F.col("all_b") - b
        pooled = F.col("all_b") / F.greatest(F.col("all_l"), F.lit(1))
        error = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(l, F.lit(1.0)) + 1 / F.greatest(rest_l, F.lit(1.0))))
        gap = F.abs(b / F.greatest(l, F.lit(1.0)) - rest_b / F.greatest(rest_l, F.lit(1.0)))
        branch = (
            F.when(F.col("_segment") == "", "")  # the path ends here
            .when(l == 0, "*")
            .when(rest_l == 0, F.col("_segment"))
            .when(gap <= z * error, "~")
            .otherwise(F.col("_segment"))
        )
        choice = children.join(parents, ["host", "template"]).select("host", "template", "_segment", branch.alias("_branch"), "all_l", "all_b")
        rows = stored(
            seen.join(choice, ["host", "template", "_segment"])
            .withColumn("above", (F.col("all_b") + F.lit(strength) * F.col("above")) / (F.col("all_l") + F.lit(strength)))
            .withColumn("template", F.when(F.col("_segment") == "", F.col("template")).otherwise(F.concat("template", F.lit("/"), "_branch")))
            .drop("_segment", "_branch", "all_l", "all_b"),
            f"url-templates-{level}",
        )
    return rows.withColumn("template", F.when(F.size("_segments") > depth, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))).drop("_segments")


def judge(
    pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES,
    strength: float = 4.0, reject: float = 0.5, **tree,
) -> DataFrame:
    """One row per given row: (key, host, path, rule, verdict, template, blocked_share).

    Null urls and urls without ``://`` have an empty host and path and are judged as one template.
    Rows that repeat are all returned; other columns are ignored; an empty table gives no rows.
    """
    rows = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    urls = rows.groupBy("host", "path").agg(F.count("*").alias("n")).withColumn("_hit", _ruled(F.col("host"), F.col("path"), rules))
    urls = stored(urls.select(
        "host", "path", "n", F.col("_hit.rule").alias("rule"), F.col("_hit.verdict").alias("_given"),
        F.when(F.col("_hit").isNull(), 0).otherwise(F.col("n")).cast("long").alias("labelled"),
        F.when(F.col("_hit.verdict") == "block", F.col("n")).otherwise(0).cast("long").alias("blocked"),
    ), "url-counts")
    leaves = templates(urls, strength=strength, **tree)
    shapes = leaves.groupBy("shape").agg(F.sum("labelled").alias("sl"), F.sum("blocked").alias("sb"))
    shown = shapes.select("shape", (F.col("sb") / (F.col("sl") + 1.0)).alias("shown"))
    own = leaves.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    prior = 0.5 * (F.col("above") + F.col("shown"))
    share = (F.col("b") + F.lit(strength) * prior) / (F.col("l") + F.lit(strength))
    judged = leaves.join(shown, "shape").join(own, ["host", "template"]).withColumn("blocked_share", share)
    decided = judged.select(
        "host", "path", "rule",
        F.coalesce("_given", F.when(F.col("blocked_share") > reject, "block").otherwise("allow")).alias("verdict"),
        "template", "blocked_share",
    )
    return rows.join(decided, ["host", "path"]).select(key, "host", "path", "rule", "verdict", "template", "blocked_share")
