"""References to foreign repositories in prose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALLOW_MARKER = "<!-- allow-external-reference -->"
# The patterns of the rule.
URL = r"""https?://github\.com/[^\s<>()\[\]`"']+"""
SHORTHAND = r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+#[0-9]+)\b"
FENCE = r"^\s*(?:```|~~~)"
TRIM = r"^\s+|\s+$"


def scan_references(
    texts: DataFrame, owned: DataFrame, eligible: DataFrame | None = None, marker: str = ALLOW_MARKER
) -> DataFrame:
    """Foreign URLs and `owner/name#N` outside fences and inline code.

    ``texts(source, repository, text)``; ``owned(owner)`` lists owners that are at home, in lower case.
    A marker exempts its own line or, standing alone, the next one.  ``eligible(source, line)``
    restricts the report to some lines.  A fence line toggles, so a line is fenced iff an odd
    number of fences precede it; only lines with a reference are looked at.
    """
    lines = F.split("text", "\r?\n", -1)
    numbered = F.transform(F.col("_lines"), lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    fences = F.transform(F.filter(numbered, lambda x: x["s"].rlike(FENCE)), lambda x: x["i"])
    hit = F.filter(numbered, lambda x: x["s"].rlike(URL) | x["s"].rlike(SHORTHAND))
    alone = F.regexp_replace(F.get(F.col("_lines"), F.col("x.i") - 1), TRIM, "") == marker
    fenced = F.size(F.filter("_fences", lambda f: f < F.col("x.i"))) % 2 == 1
    candidate = (
        texts.where(F.col("text").contains("github.com/") | F.col("text").rlike(SHORTHAND))
        .withColumn("_lines", lines)
        .withColumn("_fences", fences)
        .withColumn("x", F.explode(hit))
        .where(
            ~fenced & ~F.col("x.s").rlike(FENCE) & ~F.col("x.s").contains(marker)
            & ~F.when(F.col("x.i") > 0, alone).otherwise(F.lit(False))
        )
        .select("source", "repository", (F.col("x.i") + 1).cast("long").alias("line"), F.regexp_replace("x.s", "`[^`]*`", "").alias("_s"))
    )
    if eligible is not None:
        candidate = candidate.join(eligible, ["source", "line"], "left_semi")
    urls = F.transform(
        F.regexp_extract_all("_s", F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")
    )
    named = F.transform(
        urls,
        lambda u: F.struct(
            u.alias("url"),
            F.regexp_extract(u, r"^https?://github\.com/+([^/?#]+/+[^/?#]+)", 1).alias("named"),
        ),
    )
    short = F.transform(
        F.regexp_extract_all("_s", F.lit(SHORTHAND), F.lit(1)),
        lambda u: F.struct(u.alias("url"), F.substring_index(u, "#", 1).alias("named")),
    )
    found = (
        candidate.select("source", "repository", "line", F.inline(F.concat(named, short)))
        .where(F.col("named") != "")
        .withColumn("named", F.lower(F.regexp_replace("named", "/+", "/")))
        .where(F.col("named") != F.lower("repository"))
        .withColumn("owner", F.substring_index("named", "/", 1))
    )
    return found.join(owned.select("owner").distinct(), "owner", "left_anti").select("source", "line", "url")
