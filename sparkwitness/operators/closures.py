"""Administrative closures, re-reports and duplicate challenges of issues.

``issues(repository, number, state, reporter, body)``,
``comments(repository, number, comment_id, actor, body)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import TRIM, lines

# The bot's name and the exact texts by which it closes or suggests.
BOT = "github-actions[bot]"
INACTIVE_START = "Closing for now — inactive for too long. Please [open a new issue](https://github.com/"
INACTIVE_END = "/issues/new/choose) if this is still relevant."
DUPLICATE_LIST = "possible duplicate issues:"
DUPLICATE_NOTICE = "This issue will be automatically closed as a duplicate in 3 days."
REJECTION = "Not a duplicate of the suggested issues."
RE_REPORT = r"^\*\*Re-reporting\*\* the bug from #([1-9][0-9]*)(?:[ (.,:;-].*)?$"


def _chosen(count: Column) -> Column:
    return F.when(count.isNull() | (count == 0), "none").when(count == 1, "selected").otherwise("ambiguous")


def closure_receipts(issues: DataFrame, comments: DataFrame) -> DataFrame:
    """The one comment that closed an issue for inactivity: selected, none or ambiguous."""
    found = (
        comments.where(_is_closure(F.col("actor"), F.col("body")))
        .groupBy("repository", "number")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("comment_id").alias("_id"))
    )
    return issues.join(found, ["repository", "number"], "left").select(
        "repository", "number", _chosen(F.col("_n")).alias("closure"),
        F.when(F.col("_n") == 1, F.col("_id")).alias("comment_id"),
    )


def _re_report(body: Column) -> tuple[Column, Column]:
    """(selected, none or ambiguous; the number that is reported again)."""
    hits = F.filter(
        F.transform(lines(body), lambda s: F.regexp_extract(F.regexp_replace(s, TRIM, ""), RE_REPORT, 1)),
        lambda n: n != "",
    )
    return _chosen(F.size(hits)), F.when(F.size(hits) == 1, F.get(hits, F.lit(0)).cast("long"))


def re_reports(issues: DataFrame) -> DataFrame:
    """Issues that say once which issue they report again; several lines are ambiguous."""
    state, number = _re_report(F.col("body"))
    return issues.select("repository", "number", state.alias("re_report"), number.alias("prior_number"))


def _is_closure(actor: Column, body: Column) -> Column:
    return (actor == BOT) & (body == F.concat(F.lit(INACTIVE_START), F.col("repository"), F.lit(INACTIVE_END)))


def _is_suggestion(actor: Column, body: Column) -> Column:
    return (actor == BOT) & body.contains(DUPLICATE_LIST) & body.contains(DUPLICATE_NOTICE)


def _challenge(suggested: Column, rejected: Column, suggestion: Column, rejection: Column) -> Column:
    return (
        F.when((suggested == 0) & (rejected == 0), "none")
        .when((suggested == 1) & (rejected == 1) & (suggestion != rejection), "challenged")
        .otherwise("ambiguous")
    )


def duplicate_challenges(issues: DataFrame, comments: DataFrame) -> DataFrame:
    """One bot suggestion answered by one rejection of the reporter."""
    suggestion = _is_suggestion(F.col("actor"), F.col("body"))
    rejection = (F.col("actor") == F.col("reporter")) & F.col("body").startswith(REJECTION)
    reporters = issues.select("repository", "number", "reporter")
    found = (
        comments.join(reporters, ["repository", "number"])
        .groupBy("repository", "number")
        .agg(
            F.count_if(suggestion).alias("_s"), F.count_if(rejection).alias("_r"),
            F.min(F.when(suggestion, F.col("comment_id"))).alias("_sid"),
            F.min(F.when(rejection, F.col("comment_id"))).alias("_rid"),
        )
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    state = _challenge(zero("_s"), zero("_r"), F.col("_sid"), F.col("_rid"))
    challenged = lambda c: F.when(F.col("challenge") == "challenged", F.col(c))
    return issues.join(found, ["repository", "number"], "left").withColumn("challenge", state).select(
        "repository", "number", "challenge", challenged("_sid").alias("suggestion_id"), challenged("_rid").alias("rejection_id")
    )


def closure_episodes(issues: DataFrame, comments: DataFrame) -> DataFrame:
    """A closed issue reported again: closing it did not show that the failure was gone.

    Every later issue that says once what it reports again has a row where that prior issue is closed and some comment
    closed it.  An ambiguous closure or challenge of the prior issue rejects the episode, with the ``rejection``.  Comments are
    folded once, for closures and challenges together.
    """
    # Of a comment only what it is moves on, and whose rejection it is; the others are left out before they are shuffled.
    body = F.col("body")
    said = comments.select(
        "repository", "number", "comment_id", _is_closure(F.col("actor"), body).alias("_closes"), _is_suggestion(F.col("actor"), body).alias("_suggests"),
        F.when(body.startswith(REJECTION), F.col("actor")).alias("_rejecter"),
    ).where(F.col("_closes") | F.col("_suggests") | F.col("_rejecter").isNotNull())
    closed, suggested, rejected = F.col("_closes"), F.col("_suggests"), F.col("_rejecter") == F.col("reporter")
    ids = lambda test: F.min(F.when(test, F.col("comment_id")))
    prior = (
        issues.where(F.col("state") == "closed").select("repository", "number", "reporter")
        .join(said, ["repository", "number"])
        .groupBy("repository", "number").agg(
            F.count_if(closed).alias("_c"), F.count_if(suggested).alias("_s"), F.count_if(rejected).alias("_r"),
            ids(closed).alias("_cid"), ids(suggested).alias("_sid"), ids(rejected).alias("_rid"),
        )
        .where(F.col("_c") > 0)
        .withColumn("closure", _chosen(F.col("_c")))
        .withColumn("challenge", _challenge(F.col("_s"), F.col("_r"), F.col("_sid"), F.col("_rid")))
    )
    state, number = _re_report(F.col("body"))
    later = issues.select(
        "repository", F.col("number").alias("later_issue"), F.col("state").alias("later_state"), state.alias("_re_report"), number.alias("number")
    ).where((F.col("_re_report") == "selected") & (F.col("later_issue") != F.col("number")))
    rejection = F.when(F.col("closure") == "ambiguous", "ambiguous_closure").when(F.col("challenge") == "ambiguous", "ambiguous_challenge")
    fine = F.col("rejection").isNull()
    return (
        later.join(prior, ["repository", "number"]).withColumn("rejection", rejection)
        .select(
            "repository", F.col("number").alias("prior_issue"), "later_issue", "later_state",
            F.when(F.col("closure") == "selected", F.col("_cid")).alias("closure_comment_id"), "challenge", "rejection",
            F.when(fine, "unknown").alias("clearance"), F.when(fine, "inspect_prior_failure").otherwise("rejected").alias("disposition"),
        )
    )
