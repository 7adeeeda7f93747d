"""Explicit relations between issues and pull requests, and what their texts say.

``artifacts(repository, kind, number, evidence_text, evidence_complete, merged)``,
``artifact_paths(repository, kind, number, path)``.  A text is one row: its lines are handled with
array functions inside the row, whole, and need no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import present
from ..functions.references import mentions, refs, relation_of

ISSUE_URL = r"(?i)^https://(?:redirect\.)?github\.com/([^/]+/[^/]+)/issues/([1-9][0-9]*)(?:[/?#].*)?$"
PRIMARY_CASE = "primary case:"
TRIM = r"^\s+|\s+$"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, TRIM, "")


def lines(text: Column) -> Column:
    return F.split(text, "\r?\n", -1)


def artifact_edges(artifacts: DataFrame) -> DataFrame:
    """Distinct (relation, number, line) references of each artifact, target kind resolved.

    A target that is not among the artifacts keeps its row with a null kind.
    """
    found = (
        artifacts.select(
            "repository", F.col("kind").alias("from_kind"), F.col("number").alias("from_number"),
            F.explode(F.array_distinct(lines(F.col("evidence_text")))).alias("_line"),
        )
        .withColumn("line", _strip(F.col("_line")))
        .where(F.col("line").contains("#"))
        .withColumn("relation", present(relation_of(F.col("line"))))
        .withColumn("to_number", F.explode(refs(F.col("line"))))
        .select("repository", "from_kind", "from_number", "relation", "to_number", "line")
        .distinct()
    )
    kinds = artifacts.select("repository", F.col("number").alias("to_number"), F.col("kind").alias("to_kind"))
    return found.join(kinds, ["repository", "to_number"], "left").select(
        "repository", "from_kind", "from_number", "relation", "to_kind", "to_number", "line"
    )


def primary_case_edges(artifacts: DataFrame) -> DataFrame:
    """Targets of `Primary case:` blocks with their admission state.

    State is ``edge``, or why the block is not admitted.  Of equal targets one row stays.
    """
    filled = F.filter(F.transform(lines(F.col("evidence_text")), _strip), lambda s: s != "")
    following = F.slice(filled, F.lit(2), F.size(filled))
    pairs = F.zip_with(filled, following, lambda a, b: F.struct(a.alias("head"), b.alias("target")))
    blocks = F.filter(pairs, lambda p: F.lower(p["head"]) == PRIMARY_CASE)
    number = F.regexp_extract("target", ISSUE_URL, 2)
    named = F.lower(F.regexp_extract("target", ISSUE_URL, 1))
    state = (
        F.when(F.col("target").isNull(), "no_target")
        .when(~F.col("target").rlike(ISSUE_URL), "not_an_issue_url")
        .when(named != F.lower("repository"), "escapes_repository")
        .when(number == F.col("from_number").cast("string"), "self_reference")
        .otherwise("edge")
    )
    return (
        artifacts.where(F.col("evidence_text").rlike("(?i)primary case:"))
        .select(
            "repository", F.col("kind").alias("from_kind"), F.col("number").alias("from_number"),
            F.explode(blocks).alias("b"),
        )
        .select("repository", "from_kind", "from_number", F.col("b.target").alias("target"))
        .select(
            "repository", "from_kind", "from_number", state.alias("state"),
            F.when(F.col("target").rlike(ISSUE_URL), number.cast("long")).alias("to_number"),
        )
        .distinct()
    )


def edge_semantics(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """First reason why an edge is not admitted.

    ``edges(repository, from_kind, from_number, relation, to_kind, to_number, evidence)``.
    """
    source = artifacts.select(
        "repository", F.col("kind").alias("from_kind"), F.col("number").alias("from_number"),
        F.col("evidence_text").alias("_text"),
    )
    target = artifacts.select(
        "repository", F.col("kind").alias("to_kind"), F.col("number").alias("to_number"), F.lit(True).alias("_target")
    )
    evidence = F.col("evidence")
    filled = F.filter(F.transform(lines(evidence), _strip), lambda s: s != "")
    url = F.get(filled, F.lit(1))
    is_case = (
        (F.size(filled) == 2)
        & (F.lower(F.get(filled, F.lit(0))) == PRIMARY_CASE)
        & url.rlike(ISSUE_URL)
        & (F.lower(F.regexp_extract(url, ISSUE_URL, 1)) == F.lower("repository"))
    )
    multiline = evidence.rlike("[\n\r]")
    found = relation_of(evidence)
    reason = (
        F.when((F.col("from_kind") == F.col("to_kind")) & (F.col("from_number") == F.col("to_number")), "self_reference")
        .when(F.col("_text").isNull(), "source_absent")
        .when(F.col("_target").isNull(), "target_absent")
        .when(~F.col("_text").contains(evidence), "evidence_not_in_source")
        .when(multiline & ~F.coalesce(is_case, F.lit(False)), "not_a_primary_case_block")
        .when(multiline & (F.col("relation") != "related"), "primary_case_relation")
        .when(
            multiline & (F.regexp_extract(url, ISSUE_URL, 2) != F.col("to_number").cast("string")),
            "primary_case_target",
        )
        .when(multiline, None)
        .when(found.isNull(), "not_a_relation_line")
        .when(found != F.col("relation"), "relation_disagrees")
        .when(~mentions(evidence, F.col("to_number")), "target_not_mentioned")
    )
    return (
        edges.join(source, ["repository", "from_kind", "from_number"], "left")
        .join(target, ["repository", "to_kind", "to_number"], "left")
        .select("repository", "from_kind", "from_number", "relation", "to_kind", "to_number", "evidence", reason.alias("reason"))
        .where("reason IS NOT NULL")
    )


def memory_summary(artifacts: DataFrame, artifact_paths: DataFrame, edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Sizes of each repository's memory and of its ``anchors(repository, kind, number)``."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    n = F.count(F.lit(1))
    key = ["repository", "kind", "number"]
    outgoing = edges.select(
        "repository", F.col("from_kind").alias("kind"), F.col("from_number").alias("number")
    )
    return (
        anchors.join(artifacts.groupBy("repository").agg(n.alias("artifacts")), "repository", "left")
        .join(edges.groupBy("repository").agg(n.alias("edges")), "repository", "left")
        .join(artifact_paths.groupBy(*key).agg(n.alias("changed_paths")), key, "left")
        .join(outgoing.groupBy(*key).agg(n.alias("outgoing_links")), key, "left")
        .select(*key, zero("artifacts"), zero("edges"), zero("changed_paths"), zero("outgoing_links"))
    )


def lineage(edges: DataFrame, anchors: DataFrame, max_depth: int) -> DataFrame:
    """Artifacts within ``max_depth`` explicit links of each anchor, with the smallest depth.

    ``edges(repository, from_number, to_number)``.  A level expands only the artifacts first reached by the level before: the
    join takes rows of that depth, each reached row passes through beside its targets, and the smallest depth is kept
    in one aggregation, so what is reached is never computed twice.  The links of all levels are one exchange, which is
    reused; those of a hub stand on the side of the join that AQE may split.
    """
    links = edges.select("repository", F.col("from_number").alias("number"), "to_number").distinct()
    key = ["repository", "anchor", "number"]
    reached = anchors.select("repository", F.col("number").alias("anchor"), "number").distinct().withColumn("depth", F.lit(0).cast("long"))
    for depth in range(1, max_depth + 1):
        frontier = F.when(F.col("depth") == depth - 1, F.col("number"))
        met = reached.withColumn("_from", frontier).join(
            links.select(F.col("repository").alias("_repository"), F.col("number").alias("_number"), "to_number"),
            (F.col("repository") == F.col("_repository")) & (F.col("_from") == F.col("_number")), "left",
        )
        own = F.struct(F.col("number").alias("number"), F.col("depth").alias("depth"))
        target = F.struct(F.col("to_number").alias("number"), F.lit(depth).cast("long").alias("depth"))
        both = F.when(F.col("to_number").isNull(), F.array(own)).otherwise(F.array(own, target))
        reached = met.select("repository", "anchor", F.inline(both)).groupBy(*key).agg(F.min("depth").alias("depth"))
    return reached


def lineage_receipts(reached: DataFrame, artifacts: DataFrame, max_depth: int) -> DataFrame:
    """What a lineage did not look at: the depth frontier and incomplete texts."""
    facts = artifacts.select("repository", "number", "evidence_complete")
    receipt = F.when(F.col("depth") == max_depth, "depth_frontier").when(
        ~F.coalesce("evidence_complete", F.lit(False)), "incomplete_evidence"
    )
    return (
        reached.join(facts, ["repository", "number"], "left")
        .select("repository", "anchor", "number", receipt.alias("receipt"))
        .where("receipt IS NOT NULL")
    )


def lineage_completeness(reached: DataFrame, receipts: DataFrame) -> DataFrame:
    gaps = (
        receipts.where(F.col("receipt") == "incomplete_evidence")
        .select("repository", "anchor").distinct().withColumn("_gap", F.lit(True))
    )
    sizes = reached.groupBy("repository", "anchor").agg(F.count(F.lit(1)).alias("artifacts"))
    return sizes.join(gaps, ["repository", "anchor"], "left").select(
        "repository", "anchor", "artifacts", F.col("_gap").isNull().alias("complete_within_requested_depth")
    )


def evidence_for_path(texts: DataFrame, paths: DataFrame) -> DataFrame:
    """First line of ``texts(doc, text)`` naming each ``paths(doc, path)``, with the last
    non-blank line before it; null when the text does not name the path."""
    indexed = F.transform(lines(F.col("text")), lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    hit = F.get(F.filter(indexed, lambda x: x["s"].contains(F.col("path"))), F.lit(0))
    before = F.filter(indexed, lambda x: (x["i"] < F.col("_hit.i")) & (_strip(x["s"]) != ""))
    start = F.coalesce(F.try_element_at(before, F.lit(-1))["i"], F.col("_hit.i"))
    whole = lines(F.col("text"))
    return (
        paths.join(texts, "doc", "left")
        .withColumn("_hit", hit)
        .withColumn("_start", start)
        .select(
            "doc", "path",
            (F.col("_hit.i") + 1).cast("long").alias("line"),
            F.when(
                F.col("_hit").isNotNull(),
                F.array_join(F.slice(whole, F.col("_start") + 1, F.col("_hit.i") - F.col("_start") + 1), "\n"),
            ).alias("evidence"),
        )
    )


def document_summary(documents: DataFrame) -> DataFrame:
    """``documents(repository, revision, path, blob_sha, text, text_complete, source)``."""
    return documents.select(
        "repository", "revision", "path", "blob_sha",
        F.octet_length("text").cast("long").alias("text_bytes"), "text_complete", "source",
    )


def document_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("repository", "revision").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.octet_length("text").cast("long")).alias("text_bytes"),
        F.count_if(~F.col("text_complete")).alias("incomplete"),
    )
