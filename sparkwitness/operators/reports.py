"""Findings with provenance: kind, claims, evidence, location, question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import bag_digest, digest

# What a claim may say about its own standing.
CLAIM_KINDS = ["proven", "derived", "observed", "inferred", "unknown"]
REPORT_VERSION = "report/1"


def location(path: Column, line: Column | None = None) -> Column:
    return F.struct(path.alias("path"), (F.lit(None) if line is None else line).cast("long").alias("line"))


NOWHERE = "struct<path:string,line:bigint>"


def evidence(message: Column, at: Column | None = None) -> Column:
    return F.struct(message.alias("message"), (F.lit(None) if at is None else at).cast(NOWHERE).alias("location"))


def claim(kind: str, message: Column, *supporting: Column) -> Column:
    if kind not in CLAIM_KINDS:
        raise ValueError(f"claim kind must be one of {CLAIM_KINDS}")
    items = F.array(*supporting) if supporting else F.array()
    return F.struct(
        F.lit(kind).alias("kind"), message.alias("message"),
        items.cast(f"array<struct<message:string,location:{NOWHERE}>>").alias("evidence"),
    )


def findings(
    df: DataFrame, keys: list[str], kind: Column, title: Column, at: Column, claims: list[Column], question: Column | None = None
) -> DataFrame:
    """One nested finding per operator row; ``keys`` say which report it belongs to."""
    return df.select(
        *keys, kind.alias("kind"), title.alias("title"), at.cast(NOWHERE).alias("location"),
        F.array(*claims).alias("claims"), (F.lit(None) if question is None else question).cast("string").alias("question"),
    )


def flatten(nested: DataFrame, keys: list[str]) -> DataFrame:
    """One row per evidence; claims without evidence keep a row."""
    return (
        nested.select(*keys, "kind", "title", "location", "question", F.posexplode_outer("claims").alias("claim_index", "c"))
        .select("*", F.posexplode_outer("c.evidence").alias("evidence_index", "e"))
        .select(
            *keys, "kind", "title", F.col("location.path").alias("path"), F.col("location.line").alias("line"), "question",
            "claim_index", F.col("c.kind").alias("claim_kind"), F.col("c.message").alias("claim"),
            "evidence_index", F.col("e.message").alias("evidence"),
            F.col("e.location.path").alias("evidence_path"), F.col("e.location.line").alias("evidence_line"),
        )
    )


def report_fingerprint(nested: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Identity per report, sensitive to order and content, not to how JSON is laid out.

    ``position`` is what a report orders its findings by, any text or number that tells them apart.  It is part of each
    member, so members combine in any order and nothing has to be numbered.
    """
    place = lambda at: digest(at["path"], at["line"])
    member = lambda e: digest(e["message"], place(e["location"]))
    claim_ = lambda c: digest(c["kind"], c["message"], F.array_join(F.transform(c["evidence"], member), ","))
    body = digest(
        F.col(position), F.col("kind"), F.col("title"), place(F.col("location")),
        F.array_join(F.transform("claims", claim_), ","), F.col("question"),
    )
    found = bag_digest(nested, keys, body, REPORT_VERSION, "_digest")
    return found.select(*keys, F.concat(F.lit(REPORT_VERSION + ":"), "_digest").alias("fingerprint"), F.col("members").alias("findings"))


def claim_kind_counts(nested: DataFrame, keys: list[str]) -> DataFrame:
    return (
        nested.select(*keys, "kind", F.explode("claims").alias("c"))
        .groupBy(*keys, "kind", F.col("c.kind").alias("claim_kind"))
        .agg(F.count(F.lit(1)).alias("claims"))
    )
