"""Shared column functions, each over whole tables."""

from pyspark.sql import functions as F

from ..functions import identity as ident
from ..functions import paths as pth
from ..functions import references as rf
from .changes import CANONICAL
from .core import adapter, query
from .memory import LINES, RELATION


@query("shared_1_canonical_path", f"SELECT owner, path, {CANONICAL} AS canonical FROM {{owner_paths}}")
def _(t):
    return t("owner_paths").select("owner", "path", pth.is_canonical_path(F.col("path")).alias("canonical"))


adapter("scope_pairs", """
SELECT l_orderkey AS pair, path,
       CASE l_linenumber % 5 WHEN 0 THEN split_part(path, '/', 1) WHEN 1 THEN path WHEN 2 THEN concat(path, '/deep') WHEN 3 THEN substring(path, 1, 3) ELSE replace(path, '.rs', '') END AS scope,
       CASE WHEN l_suppkey % 2 = 0 THEN 'exact' ELSE 'prefix' END AS mode
FROM {lineitem} JOIN {part_path} ON l_partkey = p_partkey
""")


@query("shared_2_scope_match", """
SELECT pair, path, scope, mode, path = scope OR (mode = 'prefix' AND starts_with(path, concat(scope, '/'))) AS in_scope,
       path = scope OR starts_with(path, concat(scope, '/')) OR starts_with(scope, concat(path, '/')) AS overlap
FROM {scope_pairs}
""")
def _(t):
    path, scope = F.col("path"), F.col("scope")
    return t("scope_pairs").select(
        "pair", "path", "scope", "mode", pth.scope_matches(F.col("mode"), scope, path).alias("in_scope"),
        pth.paths_overlap(path, scope).alias("overlap"),
    )


adapter("identifiers", """
SELECT event_id, CASE k % 6 WHEN 0 THEN concat(md5(CAST(k AS STRING)), '01234567') WHEN 1 THEN concat('sha256:', md5(CAST(k AS STRING)), md5('y'))
         WHEN 2 THEN concat('owner.a/name-', CAST(k AS STRING)) WHEN 3 THEN concat(' pad', CAST(k AS STRING)) WHEN 4 THEN concat(upper(md5(CAST(k AS STRING))), '01234567') ELSE 'a/b/c' END AS value
FROM {event_keys}
""")


@query("shared_3_identity_checks", """
SELECT event_id, value, value <> '' AND trim(value) = value AS atom, regexp_full_match(value, '[0-9a-f]{40}') AS git_sha,
       regexp_full_match(value, 'sha256:[0-9a-f]{64}') AS snapshot_id, regexp_full_match(value, '[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+') AS repository_name
FROM {identifiers}
""")
def _(t):
    value = F.col("value")
    return t("identifiers").select(
        "event_id", "value", ident.is_canonical_atom(value).alias("atom"), ident.is_git_sha(value).alias("git_sha"),
        ident.is_snapshot_id(value).alias("snapshot_id"), ident.is_repository_name(value).alias("repository_name"),
    )


def _lines(t):
    text = F.explode(F.split("evidence_text", "\r?\n", -1))
    return t("artifacts").select("repository", "kind", "number", text.alias("raw"))


@query("shared_4_relation_of", f"""
SELECT repository, kind, number, raw, {RELATION} AS relation FROM (SELECT *, trim(raw) AS line FROM ({LINES}) l) x
""")
def _(t):
    return _lines(t).withColumn("relation", rf.relation_of(F.col("raw")))


@query("shared_5_references", f"""
SELECT repository, kind, number, raw, CAST(unnest(regexp_extract_all(raw, '(?:^|[^A-Za-z0-9_.-])#([1-9][0-9]*)\\b', 1)) AS BIGINT) AS reference FROM ({LINES}) l
""")
def _(t):
    return _lines(t).select("repository", "kind", "number", "raw", F.explode(rf.refs(F.col("raw"))).alias("reference"))
