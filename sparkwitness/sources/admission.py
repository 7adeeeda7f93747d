"""Strict admission of documents, and integrity of identities, edges and path sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from ..functions.binding import let
from ..functions.identity import digest
from ..functions.paths import is_canonical_path


def _problem(json: Column, kind: DataType) -> Column:
    """2 if the text carries, at any level, a key the schema does not name, else 1 if a field
    that may not be null is absent, else 0.  Each level is parsed once, into a map of texts."""
    if isinstance(kind, StructType):

        def level(entries: Column) -> Column:
            keys = F.map_keys(entries)
            names = F.array(*[F.lit(f.name) for f in kind.fields])
            required = F.array(*[F.lit(f.name) for f in kind.fields if not f.nullable]).cast("array<string>")
            own = (
                F.when(F.size(F.array_except(keys, names)) > 0, 2)
                .when(F.size(F.array_except(required, keys)) > 0, 1)
                .otherwise(0)
            )
            below = [_problem(F.try_element_at(entries, F.lit(f.name)), f.dataType) for f in kind.fields if _nested(f.dataType)]
            return F.greatest(own, *below) if below else own

        return F.coalesce(let(F.from_json(json, "map<string,string>"), level), F.lit(0))
    if isinstance(kind, ArrayType) and _nested(kind.elementType):
        worst = F.array_max(F.transform(F.from_json(json, "array<string>"), lambda x: _problem(x, kind.elementType)))
        return F.coalesce(worst, F.lit(0))
    return F.lit(0)


def _nested(kind: DataType) -> bool:
    return isinstance(kind, (StructType, ArrayType))


def admit(documents: DataFrame, column: str, schema: StructType, version: int) -> DataFrame:
    """Documents with ``packet`` parsed, or the ``reason`` for which they are rejected."""
    json = F.col(column)
    reason = let(
        F.get_json_object(json, "$.schema_version"),
        lambda stated: F.when(F.json_object_keys(json).isNull(), "malformed")
        .when(~stated.eqNullSafe(F.lit(str(version))), "unsupported_schema_version")
        .otherwise(F.element_at(F.array(F.lit(None).cast("string"), F.lit("missing_field"), F.lit("unknown_field")), _problem(json, schema) + 1)),
    )
    return documents.withColumn("reason", reason).withColumn(
        "packet", F.when(F.col("reason").isNull(), F.from_json(json, schema))
    )


def duplicate_ids(df: DataFrame, key: list[str]) -> DataFrame:
    """Identities that occur more than once: ``duplicate`` if all rows agree, else ``conflicting``."""
    rest = sorted(c for c in df.columns if c not in key)
    row = digest(*[F.to_json(F.struct(F.col(c))) for c in rest]) if rest else F.lit("")
    return (
        df.select(*key, row.alias("_row"))
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("rows"), (F.min("_row") == F.max("_row")).alias("_same"))
        .where(F.col("rows") > 1)
        .select(*key, "rows", F.when(F.col("_same"), "duplicate").otherwise("conflicting").alias("kind"))
    )


def edge_violations(nodes: DataFrame, edges: DataFrame, scope: str) -> DataFrame:
    """Self edges, edges with a missing endpoint, and repeated edges.

    ``nodes(<scope>, id)``, ``edges(<scope>, kind, from_id, to_id, source)``.
    """
    cols = [scope, "kind", "from_id", "to_id", "source"]
    rows = edges.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    known = lambda role: nodes.select(scope, F.col("id").alias(role)).distinct().withColumn(f"_{role}", F.lit(True))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("from_id") == F.col("to_id"), "self_edge"),
            F.when(F.col("_from_id").isNull(), "missing_source"),
            F.when(F.col("_to_id").isNull(), "missing_target"),
            F.when(F.col("_n") > 1, "duplicate_edge"),
        )
    )
    return (
        rows.join(known("from_id"), [scope, "from_id"], "left")
        .join(known("to_id"), [scope, "to_id"], "left")
        .select(*cols, F.explode(reasons).alias("reason"))
    )


def path_violations(owner_paths: DataFrame, owner: list[str], path: str = "path") -> DataFrame:
    """Paths that are not canonical or occur twice in one owner's set."""
    rows = owner_paths.groupBy(*owner, path).agg(F.count(F.lit(1)).alias("_n"))
    reasons = F.array_compact(
        F.array(
            F.when(~is_canonical_path(F.col(path)), "not_canonical"),
            F.when(F.col("_n") > 1, "duplicate_path"),
        )
    )
    return rows.select(*owner, path, F.explode(reasons).alias("reason"))
