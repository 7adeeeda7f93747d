"""Registry.

An *adapter* is one SELECT that reads given tables (or other adapters) by ``{name}``.  It is
portable SQL, so that Spark runs it to build the operator's input and the oracle repeats it as a
common table expression; the operator itself is expressed twice, independently.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..plans.durable import kept_for, releasing

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

ADAPTERS: dict[str, str] = {}
QUERIES: dict[str, "Query"] = {}
_SCHEMAS: dict[str, StructType] = {}
_REFERENCE = re.compile(r"\{([a-z]\w*)\}")


@dataclass
class Query:
    name: str
    build: Callable[["Tables"], DataFrame]
    sql: str | None


def adapter(name: str, sql: str) -> None:
    if name in ADAPTERS:
        raise ValueError(f"adapter {name} registered twice")
    ADAPTERS[name] = sql.strip()


def query(name: str, sql: str | None = None):
    def register(build):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, build, sql)
        return build

    return register


class Tables:
    """Given tables and adapters of one data folder, built at most once per query."""

    def __init__(self, spark: SparkSession, folder: str, streamed: tuple[str, ...] = (), landed: dict[str, tuple[str, int]] | None = None):
        self.spark = spark
        self.landed = landed or {}
        self.folder = str(folder).rstrip("/")  # any store that Spark reads, so no local path
        self.streamed = streamed
        self._built: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._built:
            if name in ADAPTERS:
                self._built[name] = self._select(ADAPTERS[name])
            elif name in self.landed:
                reader = self.spark.readStream.schema(self._schema(name)).option("maxFilesPerTrigger", self.landed[name][1])
                self._built[name] = reader.parquet(self.landed[name][0])
            elif name in self.streamed:
                reader = self.spark.readStream.schema(self._schema(name)).option("pathGlobFilter", f"{name}.parquet*")
                self._built[name] = reader.parquet(self.folder)
            else:
                self._built[name] = self.spark.read.schema(self._schema(name)).parquet(f"{self.folder}/{name}.parquet")
        return self._built[name]

    def keep(self, name: str, by: "Tables | None" = None) -> None:
        """Write an adapter's rows once, for all that reads it from now on, here and in the tables ``by``, which build it."""
        by = by or self
        by._built[name], self._built[name] = kept_for(by(name), name, by.spark, self.spark)

    def releasing(self) -> "Tables":
        """The same tables in a session that keeps no shuffle files of what it has written."""
        return Tables(releasing(self.spark), self.folder)

    def _schema(self, name: str):
        """A table's footer is read once per process, not once per query."""
        path = f"{self.folder}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return _SCHEMAS[path]

    def streaming(self, *names: str) -> "Tables":
        """The same tables with some of them read as streams."""
        return Tables(self.spark, self.folder, names)

    def arriving(self, spark: SparkSession, **landed: tuple[str, int]) -> "Tables":
        """The same tables in another session, with some of them read as streams from (folder, files per trigger)."""
        return Tables(spark, self.folder, landed=landed)

    def _select(self, sql: str) -> DataFrame:
        views = {n: f"sw_{uuid.uuid4().hex}_{n}" for n in set(_REFERENCE.findall(sql))}
        for name, view in views.items():
            self(name).createOrReplaceTempView(view)
        df = self.spark.sql(_REFERENCE.sub(lambda m: views[m.group(1)], sql))
        for view in views.values():  # the plan is analysed; the names are no longer needed
            self.spark.catalog.dropTempView(view)
        return df


def _needed(sql: str, seen: list[str]) -> list[str]:
    for name in _REFERENCE.findall(sql):
        if name in ADAPTERS and name not in seen:
            _needed(ADAPTERS[name], seen)
            seen.append(name)
    return seen


def duck_sql(sql: str) -> str:
    """Expand ``{name}`` references and prepend the adapters they need."""
    names = _needed(sql, [])
    plain = lambda text: _REFERENCE.sub(lambda m: m.group(1), text)
    ctes = [f"{n} AS MATERIALIZED ({plain(ADAPTERS[n])})" for n in names]  # else each mention runs anew
    body = plain(sql.strip())
    if not ctes:
        return body
    head = "WITH RECURSIVE " if body.upper().startswith("WITH RECURSIVE ") else "WITH "
    if body.upper().startswith(head):
        return head + ",\n".join(ctes) + ",\n" + body[len(head):]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _load() -> None:
    from . import (  # noqa: F401
        adapters, behaviour, changes, conventions, evidence, history, memory, packets, planning, promotion, reports,
        reviews, shared, streams, text, work,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def runner(q: Query):
        return lambda spark, folder: q.build(Tables(spark, folder))

    return {name: runner(q) for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: duck_sql(q.sql) for name, q in QUERIES.items() if q.sql}
