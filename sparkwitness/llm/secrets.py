"""Secret scans with an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text.  The ledger remembers which
(blob, rule, rule version) were scanned; a run scans the rest only, appends what it found, and joins
findings back to all paths that hold the blob.  Built-in expressions throughout.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwitness.plans.durable import fresh_folder


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1
    base: bool = True


# The kinds of the base contract, in its order, then our own.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # maximal runs, so the same as runs of 1+ that have 16+
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, base=False),
)

SPAN = "struct<start:int,rank:int,kind:string,end:int>"
SEEN = "blob string, rule string, version int"
FINDINGS = "blob string, rule string, version int, spans array<struct<start:int,rank:int,kind:string,end:int>>"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Spans (start, rank, kind, end) in code points, end exclusive.

    The pieces between matches and the matches alternate, so running lengths give the positions.
    """
    pattern = F.lit(rule.pattern)
    pieces = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    group = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    steps = F.arrays_zip(F.slice(pieces, 1, F.size(whole)).alias("piece"), whole.alias("match"), group.alias("part"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))

    def step(acc, s):
        start = acc["at"] + F.char_length(s["piece"])
        end = start + F.char_length(s["match"])
        span = F.array(F.struct(
            start.cast("int").alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"),
            end.cast("int").alias("end"),
        ))
        kept = F.when(F.char_length(s["part"]) >= rule.least, F.concat(acc["found"], span)).otherwise(acc["found"])
        return F.struct(end.cast("int").alias("at"), kept.alias("found"))

    none = F.array().cast(f"array<{SPAN}>")
    return F.when(text.rlike(rule.pattern), F.aggregate(steps, empty, step, lambda a: a["found"])).otherwise(none)


class Ledger:
    """Two append-only tables in a shared folder: what was scanned, and what was found."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or fresh_folder(spark, "blob-ledger")
        # A folder that is not there yet, or holds no scan that was finished, is an empty ledger.
        self.empty = folder is None or not self._written("seen")

    def _written(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _read(self, name: str, schema: str) -> DataFrame:
        if not self._written(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def seen(self) -> DataFrame:
        return self._read("seen", SEEN)

    def findings(self) -> DataFrame:
        return self._read("findings", FINDINGS)

    def scan(self, versions: DataFrame, path: str = "path", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan what is new among ``versions`` (one row per path and version) and record it.

        Returns (path, blob, rule, version, spans), a row per path version and rule that found something.
        A null text is the empty blob; repeated rows and rows of one blob are scanned once; a null path
        keeps its findings.  Other columns are ignored.  An empty table scans nothing.
        """
        rows = versions.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        paths = rows.select("path", blob_of(F.col("text")).alias("blob"))
        wanted = F.explode(F.array(*[
            F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules
        ])).alias("pair")
        # One holder per blob; only ids and digests are shuffled for this.
        holders = paths.groupBy("blob").agg(F.min("path").alias("path"), F.lit(True).alias("held"))
        todo = holders
        if not self.empty:
            fresh = (
                holders.select("blob", wanted).select("blob", "pair.*")
                .join(self.seen(), ["blob", "rule", "version"], "left_anti")
            )
            due = fresh.groupBy("blob").agg(F.collect_set("rule").alias("due"))  # a few rules at most
            todo = holders.join(due, "blob")
        else:
            todo = holders.withColumn("due", F.array(*[F.lit(r.kind) for r in rules]))
        # Every path is its own key here, so a blob that many paths hold is no hot key.
        at = rows.withColumn("blob", blob_of(F.col("text")))
        chosen = todo.select(F.col("path").alias("_path"), F.col("blob").alias("_blob"), "due")
        fresh_rows = at.join(chosen, at["path"].eqNullSafe(chosen["_path"]) & (at["blob"] == chosen["_blob"]))
        none = F.array().cast(f"array<{SPAN}>")
        scanned = fresh_rows.select("blob", F.array(*[
            F.struct(
                F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"),
                F.when(F.array_contains("due", r.kind), spans_of(F.col("text"), r, i)).otherwise(none).alias("spans"),
            ) for i, r in enumerate(rules)
        ]).alias("found"))
        found = (
            scanned.select("blob", F.explode(F.filter("found", lambda s: F.size(s["spans"]) > 0)).alias("f"))
            .select("blob", "f.*").dropDuplicates(["blob", "rule", "version"])
        )
        # Findings first: a run lost in between is scanned again, and repeated findings are read once.
        seen = todo.select("blob", F.explode("due").alias("rule")).join(
            F.broadcast(self.spark.createDataFrame([(r.kind, r.version) for r in rules], "rule string, version int")), "rule"
        ).select("blob", "rule", "version")
        found.write.mode("append").parquet(f"{self.folder}/findings")
        seen.write.mode("append").parquet(f"{self.folder}/seen")
        self.empty = False
        return paths.join(self.current(rules), "blob").select("path", "blob", "rule", "version", "spans")

    def current(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Findings of these rules at their present versions, each once; older versions stay in the ledger and are not read."""
        present = reduce(or_, [(F.col("rule") == r.kind) & (F.col("version") == r.version) for r in rules], F.lit(False))
        return self.findings().where(present).dropDuplicates(["blob", "rule", "version"])


def digest(
    versions: DataFrame, path: str = "doc_id", text: str = "text", folder: str | None = None, rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """One row per given row: counts per base kind, digest of the base spans, all spans as text.

    With a ``folder`` the ledger there is continued, or begun; only the rules' present versions count.  Null or empty text: no spans.  Rows that repeat are all returned.
    """
    ledger = Ledger(versions.sparkSession, folder)
    ledger.scan(versions, path, text, rules)
    per_blob = (
        ledger.current(rules)
        .groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))  # one blob's own spans
    )
    base = F.array(*[F.lit(r.kind) for r in rules if r.base])
    written = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    ), ",")
    spans = F.coalesce(F.col("spans"), F.array().cast(f"array<{SPAN}>"))
    of_kind = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    rows = versions.select(F.col(path).alias("doc_id"), blob_of(F.col(text)).alias("blob"))
    return rows.join(per_blob, "blob", "left").select(
        "doc_id",
        *[of_kind(r.kind).alias(f"n_{r.kind}") for r in rules if r.base],
        F.sha2(written(F.filter(spans, lambda s: F.array_contains(base, s["kind"]))), 256).alias("base_sha256"),
        written(spans).alias("spans"),
    )


ORACLE = r"""
WITH given AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
kinds(rank, kind, pattern, part, least) AS (VALUES
  (0, 'assign', '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 18), (2, 'hex', '[0-9a-f]+', 0, 16),
  (3, 'pem', '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0, 1)),
cut AS (
  SELECT doc_id, 0 AS rank, 'assign' AS kind, 12 AS least,
    regexp_split_to_array(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS pieces,
    regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS whole,
    regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS part
  FROM given
  UNION ALL SELECT doc_id, 1, 'access', 18, regexp_split_to_array(t, 'AKIA[A-Z0-9]+'),
    regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM given
  UNION ALL SELECT doc_id, 2, 'hex', 16, regexp_split_to_array(t, '[0-9a-f]+'),
    regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+') FROM given
  UNION ALL SELECT doc_id, 3, 'pem', 1, regexp_split_to_array(t, '-----BEGIN [A-Z ]*PRIVATE KEY-----'),
    regexp_extract_all(t, '-----BEGIN [A-Z ]*PRIVATE KEY-----'), regexp_extract_all(t, '-----BEGIN [A-Z ]*PRIVATE KEY-----') FROM given),
steps AS (
  SELECT doc_id, rank, kind, least, unnest(range(1, len(whole) + 1)) AS i, pieces, whole, part FROM cut),
placed AS (
  SELECT doc_id, rank, kind, least, i, length(part[i]) AS n, length(whole[i]) AS w,
    sum(length(pieces[i]) + length(whole[i])) OVER (PARTITION BY doc_id, rank ORDER BY i) AS stop
  FROM steps),
spans AS (SELECT doc_id, rank, kind, (stop - w)::BIGINT AS start, stop::BIGINT AS stop FROM placed WHERE n >= least),
rolled AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN rolled USING (doc_id)
"""
