"""Findings, their flat form, fingerprints and counts."""

from pyspark.sql import functions as F

from ..functions.identity import framed
from ..operators import reports as op
from ..operators import work as wk
from ..plans.durable import fresh_folder
from ..sources import packets
from . import sqlparts as sq
from .core import query

KEYS = ["snapshot_id"]


def _findings(rows, *keys):
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    observed = op.claim(
        "observed",
        text("Both ", F.col("current_id"), " and ", F.col("other_id"), " modify ", F.col("path"), "."),
        op.evidence(text("Other work ", F.col("other_id"), " is ", F.col("activity"), "."), op.location(F.col("path"))),
    )
    unknown = op.claim("unknown", text("It is not established that ", F.col("other_id"), " is active."))
    question = F.when(F.col("activity") == "unresolved", "Resolve activity first.").otherwise("Reconcile before continuing?")
    return op.findings(
        rows, [*KEYS, *keys], F.col("finding_kind"), F.lit("Path overlap"), op.location(F.col("path")), [observed, unknown], question
    )


def _overlaps(t):
    return wk.inventory_overlap(t("work_items"), t("work_paths"), t("currents"))


BASE = """
SELECT snapshot_id, finding_kind AS kind, 'Path overlap' AS title, path, question, claim_index, claim_kind, claim, evidence, CASE WHEN evidence IS NOT NULL THEN path END AS evidence_path
FROM (SELECT *, CASE WHEN activity = 'unresolved' THEN 'Resolve activity first.' ELSE 'Reconcile before continuing?' END AS question, 0 AS claim_index, 'observed' AS claim_kind,
             concat('Both ', current_id, ' and ', other_id, ' modify ', path, '.') AS claim, concat('Other work ', other_id, ' is ', activity, '.') AS evidence FROM {overlap_rows}
      UNION ALL
      SELECT *, CASE WHEN activity = 'unresolved' THEN 'Resolve activity first.' ELSE 'Reconcile before continuing?' END, 1, 'unknown',
             concat('It is not established that ', other_id, ' is active.'), NULL FROM {overlap_rows}) x
"""


@query("rep_1_findings", BASE)
def _(t):
    flat = op.flatten(_findings(_overlaps(t)), KEYS)
    return flat.select("snapshot_id", "kind", "title", "path", "question", "claim_index", "claim_kind", "claim", "evidence", "evidence_path")


EMPTY = repr("")


@query("rep_2_report_fingerprint", f"""
WITH o AS (SELECT *, {sq.framed('other_id', 'path')} AS position,
       CASE WHEN activity = 'unresolved' THEN 'Resolve activity first.' ELSE 'Reconcile before continuing?' END AS question,
       concat('Both ', current_id, ' and ', other_id, ' modify ', path, '.') AS claim1, concat('Other work ', other_id, ' is ', activity, '.') AS evidence1,
       concat('It is not established that ', other_id, ' is active.') AS claim2 FROM {{overlap_rows}}),
p AS (SELECT *, {sq.digest('path', 'NULL')} AS place FROM o),
e AS (SELECT *, {sq.digest('evidence1', 'place')} AS e1 FROM p),
c AS (SELECT *, concat({sq.digest(repr('observed'), 'claim1', 'e1')}, ',', {sq.digest(repr('unknown'), 'claim2', EMPTY)}) AS claims FROM e),
m AS (SELECT snapshot_id, {sq.digest('position', 'finding_kind', repr('Path overlap'), 'place', 'claims', 'question')} AS d FROM c)
SELECT snapshot_id, concat('{op.REPORT_VERSION}:', digest) AS fingerprint, members AS findings FROM ({sq.bag('m', 'snapshot_id', 'd', op.REPORT_VERSION)}) r
""")
def _(t):
    # A report orders the overlaps of its current item by other work and path.
    placed = _overlaps(t).withColumn("position", framed(F.col("other_id"), F.col("path")))
    return op.report_fingerprint(_findings(placed, "position"), KEYS, "position")


@query("rep_3_claim_kind_counts", f"SELECT snapshot_id, kind, claim_kind, count(*) AS claims FROM ({BASE}) b GROUP BY snapshot_id, kind, claim_kind")
def _(t):
    return op.claim_kind_counts(_findings(_overlaps(t)), KEYS)


@query("src_6_report_sink", BASE)
def _(t):
    # Written as nested JSON into the shared folder, and read back with the declared schema.
    nested = _findings(_overlaps(t))
    folder = fresh_folder(t.spark, "report")
    packets.write_report(nested, folder, partition_by="snapshot_id")
    flat = op.flatten(packets.read_packets(t.spark, folder, nested.schema, multiline=False), KEYS)
    return flat.select("snapshot_id", "kind", "title", "path", "question", "claim_index", "claim_kind", "claim", "evidence", "evidence_path")
