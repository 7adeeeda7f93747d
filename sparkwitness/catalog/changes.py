"""Sources, admission, generated companions, workflow filters, fact reuse."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ci
from ..operators import facts as fx
from ..operators import generated as gen
from ..operators import history as hist
from ..plans.durable import fresh_folder, kept
from ..sources import admission as adm
from ..sources import commit_log, diffs, packets
from .core import adapter, query

# Log records as an export writes them; the oracle states the values they were built from.
adapter("log_records", """
SELECT concat('r', CAST(o_custkey % 7 AS STRING)) AS repository, o_orderkey AS log_pos,
       concat(chr(10), 'sha', CAST(o_orderkey AS STRING), chr(31), CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('par', CAST(o_orderkey - 1 AS STRING), ' other') END,
              CASE WHEN o_orderkey % 50 = 7 THEN '' ELSE concat(chr(31), ' Subject ', chr(31), o_orderpriority, ' ') END, chr(13), chr(10), chr(10),
              ' src/', CAST(o_orderkey % 9 AS STRING), '.rs', chr(10), 'docs/a b.md', chr(10), 'docs/a b.md', chr(10)) AS record
FROM {orders}
""")
KEPT = "WHERE o_orderkey % 50 <> 7"


@query("src_1_commits", f"""
SELECT concat('r', CAST(o_custkey % 7 AS VARCHAR)) AS repository, o_orderkey AS log_pos, concat('sha', o_orderkey) AS sha,
       CASE WHEN o_orderkey % 5 <> 0 THEN concat('par', o_orderkey - 1) END AS parent_sha, concat('Subject ', chr(31), o_orderpriority) AS subject, false AS is_merge
FROM {{orders}} {KEPT}
""")
def _(t):
    return commit_log.parse_commits(t("log_records"), with_parents=True)


@query("src_1_commit_paths", f"""
SELECT concat('r', CAST(o_custkey % 7 AS VARCHAR)) AS repository, concat('sha', o_orderkey) AS sha, unnest([concat('src/', o_orderkey % 9, '.rs'), 'docs/a b.md']) AS path
FROM {{orders}} {KEPT}
""")
def _(t):
    return commit_log.parse_commit_paths(t("log_records"))


@query("src_1_malformed_records", """
SELECT concat('r', CAST(o_custkey % 7 AS VARCHAR)) AS repository, o_orderkey AS log_pos FROM {orders} WHERE o_orderkey % 50 = 7
""")
def _(t):
    return commit_log.malformed_records(t("log_records"))


def _written(t, rows, name: str, *folders: str) -> str:
    """``rows`` (value, other columns) as text files in the shared folder; a file per value of ``folders``."""
    folder = fresh_folder(t.spark, name)
    writer = rows.write.partitionBy(*folders) if folders else rows.write
    writer.text(folder)
    return folder


@query("src_1_log_files", f"""
SELECT concat('r', CAST(o_custkey % 7 AS VARCHAR)) AS repository, log_pos, concat('sha', o_orderkey) AS sha, CASE WHEN o_orderkey % 5 <> 0 THEN concat('par', o_orderkey - 1) END AS parent_sha
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY o_orderkey) - 1 AS log_pos FROM {{orders}}) o {KEPT}
""")
def _(t):
    # A file per repository, newest first, read back in splits.
    records = t("log_records").repartition("repository").sortWithinPartitions("repository", "log_pos")
    folder = _written(t, records.select(F.concat(F.lit(commit_log.RECORD), "record").alias("value"), "repository"), "log", "repository")
    commits, _ = commit_log.read_commit_log(t.spark, folder, with_parents=True)
    return commits.select(F.regexp_extract("repository", "^repository=([^/]+)/", 1).alias("repository"), "log_pos", "sha", "parent_sha")


adapter("diff_texts", """
SELECT CAST(o_orderkey AS STRING) AS change_id,
       concat('diff --git a b', chr(10), '--- src/a.rs', chr(10), '+++ src/a.rs', chr(10), '@@ -9,0 +10,2 @@ fn x', chr(10), '+x', chr(10), '+@@ not a header', chr(10),
              '@@ -12 +', CAST(12 + o_orderkey % 5 AS STRING), ' @@', chr(10), '-old', chr(10), '+new', chr(13), chr(10), chr(92), ' No newline at end of file', chr(10),
              CASE WHEN o_orderkey % 3 = 0 THEN concat('diff --git c c', chr(10), '--- src/gone.rs', chr(10), '+++ /dev/null', chr(10), '@@ -1 +0,0 @@', chr(10), '-a', chr(10), '+b', chr(10)) ELSE '' END,
              'diff --git d d', chr(10), '--- src/b.rs', chr(10), '+++ src/b.rs', chr(10), '@@ -5,3 +5,4 @@', chr(10), ' ctx', chr(10), '+one', chr(10),
              CASE WHEN o_orderkey % 2 = 0 THEN concat('', chr(10)) ELSE '' END, '+two', chr(10), ' end', chr(10), '@@ -8,0 +8 @@', chr(10), '+three', chr(10), '@@ -90 +q @@', chr(10), '+lost', chr(10)) AS diff
FROM {orders}
""")


@query("src_2_changed_ranges", """
WITH k AS (SELECT CAST(o_orderkey AS VARCHAR) AS change_id, o_orderkey AS o FROM {orders})
SELECT change_id, 'src/a.rs' AS path, CAST(10 AS BIGINT) AS start, CAST(CASE WHEN o % 5 = 0 THEN 12 ELSE 11 END AS BIGINT) AS "end" FROM k
UNION ALL SELECT change_id, 'src/a.rs', 12 + o % 5, 12 + o % 5 FROM k WHERE o % 5 <> 0
UNION ALL SELECT change_id, 'src/b.rs', 6, CASE WHEN o % 2 = 0 THEN 6 ELSE 8 END FROM k
UNION ALL SELECT change_id, 'src/b.rs', 8, 8 FROM k WHERE o % 2 = 0
""")
def _(t):
    return diffs.changed_ranges(t("diff_texts"))


@query("src_2_diff_files", """
WITH k AS (SELECT CAST(o_orderkey AS VARCHAR) AS change_id, o_orderkey AS o FROM {orders})
SELECT change_id, 'src/a.rs' AS path, CAST(10 AS BIGINT) AS start, CAST(CASE WHEN o % 5 = 0 THEN 12 ELSE 11 END AS BIGINT) AS "end" FROM k
UNION ALL SELECT change_id, 'src/a.rs', 12 + o % 5, 12 + o % 5 FROM k WHERE o % 5 <> 0
UNION ALL SELECT change_id, 'src/b.rs', 6, CASE WHEN o % 2 = 0 THEN 6 ELSE 8 END FROM k
UNION ALL SELECT change_id, 'src/b.rs', 8, 8 FROM k WHERE o % 2 = 0
""")
def _(t):
    texts = t("diff_texts").select(F.concat(F.lit(diffs.CHANGE), "change_id", F.lit("\n"), "diff").alias("value"))
    return diffs.ranges_of_files(t.spark, _written(t, texts, "diffs"))


# Nested packets: an order with its work item and two candidates.
adapter("packet_rows", """
SELECT CAST(o_orderkey AS STRING) AS document_id,
       CASE WHEN o_orderkey % 40 = 3 THEN '{ not json' ELSE
       concat('{"schema_version":', CASE WHEN o_orderkey % 11 = 0 THEN '2' ELSE '1' END, ',"source":"s', CAST(o_custkey AS STRING), '"',
              CASE WHEN o_orderkey % 13 = 0 THEN ',"future":true' ELSE '' END, ',"current":{',
              CASE WHEN o_orderkey % 19 = 0 THEN '"title":"x"' ELSE concat('"id":"#', CAST(o_orderkey AS STRING), '"') END,
              CASE WHEN o_orderkey % 17 = 0 THEN ',"future":{}' ELSE '' END, ',"paths":["a.rs","b/c.rs"]},"active":[{"id":"#1","draft":false},{"id":"#', CAST(o_custkey AS STRING), '"',
              CASE WHEN o_orderkey % 23 = 0 THEN ',"future":1' ELSE '' END, ',"draft":true}]}') END AS raw
FROM {orders}
""")

ID = T.StructField("id", T.StringType(), False)
PACKET = T.StructType([
    T.StructField("schema_version", T.IntegerType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("current", T.StructType([ID, T.StructField("title", T.StringType()), T.StructField("paths", T.ArrayType(T.StringType()))]), False),
    T.StructField("active", T.ArrayType(T.StructType([ID, T.StructField("draft", T.BooleanType())])), False),
])
VERDICT = """CASE WHEN o_orderkey % 40 = 3 THEN 'malformed' WHEN o_orderkey % 11 = 0 THEN 'unsupported_schema_version'
  WHEN o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 OR o_orderkey % 23 = 0 THEN 'unknown_field' WHEN o_orderkey % 19 = 0 THEN 'missing_field' END"""


@query("val_1_admission", f"SELECT CAST(o_orderkey AS VARCHAR) AS document_id, {VERDICT} AS reason FROM {{orders}}")
def _(t):
    return adm.admit(t("packet_rows"), "raw", PACKET, 1).select("document_id", "reason")


@query("src_4_packet_rows", f"""
SELECT CAST(o_orderkey AS VARCHAR) AS document_id, unnest(['#1', concat('#', o_custkey)]) AS id, unnest([false, true]) AS draft
FROM {{orders}} WHERE {VERDICT} IS NULL
""")
def _(t):
    kept = adm.admit(t("packet_rows"), "raw", PACKET, 1).where("reason IS NULL").select("document_id", "packet.active")
    return packets.unnest(kept, "active", "document_id")


# Documents that span lines, many to a file: an array that opens and closes with its file.
adapter("packet_lines", """
SELECT p.o_orderkey % 4 AS part, p.o_orderkey AS place, concat('{"document_id":"', r.document_id, '",', chr(10), '  "packet": ', r.raw, '},') AS value
FROM {packet_rows} r JOIN {orders} p ON CAST(p.o_orderkey AS STRING) = r.document_id WHERE r.raw <> '{ not json'
UNION ALL SELECT o_orderkey % 4 AS part, min(-1 - o_orderkey) AS place, '[' AS value FROM {orders} GROUP BY o_orderkey % 4
UNION ALL SELECT o_orderkey % 4 AS part, max(1 + o_orderkey) AS place, '{}]' AS value FROM {orders} GROUP BY o_orderkey % 4
""")


PACKETS = 50_000  # of all parts together in one run, about: a file that spans lines is read by one task


def packet_runs(lines, runs: int):
    """``packet_lines`` with the ``run`` of each part that a line belongs to; every run opens and closes its own array.

    There are as many runs as the table needs, so files stay small; an array without documents is a valid file.
    """
    n = max(runs, 1)
    one = F.array(F.pmod(F.xxhash64("place"), F.lit(n)).cast("int"))
    each = F.sequence(F.lit(0), F.lit(n - 1))
    return lines.withColumn("run", F.explode(F.when(F.col("value").isin("[", "{}]"), each).otherwise(one)))


@query("src_4_packet_files", """
SELECT CAST(o_orderkey AS VARCHAR) AS document_id, concat('s', o_custkey) AS source, unnest(['#1', concat('#', o_custkey)]) AS id, unnest([false, true]) AS draft
FROM {orders} WHERE o_orderkey % 40 <> 3
""")
def _(t):
    lines = packet_runs(t("packet_lines"), -(-t("orders").count() // PACKETS))
    lines = lines.repartition("part", "run").sortWithinPartitions("part", "run", "place")
    folder = _written(t, lines.select("value", "part", "run"), "packets", "part", "run")
    schema = T.StructType([T.StructField("document_id", T.StringType()), T.StructField("packet", PACKET)])
    read = packets.read_packets(t.spark, folder, schema).where("document_id IS NOT NULL")
    return packets.unnest(read.select("document_id", "packet.source", "packet.active"), "active", "document_id", "source")


adapter("attribute_files", """
SELECT concat('r', CAST(p_partkey % 7 AS STRING)) AS repository,
       concat('# gen/skip.rs linguist-generated=true', chr(10), '  ./gen/', path, '  text', chr(9), 'linguist-generated=true', chr(10),
              CASE WHEN p_partkey % 2 = 0 THEN concat('win', chr(92), path, ' linguist-generated=true -diff', chr(13), chr(10)) ELSE '' END,
              'linguist-generated=true', chr(10), 'other.rs linguist-generated', chr(10)) AS source
FROM {part_path}
""")


@query("src_5_generated_paths", """
SELECT DISTINCT concat('r', CAST(p_partkey % 7 AS VARCHAR)) AS repository, concat('gen/', path) AS path FROM {part_path}
UNION SELECT DISTINCT concat('r', CAST(p_partkey % 7 AS VARCHAR)), concat('win/', path) FROM {part_path} WHERE p_partkey % 2 = 0
""")
def _(t):
    return packets.generated_paths(t("attribute_files"))


adapter("repeated_observations", """
SELECT * FROM {observations}
UNION ALL SELECT * FROM {observations} WHERE observation_id LIKE '%3'
UNION ALL SELECT observation_id, discriminator_id, subject_ref, CASE WHEN value_ref IS NULL THEN 'v9' END AS value_ref, applicability
FROM {observations} WHERE observation_id LIKE '%17'
""")


@query("val_2_duplicate_ids", """
SELECT observation_id, count(*) AS rows, CASE WHEN count(DISTINCT coalesce(value_ref, '-')) > 1 THEN 'conflicting' ELSE 'duplicate' END AS kind
FROM {repeated_observations} GROUP BY observation_id HAVING count(*) > 1
""")
def _(t):
    return adm.duplicate_ids(t("repeated_observations"), ["observation_id"])


adapter("loose_edges", """
SELECT * FROM {coordination_edges}
UNION ALL SELECT * FROM {coordination_edges} WHERE to_id LIKE '%5'
UNION ALL SELECT snapshot_id, kind, from_id, from_id AS to_id, source FROM {coordination_edges} WHERE to_id LIKE '%7'
UNION ALL SELECT snapshot_id, kind, concat(from_id, 'x') AS from_id, to_id, source FROM {coordination_edges} WHERE to_id LIKE '%9'
UNION ALL SELECT snapshot_id, kind, from_id, concat(to_id, 'y') AS to_id, source FROM {coordination_edges} WHERE from_id LIKE '%3'
""")


@query("val_3_edge_violations", """
WITH e AS (SELECT snapshot_id, kind, from_id, to_id, source, count(*) AS n FROM {loose_edges} GROUP BY ALL)
SELECT snapshot_id, kind, from_id, to_id, source, 'self_edge' AS reason FROM e WHERE from_id = to_id
UNION ALL SELECT snapshot_id, kind, from_id, to_id, source, 'missing_source' FROM e WHERE NOT EXISTS (SELECT 1 FROM {work_items} w WHERE w.snapshot_id = e.snapshot_id AND w.id = e.from_id)
UNION ALL SELECT snapshot_id, kind, from_id, to_id, source, 'missing_target' FROM e WHERE NOT EXISTS (SELECT 1 FROM {work_items} w WHERE w.snapshot_id = e.snapshot_id AND w.id = e.to_id)
UNION ALL SELECT snapshot_id, kind, from_id, to_id, source, 'duplicate_edge' FROM e WHERE n > 1
""")
def _(t):
    return adm.edge_violations(t("work_items"), t("loose_edges"), "snapshot_id")


adapter("owner_paths", """
SELECT l_orderkey AS owner,
       CASE l_suppkey % 9 WHEN 0 THEN concat('/', path) WHEN 1 THEN concat(path, '/') WHEN 2 THEN replace(path, '/', '//') WHEN 3 THEN concat('./', path)
            WHEN 4 THEN replace(path, '/', '/../') WHEN 5 THEN replace(path, '/', chr(92)) WHEN 6 THEN CASE WHEN l_linenumber = 1 THEN '' ELSE concat('.', path) END ELSE path END AS path
FROM {lineitem} JOIN {part_path} ON l_partkey = p_partkey
""")
CANONICAL = "path <> '' AND NOT contains(path, chr(92)) AND NOT list_has_any(string_split(path, '/'), ['', '.', '..'])"


@query("val_4_path_violations", f"""
SELECT owner, path, 'not_canonical' AS reason FROM (SELECT DISTINCT owner, path FROM {{owner_paths}}) d WHERE NOT ({CANONICAL})
UNION ALL SELECT owner, path, 'duplicate_path' FROM {{owner_paths}} GROUP BY owner, path HAVING count(*) > 1
""")
def _(t):
    return adm.path_violations(t("owner_paths"), ["owner"])


# Generators: a package per brand, an alias per type.
adapter("generator_aliases", """
SELECT DISTINCT concat('r', CAST(p_partkey % 7 AS STRING)) AS repository, concat('gen-', lower(p_type)) AS alias, p_brand AS package FROM {part}
""")
adapter("generator_functions", """
SELECT DISTINCT concat('r', CAST(p_partkey % 7 AS STRING)) AS repository, p_brand AS package, concat('tools/', p_brand, '.rs') AS generator_path,
       concat('f', CAST(p_size % 3 AS STRING)) AS function, path AS read1, concat(path, '.in') AS read2, concat('gen/', path) AS write1
FROM {part} p JOIN (SELECT p_partkey AS k, path FROM {part_path}) q ON p.p_partkey = q.k WHERE p_brand <> 'Brand#7'
""")


@query("gen_1_relations", """
SELECT DISTINCT a.repository, a.alias, a.package, f.generator_path, f.function, unnest([f.read1, f.read2]) AS input, f.write1 AS output
FROM {generator_aliases} a JOIN {generator_functions} f ON f.repository = a.repository AND f.package = a.package
""")
def _(t):
    io = t("generator_functions").withColumns({"reads": F.array("read1", "read2"), "writes": F.array("write1")})
    return gen.generator_relations(t("generator_aliases"), io)


# Every source has a generated twin that follows it, except for every fifth brand.
adapter("twin_history", """
SELECT repository, sha, path
FROM (SELECT repository, sha, path AS own, CASE WHEN path LIKE '%5.rs' AND sha LIKE '%1' THEN NULL ELSE concat('gen/', path) END AS twin FROM {commit_paths}) h
UNPIVOT (path FOR side IN (own, twin))
""")
adapter("twin_pairs", "SELECT DISTINCT repository, path AS source, concat('gen/', path) AS output FROM {commit_paths}")
# The classes of the history, from one read of the lines.
adapter("twin_changes", """
SELECT repository, change_id, CASE WHEN side = 'twin' THEN concat('gen/', path) ELSE path END AS path, change_class
FROM (SELECT repository, sha AS change_id, path, CASE WHEN sha LIKE '%7' THEN NULL ELSE 'unclassified' END AS twin,
             CASE WHEN after_line IS NULL OR before_line IS NULL THEN 'unclassified' WHEN after_line = before_line THEN 'comments_or_docs_only' ELSE 'syntax_changed' END AS own
      FROM (SELECT concat('r', CAST(l_orderkey % 7 AS STRING)) AS repository, CAST(l_orderkey AS STRING) AS sha, path,
                   min(CASE WHEN l_linenumber < 7 THEN l_linenumber END) AS after_line,
                   min(CASE WHEN l_quantity > 2 THEN CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END END) AS before_line
            FROM {lineitem} JOIN {part_path} ON l_partkey = p_partkey GROUP BY l_orderkey, path) v) c
UNPIVOT (change_class FOR side IN (own, twin))
""")
adapter("twin_files", "SELECT repository, output AS path FROM {twin_pairs} WHERE length(output) % 9 <> 0")
adapter("twin_attributed", "SELECT repository, output AS path FROM {twin_pairs} WHERE NOT (output LIKE '%8.rs')")
adapter("twin_heads", """
SELECT repository, output AS path, CASE WHEN output LIKE '%6.rs' THEN 'plain' ELSE concat('// top', chr(10), '// @generated by tool') END AS content FROM {twin_pairs}
""")


@query("gen_2_missing_companions", """
WITH coh AS MATERIALIZED (
  SELECT p.repository, p.source, p.output, count(*) AS opportunities, count(o.sha) AS support
  FROM {twin_pairs} p JOIN {cohort} h ON h.repository = p.repository AND h.anchor = p.source AND h.considered
  JOIN {classified} c ON c.repository = h.repository AND c.sha = h.sha AND c.path = h.anchor AND c.change_class = 'syntax_changed'
  LEFT JOIN {twin_history} o ON o.repository = h.repository AND o.sha = h.sha AND o.path = p.output GROUP BY p.repository, p.source, p.output)
SELECT c.repository, c.change_id, c.path AS input, coh.output, CAST(2 AS BIGINT) AS marker_line, '// @generated by tool' AS marker, coh.opportunities, coh.support
FROM {twin_changes} c JOIN coh ON coh.repository = c.repository AND coh.source = c.path
WHERE c.change_class = 'syntax_changed' AND coh.opportunities >= 3 AND coh.support = coh.opportunities
  AND length(coh.output) % 9 <> 0 AND NOT (coh.output LIKE '%8.rs') AND NOT (coh.output LIKE '%6.rs')
  AND NOT EXISTS (SELECT 1 FROM {twin_changes} x WHERE x.repository = c.repository AND x.change_id = c.change_id AND x.path = coh.output)
""")
def _(t):
    cohort = kept(hist.anchor_cohort(t("commits"), t("commit_paths"), max_commits=100, max_paths=6), "cohort")
    tagged = kept(hist.tagged_cohort(cohort, t("source_commits"), t("file_versions")), "tagged")
    t.keep("twin_pairs")  # read by five inputs
    cohorts = hist.class_cohort(tagged, t("twin_history"), t("twin_pairs"))
    relations = t("twin_pairs").withColumnRenamed("source", "input")
    markers = hist.generated_markers(t("twin_heads"))
    return gen.missing_companions(t("twin_changes"), relations, t("twin_files"), t("twin_attributed"), markers, cohorts)


# Workflow lines: one per line item, most of them supported.
adapter("workflow_lines", """
SELECT concat('r', CAST(l_suppkey % 20 AS STRING)) AS repository, concat('.github/workflows/', CAST(l_orderkey AS STRING), '.yml') AS path, l_linenumber AS line,
       concat('      ', CASE l_linenumber WHEN 1 THEN '- run: ' WHEN 2 THEN 'run:' WHEN 3 THEN '# ' ELSE '' END,
         'cargo ', CASE l_suppkey % 6 WHEN 0 THEN '+nightly-1.2 ' WHEN 1 THEN '+bad! ' ELSE '' END, 'test',
         CASE WHEN l_suppkey % 7 = 0 THEN ' --features a,b' ELSE '' END, CASE WHEN l_suppkey % 11 = 0 THEN ' -p core' ELSE '' END,
         ' ', CASE l_partkey % 3 WHEN 0 THEN chr(39) ELSE '' END, replace(split_part(path, '/', 1), 'o', CASE WHEN l_partkey % 13 = 0 THEN '::' ELSE 'o' END), CASE l_partkey % 3 WHEN 0 THEN chr(39) ELSE '' END,
         CASE WHEN l_partkey % 5 = 0 THEN '' ELSE ' --lib' END, CASE WHEN l_partkey % 17 = 0 THEN ' twice' ELSE '' END, CASE WHEN l_partkey % 4 = 0 THEN ' -- --nocapture -x' ELSE '' END,
         CASE WHEN l_partkey % 19 = 0 THEN concat(' ', chr(92)) ELSE '' END, CASE WHEN l_partkey % 23 = 0 THEN ' --jobs' ELSE '' END) AS text
FROM {lineitem} JOIN {part_path} ON l_partkey = p_partkey
""")
# The oracle recognises a supported line with one regular expression over the whole command.
FLAG = (
    r"--lib|--locked|--quiet|-q|--release|--no-fail-fast|--no-default-features|--all-features|--frozen|--offline"
    r"|(?:--features|--color|--jobs|-j|--profile|--target|--target-dir|--config)\s+\S+"
)
WHOLE = (
    rf"^cargo\s+(?:\+[A-Za-z0-9._-]+\s+)?test((?:\s+(?:{FLAG}))*)\s+[\x27]*([A-Za-z0-9_]+)[\x27]*((?:\s+(?:{FLAG}))*)(?:\s+--(?:\s.*)?)?$"
)
COMMANDS = f"""
SELECT repository, path, line, command, m.f AS filter FROM (
  SELECT *, regexp_extract(command, '{WHOLE}', ['a', 'f', 'b']) AS m FROM (
    SELECT repository, path, line, trim(regexp_replace(regexp_replace(trim(text), '^- ', ''), '^run:', '')) AS command FROM {{workflow_lines}}
    WHERE NOT starts_with(trim(text), '#') AND NOT ends_with(trim(text), chr(92))) c
  WHERE starts_with(command, 'cargo test ') OR starts_with(command, 'cargo +')) d
WHERE m.f <> '' AND regexp_matches(concat(m.a, ' ', m.b, ' '), '\\s--lib\\s')
"""


@query("ci_1_commands", COMMANDS)
def _(t):
    return ci.ci_commands(t("workflow_lines"))


adapter("ci_names", """
SELECT concat('r', CAST(p_partkey % 18 AS STRING)) AS repository, CASE WHEN p_size % 2 = 0 THEN 'test' ELSE 'module' END AS kind,
       concat('check_', CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) ELSE 'misc' END, '_', replace(p_name, ' ', '_')) AS name
FROM {part} WHERE NOT (p_partkey % 18 = 5 AND p_size % 2 = 0) AND NOT (p_partkey % 18 IN (2, 4) AND p_type = 'PROMO')
""")
adapter("ci_failures", "SELECT concat('r', CAST(r_regionkey + 7 AS STRING)) AS repository, 'broken.rs' AS path FROM {region} WHERE r_regionkey < 2")
OUTCOMES = f"""
SELECT c.*, CASE WHEN c.repository IN (SELECT repository FROM {{ci_failures}}) THEN 'suppressed_parse_failures'
            WHEN c.repository NOT IN (SELECT repository FROM {{ci_names}} WHERE kind = 'test') THEN 'suppressed_no_tests'
            WHEN EXISTS (SELECT 1 FROM {{ci_names}} n WHERE n.repository = c.repository AND contains(n.name, c.filter)) THEN 'matched' ELSE 'unmatched' END AS outcome
FROM ({COMMANDS}) c
"""


@query("ci_2_filter_outcomes", OUTCOMES)
def _(t):
    return ci.filter_outcomes(ci.ci_commands(t("workflow_lines")), t("ci_names"), t("ci_failures"))


@query("ci_2_unmatched_filters", f"SELECT repository, path, line, command, filter FROM ({OUTCOMES}) o WHERE outcome = 'unmatched'")
def _(t):
    return ci.unmatched_filters(ci.ci_commands(t("workflow_lines")), t("ci_names"), t("ci_failures"))


adapter("fact_inputs", """
SELECT lang AS namespace, concat(source, '/', CAST(doc_id AS STRING)) AS path, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE md5(text) END AS content_id FROM {documents}
""")
adapter("fact_store", """
SELECT lang AS namespace, md5(text) AS content_id, max(n_chars) AS facts FROM {documents} WHERE n_chars % 3 <> 0 GROUP BY lang, md5(text)
""")


@query("fact_1_cached_facts", """
SELECT i.namespace, i.content_id, i.path, s.facts FROM {fact_inputs} i JOIN {fact_store} s ON s.namespace = i.namespace AND s.content_id = i.content_id
""")
def _(t):
    return fx.cached_facts(t("fact_inputs"), t("fact_store"))


@query("fact_1_facts_to_extract", """
SELECT i.* FROM {fact_inputs} i WHERE NOT EXISTS (SELECT 1 FROM {fact_store} s WHERE s.namespace = i.namespace AND s.content_id = i.content_id)
""")
def _(t):
    return fx.facts_to_extract(t("fact_inputs"), t("fact_store"))


@query("fact_1_reuse_counters", """
SELECT i.namespace, count(s.content_id) AS cache_hits, count(*) - count(s.content_id) AS parsed_files
FROM {fact_inputs} i LEFT JOIN {fact_store} s ON s.namespace = i.namespace AND s.content_id = i.content_id GROUP BY i.namespace
""")
def _(t):
    return fx.reuse_counters(t("fact_inputs"), t("fact_store"))
