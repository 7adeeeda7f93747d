"""Naming conventions."""

from ..operators import conventions as op
from ..sources import diffs
from .core import adapter, query

adapter("facts", """
SELECT concat('r', CAST(p_partkey % 5 AS STRING)) AS repository, concat(replace(p_brand, '#', ''), '.rs') AS path,
       CASE WHEN p_partkey % 97 = 0 THEN concat('only', CAST(p_partkey AS STRING)) WHEN p_size % 3 = 0 THEN 'tests' ELSE replace(p_name, ' ', '_') END AS name,
       p_partkey AS line
FROM {part}
""")
adapter("fact_ranges", """
SELECT concat('r', CAST(p_partkey % 5 AS STRING)) AS repository, concat(replace(p_brand, '#', ''), '.rs') AS path,
       p_partkey AS start, p_partkey + p_size * 20 AS "end"
FROM {part}
""".replace('"end"', "stop"))
NAMES = """
WITH c AS (SELECT repository, name, count(*) AS n FROM {facts} GROUP BY repository, name),
t AS (SELECT repository, CAST(sum(n) AS BIGINT) AS total, count(*) AS distinct_names, max(n) AS top FROM c GROUP BY repository),
d AS (SELECT c.repository, count(*) AS at_top FROM c JOIN t ON t.repository = c.repository AND c.n = t.top GROUP BY c.repository)
"""


@query("conv_1_name_distribution", NAMES + """
SELECT c.repository, c.name, c.n, t.total, t.distinct_names, c.n = t.top AND d.at_top = 1 AS is_dominant, c.n = t.top AND d.at_top > 1 AS tied
FROM c JOIN t ON t.repository = c.repository JOIN d ON d.repository = c.repository
""")
def _(t):
    return op.name_distribution(t("facts"))


@query("conv_2_local_mix", """
SELECT repository, path, name, occurrences, first_line, distinct_names FROM (
  SELECT repository, path, name, count(*) AS occurrences, min(line) AS first_line, count(*) OVER (PARTITION BY repository, path) AS distinct_names
  FROM {facts} GROUP BY repository, path, name) x WHERE distinct_names > 1
""")
def _(t):
    return op.local_mix(t("facts"))


@query("conv_3_one_offs", """
SELECT repository, path, line, name, total FROM (
  SELECT *, count(*) OVER (PARTITION BY repository, name) AS n, count(*) OVER (PARTITION BY repository) AS total FROM {facts}) x
WHERE n = 1 AND total > 1
""")
def _(t):
    return op.one_offs(t("facts"))


def _changed(t):
    ranges = t("fact_ranges").withColumnRenamed("stop", "end")
    return diffs.facts_in_ranges(t("facts"), ranges, ["repository", "path"])


CHANGED = """SELECT * FROM {facts} f WHERE EXISTS (SELECT 1 FROM {fact_ranges} r
  WHERE r.repository = f.repository AND r.path = f.path AND f.line BETWEEN r.start AND r.stop)"""


@query("src_3_facts_in_ranges", CHANGED)
def _(t):
    return _changed(t)


@query("conv_4_precedent_findings", f"""
WITH ch AS ({CHANGED}),
others AS (SELECT ch.repository, ch.path, ch.line, ch.name, o.name AS other, o.path = ch.path AS same_file
           FROM ch JOIN {{facts}} o ON o.repository = ch.repository AND NOT (o.path = ch.path AND o.line = ch.line AND o.name = ch.name)),
counts AS (SELECT repository, path, line, name, other, count(*) AS n FROM others GROUP BY ALL),
tops AS (SELECT repository, path, line, name, max(n) AS m FROM counts GROUP BY ALL),
dom AS (SELECT c.repository, c.path, c.line, c.name, CASE WHEN count(*) = 1 THEN min(c.other) END AS dominant
        FROM counts c JOIN tops t ON t.repository = c.repository AND t.path = c.path AND t.line = c.line AND t.name = c.name AND t.m = c.n GROUP BY ALL),
agg AS (SELECT repository, path, line, name, count(*) AS precedent_total, count(*) FILTER (WHERE other = name) AS repository_count,
               count(DISTINCT other) FILTER (WHERE same_file AND other <> name) AS different_local_names,
               CASE WHEN count(DISTINCT other) FILTER (WHERE same_file) = 1 THEN min(other) FILTER (WHERE same_file) END AS local_name
        FROM others GROUP BY repository, path, line, name),
f AS (SELECT a.*, d.dominant, repository_count = 0 AND precedent_total > 0 AS one_off, coalesce(d.dominant <> a.local_name, false) AS tension
      FROM agg a LEFT JOIN dom d ON d.repository = a.repository AND d.path = a.path AND d.line = a.line AND d.name = a.name)
SELECT repository, path, line, name, repository_count, precedent_total, different_local_names, one_off,
       CASE WHEN tension THEN 'precedent_tension' ELSE 'precedent' END AS finding_kind,
       CASE WHEN tension THEN dominant END AS repository_name, CASE WHEN tension THEN local_name END AS file_name,
       CASE WHEN tension THEN CASE WHEN name = dominant THEN 'repository' WHEN name = local_name THEN 'file' ELSE 'neither' END END AS alignment
FROM f WHERE different_local_names > 0 OR one_off
""")
def _(t):
    return op.precedent_findings(t("facts"), _changed(t))


@query("conv_4_local_names", f"""
SELECT DISTINCT ch.repository, ch.path, ch.line, ch.name, o.name AS local_name FROM ({CHANGED}) ch
JOIN {{facts}} o ON o.repository = ch.repository AND o.path = ch.path AND o.name <> ch.name
""")
def _(t):
    return op.precedent_local_names(t("facts"), op.precedent_findings(t("facts"), _changed(t)))


# Small files, so that a file often has exactly one other name: the tension cases.
adapter("small_file_facts", """
SELECT concat('r', CAST(p_partkey % 5 AS STRING)) AS repository, concat('f', CAST(p_partkey - p_partkey % 15 AS STRING), '.rs') AS path,
       CASE WHEN p_size % 4 = 0 THEN replace(p_name, ' ', '_') WHEN p_partkey % 30 < 15 THEN 'checks' ELSE 'tests' END AS name, p_partkey AS line
FROM {part}
""")


@query("conv_5_precedent_tension", f"""
WITH ch AS (SELECT * FROM {{small_file_facts}} WHERE line % 2 = 0),
others AS (SELECT ch.repository, ch.path, ch.line, ch.name, o.name AS other, o.path = ch.path AS same_file
           FROM ch JOIN {{small_file_facts}} o ON o.repository = ch.repository AND NOT (o.path = ch.path AND o.line = ch.line AND o.name = ch.name)),
counts AS (SELECT repository, path, line, name, other, count(*) AS n FROM others GROUP BY ALL),
ranked AS (SELECT *, rank() OVER (PARTITION BY repository, path, line, name ORDER BY n DESC) AS rk FROM counts),
dom AS (SELECT repository, path, line, name, CASE WHEN count(*) = 1 THEN min(other) END AS dominant FROM ranked WHERE rk = 1 GROUP BY ALL),
loc AS (SELECT repository, path, line, name, CASE WHEN count(DISTINCT other) = 1 THEN min(other) END AS local_name FROM others WHERE same_file GROUP BY ALL)
SELECT d.repository, d.path, d.line, d.name, d.dominant AS repository_name, l.local_name AS file_name,
       CASE WHEN d.name = d.dominant THEN 'repository' WHEN d.name = l.local_name THEN 'file' ELSE 'neither' END AS alignment
FROM dom d JOIN loc l ON l.repository = d.repository AND l.path = d.path AND l.line = d.line AND l.name = d.name
WHERE d.dominant <> l.local_name AND (
  EXISTS (SELECT 1 FROM others o WHERE o.same_file AND o.other <> d.name AND o.repository = d.repository AND o.path = d.path AND o.line = d.line)
  OR NOT EXISTS (SELECT 1 FROM others o WHERE o.other = d.name AND o.repository = d.repository AND o.path = d.path AND o.line = d.line AND o.name = d.name))
""")
def _(t):
    facts = t("small_file_facts")
    rows = op.precedent_findings(facts, facts.where("line % 2 = 0"))
    return rows.where("finding_kind = 'precedent_tension'").select(
        "repository", "path", "line", "name", "repository_name", "file_name", "alignment"
    )
