"""Reviews, closures, claims and the episode front."""

from pyspark.sql import functions as F

from ..operators import claims as cl
from ..operators import closures as clo
from ..operators import fronts as fr
from ..operators import reviews as rev
from ..plans.durable import kept_for
from .core import adapter, query

adapter("concerns", """
SELECT CAST(c_custkey AS STRING) AS concern_id, concat('concern-', CAST(c_custkey AS STRING)) AS concern_key,
       CASE WHEN c_nationkey = 7 THEN NULL ELSE concat('r', CAST(c_custkey % 3 AS STRING)) END AS repository,
       CASE WHEN c_nationkey = 8 THEN NULL ELSE concat('v', CAST(c_nationkey % 4 AS STRING)) END AS revision,
       CASE WHEN c_nationkey = 9 THEN NULL ELSE 'w1' END AS work,
       CASE WHEN c_nationkey % 6 = 0 THEN NULL ELSE concat('src/', CAST(c_nationkey % 2 AS STRING), '/a.rs') END AS path
FROM {customer}
""")
adapter("review_events", """
SELECT CAST(o_orderkey AS STRING) AS event_id, concat('concern-', CAST(o_custkey AS STRING)) AS concern_key,
       concat('r', CAST((o_custkey + CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END) % 3 AS STRING)) AS repository,
       concat('v', CAST(o_orderkey % 4 AS STRING)) AS revision, CASE WHEN o_orderkey % 8 = 0 THEN 'w2' ELSE 'w1' END AS work,
       CASE o_orderkey % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'prefix' END AS scope_mode,
       CASE o_orderkey % 5 WHEN 0 THEN 'src/1/a.rs' WHEN 1 THEN 'src' END AS scope_path,
       CASE o_orderstatus WHEN 'F' THEN 'fixed' WHEN 'O' THEN 'open' ELSE 'declined' END AS outcome
FROM {orders} WHERE o_custkey % 4 <> 1 OR o_orderkey % 3 = 0
""")
MATCHES = """
SELECT c.concern_id, c.concern_key, e.event_id, e.outcome,
       CASE WHEN e.repository <> c.repository OR e.work <> c.work
              OR (c.path <> e.scope_path AND NOT (e.scope_mode = 'prefix' AND starts_with(c.path, concat(e.scope_path, '/')))) THEN 'unrelated'
            WHEN c.repository IS NULL OR c.work IS NULL OR (e.scope_path IS NOT NULL AND c.path IS NULL) OR c.revision IS NULL THEN 'context_missing'
            WHEN e.revision = c.revision THEN 'current' ELSE 'prior_head' END AS match_kind
FROM {concerns} c JOIN {review_events} e ON e.concern_key = c.concern_key
"""
DISPOSITIONS = f"""
SELECT c.concern_id, count(m.event_id) AS matches,
       CASE WHEN c.repository IS NULL OR c.revision IS NULL OR c.work IS NULL THEN 'need_context'
            WHEN count(*) FILTER (WHERE m.match_kind = 'current') > 0 THEN 'reuse_current_thread'
            WHEN count(*) FILTER (WHERE m.match_kind = 'prior_head') > 0 THEN 'refresh_existing_thread'
            WHEN count(*) FILTER (WHERE m.match_kind = 'context_missing') > 0 THEN 'need_context' ELSE 'new_thread' END AS disposition
FROM {{concerns}} c LEFT JOIN ({MATCHES}) m ON m.concern_id = c.concern_id
GROUP BY c.concern_id, c.repository, c.revision, c.work
"""


@query("rev_1_review_matches", MATCHES)
def _(t):
    return rev.review_matches(t("concerns"), t("review_events"))


def _dispositions(t):
    return rev.review_disposition(t("concerns"), rev.review_matches(t("concerns"), t("review_events")))


@query("rev_2_disposition", DISPOSITIONS)
def _(t):
    return _dispositions(t)


# Turns of a conversation are review comments that answer the turn before, or the first one.
adapter("review_comments", """
SELECT concat('r', CAST(conv_id % 3 AS STRING)) AS repository, conv_id AS pull, conv_id * 100 + turn AS comment_id,
       CASE WHEN turn = 0 OR turn = 5 THEN NULL WHEN turn % 2 = 0 THEN conv_id * 100 ELSE conv_id * 100 + turn - 1 END AS in_reply_to_id,
       concat('src/', role, '.rs') AS path, concat('c', CAST(turn AS STRING)) AS commit_id
FROM {conversations}
""")
adapter("review_selections", """
SELECT concat(CAST(conv_id AS STRING), '/', CAST(turn AS STRING)) AS selection_id, concat('r', CAST(conv_id % 3 AS STRING)) AS repository, conv_id AS pull,
       CASE WHEN turn = 6 THEN conv_id * 100 + 77 WHEN turn = 7 THEN conv_id * 100 + 1 ELSE conv_id * 100 END AS root_id,
       CASE WHEN turn % 4 = 0 THEN 'open' ELSE 'fixed' END AS outcome,
       CASE WHEN turn % 4 = 0 AND conv_id % 5 <> 0 THEN NULL WHEN conv_id % 7 = 0 THEN NULL WHEN conv_id % 11 = 0 THEN conv_id * 100 + 88
            ELSE conv_id * 100 + turn END AS resolution_id
FROM {conversations}
""")


@query("rev_3_review_events", """
WITH v AS (
  SELECT s.*, r.commit_id, r.path, CASE WHEN s.outcome = 'open' AND s.resolution_id IS NOT NULL THEN 'open_with_resolution'
      WHEN s.outcome <> 'open' AND s.resolution_id IS NULL THEN 'closed_without_resolution'
      WHEN r.comment_id IS NULL THEN 'root_absent' WHEN r.in_reply_to_id IS NOT NULL THEN 'root_is_reply'
      WHEN s.resolution_id IS NOT NULL AND x.comment_id IS NULL THEN 'resolution_absent'
      WHEN s.resolution_id IS NOT NULL AND x.in_reply_to_id IS DISTINCT FROM s.root_id THEN 'resolution_not_direct_reply' END AS violation
  FROM {review_selections} s
  LEFT JOIN {review_comments} r ON r.repository = s.repository AND r.pull = s.pull AND r.comment_id = s.root_id
  LEFT JOIN {review_comments} x ON x.repository = s.repository AND x.pull = s.pull AND x.comment_id = s.resolution_id)
SELECT selection_id, repository, pull, violation, outcome, CASE WHEN violation IS NULL THEN root_id END AS root_id,
       CASE WHEN violation IS NULL THEN commit_id END AS revision, CASE WHEN violation IS NULL THEN path END AS scope_path,
       CASE WHEN violation IS NULL THEN resolution_id END AS resolution_id
FROM v
""")
def _(t):
    return rev.review_events(t("review_comments"), t("review_selections"))


adapter("issues", """
SELECT concat('Org/r', CAST(o_orderkey - o_orderkey % 64 AS STRING)) AS repository, o_orderkey + 1 AS number,
       CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS state, concat('user', CAST(o_custkey AS STRING)) AS reporter,
       concat('Body', chr(10), CASE WHEN o_orderkey % 3 = 0 THEN concat('  **Re-reporting** the bug from #', CAST(o_orderkey - 6 + o_orderkey % 2 * 14 AS STRING),
                CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' (still there)' WHEN 2 THEN '.' ELSE 'x' END, chr(10)) ELSE '' END,
              CASE WHEN o_orderkey % 15 = 0 THEN concat('**Re-reporting** the bug from #9', chr(10)) ELSE '' END,
              'see **Re-reporting** the bug from #1') AS body
FROM {orders}
""")
adapter("issue_comments", """
SELECT concat('Org/r', CAST(o_orderkey - o_orderkey % 64 AS STRING)) AS repository, o_orderkey + 1 AS number, l_linenumber + l_suppkey * 10 AS comment_id,
       CASE WHEN l_linenumber = 4 THEN concat('user', CAST(o_custkey AS STRING)) WHEN l_linenumber = 5 THEN 'someone' ELSE 'github-actions[bot]' END AS actor,
       CASE WHEN l_linenumber < 3 OR l_linenumber = 5 THEN concat('Closing for now — inactive for too long. Please [open a new issue](https://github.com/Org/r',
                CAST(CASE WHEN l_quantity < 5 THEN 8 ELSE o_orderkey - o_orderkey % 64 END AS STRING), '/issues/new/choose) if this is still relevant.')
            WHEN l_linenumber = 3 THEN concat('Found 2 possible duplicate issues:', chr(10), 'This issue will be automatically closed as a duplicate in 3 days.')
            WHEN l_linenumber = 4 THEN CASE WHEN l_quantity > 10 THEN 'Not a duplicate of the suggested issues. Mine differs.' ELSE 'Thanks' END
            ELSE 'possible duplicate issues: none' END AS body
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
""")
CLOSURES = """
SELECT i.repository, i.number, CASE WHEN coalesce(c.n, 0) = 0 THEN 'none' WHEN c.n = 1 THEN 'selected' ELSE 'ambiguous' END AS closure,
       CASE WHEN c.n = 1 THEN c.id END AS comment_id
FROM {issues} i LEFT JOIN (
  SELECT repository, number, count(*) AS n, min(comment_id) AS id FROM {issue_comments}
  WHERE actor = 'github-actions[bot]' AND body = concat('Closing for now — inactive for too long. Please [open a new issue](https://github.com/', repository,
        '/issues/new/choose) if this is still relevant.') GROUP BY repository, number) c ON c.repository = i.repository AND c.number = i.number
"""
RE_REPORTS = """
WITH l AS (SELECT repository, number, regexp_extract(trim(s), '^\\*\\*Re-reporting\\*\\* the bug from #([1-9][0-9]*)([ (.,:;-].*)?$', 1) AS n
           FROM (SELECT repository, number, unnest(string_split(body, chr(10))) AS s FROM {issues}) x),
c AS (SELECT repository, number, count(*) FILTER (WHERE n <> '') AS k, max(TRY_CAST(n AS BIGINT)) AS p FROM l GROUP BY repository, number)
SELECT repository, number, CASE k WHEN 0 THEN 'none' WHEN 1 THEN 'selected' ELSE 'ambiguous' END AS re_report, CASE WHEN k = 1 THEN p END AS prior_number FROM c
"""
CHALLENGES = """
SELECT repository, number, challenge, CASE WHEN challenge = 'challenged' THEN sid END AS suggestion_id, CASE WHEN challenge = 'challenged' THEN rid END AS rejection_id
FROM (SELECT *, CASE WHEN s = 0 AND r = 0 THEN 'none' WHEN s = 1 AND r = 1 AND sid <> rid THEN 'challenged' ELSE 'ambiguous' END AS challenge
      FROM (SELECT i.repository, i.number, count(*) FILTER (WHERE c.sug) AS s, count(*) FILTER (WHERE c.rej AND c.actor = i.reporter) AS r,
                   min(CASE WHEN c.sug THEN c.comment_id END) AS sid, min(CASE WHEN c.rej AND c.actor = i.reporter THEN c.comment_id END) AS rid
            FROM {issues} i LEFT JOIN (SELECT *, actor = 'github-actions[bot]' AND contains(body, 'possible duplicate issues:')
                        AND contains(body, 'This issue will be automatically closed as a duplicate in 3 days.') AS sug,
                        starts_with(body, 'Not a duplicate of the suggested issues.') AS rej FROM {issue_comments}) c
              ON c.repository = i.repository AND c.number = i.number GROUP BY i.repository, i.number) n) q
"""


@query("close_1_closure_receipts", CLOSURES)
def _(t):
    return clo.closure_receipts(t("issues"), t("issue_comments"))


@query("close_2_re_reports", RE_REPORTS)
def _(t):
    return clo.re_reports(t("issues"))


@query("close_3_duplicate_challenges", CHALLENGES)
def _(t):
    return clo.duplicate_challenges(t("issues"), t("issue_comments"))


EPISODES = f"""
SELECT p.repository, p.number AS prior_issue, r.number AS later_issue, l.state AS later_state, c.comment_id AS closure_comment_id, d.challenge,
       CASE WHEN c.closure = 'ambiguous' THEN 'ambiguous_closure' WHEN d.challenge = 'ambiguous' THEN 'ambiguous_challenge' END AS rejection,
       CASE WHEN c.closure = 'selected' AND d.challenge <> 'ambiguous' THEN 'unknown' END AS clearance,
       CASE WHEN c.closure = 'selected' AND d.challenge <> 'ambiguous' THEN 'inspect_prior_failure' ELSE 'rejected' END AS disposition
FROM ({RE_REPORTS}) r JOIN {{issues}} p ON p.repository = r.repository AND p.number = r.prior_number AND p.state = 'closed' AND r.number <> p.number
JOIN ({CLOSURES}) c ON c.repository = p.repository AND c.number = p.number AND c.closure <> 'none'
JOIN {{issues}} l ON l.repository = r.repository AND l.number = r.number
JOIN ({CHALLENGES}) d ON d.repository = p.repository AND d.number = p.number
WHERE r.re_report = 'selected'
"""


def _episodes(t):
    return clo.closure_episodes(t("issues"), t("issue_comments"))


@query("close_4_closure_episodes", EPISODES)
def _(t):
    return _episodes(t)


# Lessons: an order is a claim; its line items are repairs, adjacent work or coverage.
adapter("lesson_claims", """
SELECT concat('c', CAST(o_orderkey AS STRING)) AS claim_id, concat('Org/r', CAST(o_orderkey - o_orderkey % 64 AS STRING)) AS repository,
       'd1' AS discriminator, 'v1' AS value_ref, o_orderkey + 1 AS guard, 'd1' AS guard_discriminator,
       CASE WHEN o_orderkey % 10 = 0 THEN 'v2' ELSE 'v1' END AS guard_value_ref, 'Summary' AS repair_marker, 'of' AS guard_marker,
       CASE WHEN o_orderkey % 12 = 0 THEN 'absent text' WHEN o_orderkey % 13 = 0 THEN 'Summary' ELSE 'Summary of' END AS guard_evidence,
       'lint' AS enforcement_kind,
       CASE WHEN o_orderkey % 14 = 0 THEN 'nowhere.rs' ELSE path END AS enforcement_path, 'src' AS scope_ref
FROM {orders} JOIN (SELECT l_orderkey, min(path) AS path FROM {lineitem} JOIN {part_path} ON l_partkey = p_partkey GROUP BY l_orderkey) x ON l_orderkey = o_orderkey
""")
adapter("lesson_repairs", """
SELECT claim_id, number, min(evidence) AS source_evidence
FROM (SELECT concat('c', CAST(l_orderkey AS STRING)) AS claim_id, l_orderkey + 1 + 7 * (l_linenumber - l_linenumber % 2) AS number,
             CASE WHEN l_quantity > 48 THEN 'Summary lost' WHEN l_quantity > 46 THEN 'of' ELSE 'Summary of' END AS evidence
      FROM {lineitem} WHERE l_linenumber < 6) x GROUP BY claim_id, number
""")
adapter("lesson_adjacent", """
SELECT claim_id, number, 'd2' AS discriminator, 'of' AS marker, min(evidence) AS source_evidence
FROM (SELECT concat('c', CAST(l_orderkey AS STRING)) AS claim_id, l_orderkey + 1 + 9 * l_linenumber AS number,
             CASE WHEN l_quantity > 45 THEN 'Summary' ELSE 'Summary of' END AS evidence
      FROM {lineitem} WHERE l_linenumber >= 6) x GROUP BY claim_id, number
""")
adapter("lesson_covered", """
SELECT claim_id, number FROM {lesson_repairs} WHERE number % 9 <> 0
UNION ALL SELECT claim_id, number FROM {lesson_adjacent} WHERE number % 6 = 0
UNION ALL SELECT claim_id, guard + 1000003 AS number FROM {lesson_claims} WHERE guard % 25 = 0
""")
COVERAGE = """
SELECT r.claim_id, r.number, 'missing_repair' AS coverage FROM {lesson_repairs} r
WHERE NOT EXISTS (SELECT 1 FROM {lesson_covered} c WHERE c.claim_id = r.claim_id AND c.number = r.number)
UNION ALL
SELECT DISTINCT c.claim_id, c.number, 'different_class' FROM {lesson_covered} c JOIN {lesson_adjacent} a ON a.claim_id = c.claim_id AND a.number = c.number
"""
LESSONS = f"""
WITH g AS (SELECT claim_id, count(*) FILTER (WHERE coverage = 'missing_repair') AS m, count(*) FILTER (WHERE coverage = 'different_class') AS d FROM ({COVERAGE}) v GROUP BY claim_id),
n AS (SELECT c.*, coalesce(r.n, 0) AS repairs, coalesce(g.m, 0) AS missing_coverage, coalesce(g.d, 0) AS different_class_coverage, coalesce(a.merged, false) AS merged
      FROM {{lesson_claims}} c LEFT JOIN (SELECT claim_id, count(DISTINCT number) AS n FROM {{lesson_repairs}} GROUP BY claim_id) r ON r.claim_id = c.claim_id
      LEFT JOIN g ON g.claim_id = c.claim_id
      LEFT JOIN {{artifacts}} a ON a.repository = c.repository AND a.kind = 'pull_request' AND a.number = c.guard)
SELECT claim_id, repairs, missing_coverage, different_class_coverage,
       CASE WHEN repairs < 2 THEN 'insufficient_repeated_repairs' WHEN guard_value_ref <> value_ref THEN 'guard_class_mismatch'
            WHEN different_class_coverage > 0 THEN 'guard_coverage_includes_different_class' WHEN missing_coverage > 0 THEN 'guard_coverage_incomplete'
            WHEN NOT merged THEN 'proposed_guard' ELSE 'observed_promotion' END AS status FROM n
"""


def _coverage(t):
    return cl.lesson_coverage(t("lesson_repairs"), t("lesson_adjacent"), t("lesson_covered"))


def _lesson_counts(t):
    return cl.lesson_counts(t("lesson_repairs"), t("lesson_adjacent"), t("lesson_covered"))


def _lessons(t):
    return cl.lesson_promotions(t("lesson_claims"), _lesson_counts(t), t("artifacts"))


@query("lesson_1_coverage", COVERAGE)
def _(t):
    return _coverage(t)


@query("lesson_1_promotions", LESSONS)
def _(t):
    return _lessons(t)


@query("lesson_2_violations", """
WITH p AS (SELECT * FROM {artifacts} WHERE kind = 'pull_request')
SELECT * FROM (
  SELECT r.claim_id, 'repair' AS role, r.number, CASE WHEN a.number IS NULL THEN 'artifact_absent' WHEN NOT a.merged THEN 'not_merged'
      WHEN NOT contains(a.evidence_text, r.source_evidence) THEN 'excerpt_absent' WHEN NOT contains(r.source_evidence, c.repair_marker) THEN 'marker_absent' END AS reason
  FROM {lesson_repairs} r JOIN {lesson_claims} c ON c.claim_id = r.claim_id LEFT JOIN p a ON a.repository = c.repository AND a.number = r.number
  UNION ALL
  SELECT r.claim_id, 'adjacent', r.number, CASE WHEN a.number IS NULL THEN 'artifact_absent' WHEN NOT a.merged THEN 'not_merged'
      WHEN NOT contains(a.evidence_text, r.source_evidence) THEN 'excerpt_absent' WHEN NOT contains(r.source_evidence, r.marker) THEN 'marker_absent' END
  FROM {lesson_adjacent} r JOIN {lesson_claims} c ON c.claim_id = r.claim_id LEFT JOIN p a ON a.repository = c.repository AND a.number = r.number
  UNION ALL
  SELECT c.claim_id, 'guard', c.guard, CASE WHEN a.number IS NULL THEN 'artifact_absent' WHEN NOT contains(a.evidence_text, c.guard_evidence) THEN 'excerpt_absent'
      WHEN NOT contains(c.guard_evidence, c.guard_marker) THEN 'marker_absent'
      WHEN NOT EXISTS (SELECT 1 FROM {artifact_paths} x WHERE x.repository = c.repository AND x.kind = 'pull_request' AND x.number = c.guard AND x.path = c.enforcement_path) THEN 'enforcement_path_unchanged' END
  FROM {lesson_claims} c LEFT JOIN p a ON a.repository = c.repository AND a.number = c.guard
  UNION ALL
  SELECT DISTINCT v.claim_id, 'covered', v.number, 'outside_predecessors' FROM {lesson_covered} v
  WHERE NOT EXISTS (SELECT 1 FROM {lesson_repairs} r WHERE r.claim_id = v.claim_id AND r.number = v.number)
    AND NOT EXISTS (SELECT 1 FROM {lesson_adjacent} r WHERE r.claim_id = v.claim_id AND r.number = v.number)) u
WHERE reason IS NOT NULL
""")
def _(t):
    return cl.lesson_violations(
        t("lesson_claims"), t("lesson_repairs"), t("lesson_adjacent"), t("lesson_covered"), t("artifacts"), t("artifact_paths")
    )


# Revisions: an artifact that closes a later number replaced the rule of that pull request.
adapter("proxy_claims", """
SELECT concat('p', CAST(number AS STRING)) AS claim_id, repository, number + CASE WHEN number % 16 = 5 THEN 15 ELSE 7 END AS predecessor, number AS successor,
       CASE WHEN number % 18 = 1 THEN 'nowhere.rs' ELSE 'src/shared.rs' END AS shared_path,
       CASE WHEN number % 22 = 1 THEN 'Summary' ELSE 'Summary of' END AS predecessor_evidence,
       CASE WHEN number % 16 = 3 THEN 'and' ELSE concat('Closes #', CAST(number + 7 AS STRING)) END AS counterexample_evidence,
       CASE WHEN number % 26 = 1 THEN 'Summary' WHEN number % 38 = 1 THEN 'not there' ELSE 'Summary of' END AS replacement_evidence,
       'of' AS proxy_marker, CASE WHEN number % 14 = 1 THEN 'Fixes' ELSE 'Closes' END AS counterexample_marker, 'of' AS replacement_marker
FROM {artifacts} WHERE number % 2 = 1
""")
PROXIES = """
WITH p AS (SELECT * FROM {artifacts} WHERE kind = 'pull_request'), q AS (SELECT * FROM {artifact_paths} WHERE kind = 'pull_request')
SELECT c.claim_id, CASE
    WHEN NOT coalesce(contains(a.evidence_text, c.predecessor_evidence) AND contains(b.evidence_text, c.counterexample_evidence) AND contains(b.evidence_text, c.replacement_evidence), false) THEN 'rejected'
    WHEN NOT a.merged THEN 'predecessor_unmerged' WHEN NOT b.merged THEN 'successor_unmerged'
    WHEN NOT contains(c.counterexample_evidence, concat('#', CAST(c.predecessor AS VARCHAR))) THEN 'successor_does_not_name_predecessor'
    WHEN NOT EXISTS (SELECT 1 FROM q WHERE q.repository = c.repository AND q.number = c.predecessor AND q.path = c.shared_path)
      OR NOT EXISTS (SELECT 1 FROM q WHERE q.repository = c.repository AND q.number = c.successor AND q.path = c.shared_path) THEN 'no_shared_implementation_path'
    WHEN NOT contains(c.predecessor_evidence, c.proxy_marker) THEN 'prior_proxy_rule_missing'
    WHEN NOT contains(c.counterexample_evidence, c.counterexample_marker) THEN 'counterexample_missing'
    WHEN NOT contains(c.replacement_evidence, c.replacement_marker) THEN 'replacement_rule_missing' ELSE 'observed_proxy_revision' END AS status
FROM {proxy_claims} c LEFT JOIN p a ON a.repository = c.repository AND a.number = c.predecessor LEFT JOIN p b ON b.repository = c.repository AND b.number = c.successor
"""


def _proxies(t):
    return cl.proxy_revisions(t("proxy_claims"), t("artifacts"), t("artifact_paths"))


@query("proxy_1_revisions", PROXIES)
def _(t):
    return _proxies(t)


adapter("reconciliation_claims", """
SELECT concat('q', CAST(a.number AS STRING), '-', p1) AS claim_id, a.repository, a.number + 7 AS predecessor, a.number AS reconciler,
       CASE WHEN a.number % 46 = 1 THEN 'Closes' ELSE concat('Closes #', CAST(a.number + 7 AS STRING)) END AS predecessor_evidence,
       CASE WHEN a.number % 22 = 1 THEN 'of' ELSE 'Summary of' END AS authority_evidence, CASE WHEN a.number % 26 = 1 THEN 'nowhere' ELSE 'Summary of' END AS observation_evidence,
       CASE WHEN a.number % 14 = 1 THEN 'of' ELSE 'Summary' END AS convergence_evidence, CASE WHEN a.number % 18 = 1 THEN 'Summary' ELSE 'Summary of' END AS exhaustion_evidence,
       'Summary' AS authority_marker, 'Summary' AS authoritative_marker, CASE WHEN a.number % 34 = 1 THEN 'lag' ELSE 'of' END AS lagging_marker,
       'Summary' AS convergence_marker, 'of' AS exhaustion_marker,
       CASE WHEN a.number % 58 = 1 THEN 'nowhere.rs' ELSE p1 END AS implementation_path, CASE WHEN a.number % 15 = 2 THEN 'nowhere.rs' ELSE p1 END AS test_path
FROM {artifacts} a JOIN (SELECT l_orderkey, min(path) AS p1 FROM {lineitem} JOIN {part_path} ON l_partkey = p_partkey GROUP BY l_orderkey) x ON x.l_orderkey + 1 = a.number
WHERE (a.number - 1) % 2 = 0
""")
RECONCILIATIONS = """
WITH p AS (SELECT * FROM {artifacts} WHERE kind = 'pull_request'), q AS (SELECT * FROM {artifact_paths} WHERE kind = 'pull_request')
SELECT c.claim_id, CASE
    WHEN a.number IS NULL OR NOT coalesce(contains(b.evidence_text, c.predecessor_evidence) AND contains(b.evidence_text, c.authority_evidence) AND contains(b.evidence_text, c.observation_evidence)
      AND contains(b.evidence_text, c.convergence_evidence) AND contains(b.evidence_text, c.exhaustion_evidence), false) THEN 'rejected'
    WHEN NOT a.merged THEN 'predecessor_unmerged' WHEN NOT b.merged THEN 'reconciler_unmerged'
    WHEN NOT contains(c.predecessor_evidence, concat('#', CAST(c.predecessor AS VARCHAR))) THEN 'reconciler_does_not_name_predecessor'
    WHEN NOT contains(c.authority_evidence, c.authority_marker) THEN 'authority_rule_missing'
    WHEN NOT (contains(c.observation_evidence, c.authoritative_marker) AND contains(c.observation_evidence, c.lagging_marker)) THEN 'divergent_observation_missing'
    WHEN NOT contains(c.convergence_evidence, c.convergence_marker) THEN 'convergence_policy_missing'
    WHEN NOT contains(c.exhaustion_evidence, c.exhaustion_marker) THEN 'permanent_divergence_control_missing'
    WHEN NOT EXISTS (SELECT 1 FROM q WHERE q.repository = c.repository AND q.number = c.reconciler AND q.path = c.implementation_path) THEN 'implementation_path_missing'
    WHEN NOT EXISTS (SELECT 1 FROM q WHERE q.repository = c.repository AND q.number = c.reconciler AND q.path = c.test_path) THEN 'test_path_missing'
    ELSE 'observed_reconciliation' END AS status
FROM {reconciliation_claims} c LEFT JOIN p a ON a.repository = c.repository AND a.number = c.predecessor LEFT JOIN p b ON b.repository = c.repository AND b.number = c.reconciler
"""


def _reconciliations(t):
    return cl.reconciliations(t("reconciliation_claims"), t("artifacts"), t("artifact_paths"))


@query("recon_1_reconciliations", RECONCILIATIONS)
def _(t):
    return _reconciliations(t)


adapter("proof_claims", """
SELECT concat('s', CAST(number AS STRING)) AS claim_id, repository, number AS subject,
       CASE WHEN number % 11 = 0 THEN 'missing text' ELSE 'Summary of' END AS behavior_evidence, CASE WHEN number % 13 = 0 THEN 'of' ELSE 'Summary' END AS requirement_evidence,
       CASE WHEN number % 17 = 0 THEN 'passed' ELSE 'of' END AS behavior_marker, 'Summary' AS requirement_marker,
       CASE WHEN number % 2 = 0 THEN 'pull_request_review' ELSE 'issue_conversation_comment' END AS required_kind, number * 3 AS event_id,
       concat('https://github.com/', repository, '/pull/', CAST(number AS STRING),
              CASE number % 5 WHEN 0 THEN '#pullrequestreview-' WHEN 1 THEN '#pullrequestreview-' WHEN 2 THEN '#issuecomment-' WHEN 3 THEN '#issuecomment-' ELSE '/files#r' END,
              CAST(number * 3 AS STRING)) AS event_url,
       CASE WHEN number % 5 < 2 THEN 'COMMENTED' WHEN number % 7 = 0 THEN 'APPROVED' END AS review_state,
       CASE WHEN number % 19 = 0 THEN 'other' ELSE 'the body' END AS event_body, 'body' AS body_marker
FROM {artifacts} WHERE kind = 'pull_request'
""")
PROOFS = """
WITH k AS (SELECT c.*, a.evidence_text, CASE WHEN event_url = concat('https://github.com/', c.repository, '/pull/', c.subject, '#pullrequestreview-', event_id) AND review_state = 'COMMENTED' THEN 'pull_request_review'
                     WHEN event_url = concat('https://github.com/', c.repository, '/pull/', c.subject, '#issuecomment-', event_id) AND review_state IS NULL THEN 'issue_conversation_comment' END AS produced_kind
           FROM {proof_claims} c LEFT JOIN {artifacts} a ON a.repository = c.repository AND a.kind = 'pull_request' AND a.number = c.subject)
SELECT claim_id, required_kind, produced_kind, CASE WHEN NOT coalesce(contains(evidence_text, behavior_evidence) AND contains(evidence_text, requirement_evidence), false) THEN 'rejected'
    WHEN NOT contains(behavior_evidence, behavior_marker) THEN 'behavior_evidence_missing' WHEN NOT contains(requirement_evidence, requirement_marker) THEN 'requirement_evidence_missing'
    WHEN NOT contains(event_body, body_marker) THEN 'provider_event_body_missing' WHEN produced_kind IS NULL THEN 'produced_artifact_unclassifiable'
    WHEN produced_kind = required_kind THEN 'proof_surface_matched' ELSE 'observed_proof_surface_mismatch' END AS status
FROM k
"""


def _proofs(t):
    return cl.proof_surfaces(t("proof_claims"), t("artifacts"))


@query("proof_1_surfaces", PROOFS)
def _(t):
    return _proofs(t)


def _front(t):
    """Every claim of every family meets the artifacts in one fold.

    What costs many shuffles of whole tables is written first, part by part, so that no more than one part's shuffles lie on disk.
    """
    parts = t.releasing()
    t.keep("artifacts", parts)
    t.keep("reconciliation_claims", parts)
    [paths] = kept_for(parts("artifact_paths").where(F.col("kind") == cl.PULL), "pull_paths", t.spark)
    [lessons] = kept_for(cl.lesson_rows(parts("lesson_claims"), _lesson_counts(parts), apart=False), "lesson_rows", t.spark)
    [episodes] = kept_for(_episodes(parts).select(
        F.concat_ws("/", "repository", F.col("prior_issue").cast("string"), F.col("later_issue").cast("string")).alias("id"),
        F.col("disposition").alias("status"), F.lit("issue_closure").alias("family"),
    ), "episodes", t.spark)
    reviews = _dispositions(t).select(F.col("concern_id").alias("id"), F.col("disposition").alias("status"), "matches")
    claims = cl.statuses(
        {
            "lesson_promotion": lessons,
            "proxy_revision": cl.proxy_rows(t("proxy_claims"), apart=False),
            "observation_reconciliation": cl.reconciliation_rows(t("reconciliation_claims"), apart=False),
            "proof_surface": cl.proof_rows(t("proof_claims"), apart=False),
        },
        t("artifacts"), paths,
    )
    return fr.episode_front(reviews, claims.select(F.col("claim_id").alias("id"), "status", "family").unionByName(episodes))


FRONT = f"""
SELECT concern_id AS id, 'review' AS family, disposition AS status,
       CASE WHEN disposition IN ('reuse_current_thread', 'refresh_existing_thread') OR (disposition = 'need_context' AND matches > 0) THEN 'item' ELSE 'quiet' END AS lane,
       CASE WHEN disposition = 'reuse_current_thread' THEN 'reuse_existing_review_thread' WHEN disposition = 'refresh_existing_thread' THEN 'recompute_and_refresh_review_thread'
            WHEN disposition = 'need_context' AND matches > 0 THEN 'acquire_missing_review_coordinate'
            WHEN matches > 0 THEN 'no_current_review_lineage' ELSE 'no_prior_review_lineage' END AS next
FROM ({DISPOSITIONS}) d
UNION ALL SELECT concat_ws('/', repository, prior_issue, later_issue), 'issue_closure', disposition, CASE WHEN rejection IS NULL THEN 'item' ELSE 'rejected' END,
       CASE WHEN rejection IS NULL THEN 'inspect_prior_failure_and_rereport' END FROM ({EPISODES}) e
UNION ALL SELECT claim_id, 'lesson_promotion', status, CASE WHEN status = 'observed_promotion' THEN 'item' ELSE 'rejected' END, CASE WHEN status = 'observed_promotion' THEN 'use_accepted_guard' END FROM ({LESSONS}) l
UNION ALL SELECT claim_id, 'proxy_revision', status, CASE WHEN status = 'observed_proxy_revision' THEN 'item' ELSE 'rejected' END, CASE WHEN status = 'observed_proxy_revision' THEN 'use_corrected_predicate' END FROM ({PROXIES}) p
UNION ALL SELECT claim_id, 'observation_reconciliation', status, CASE WHEN status = 'observed_reconciliation' THEN 'item' ELSE 'rejected' END, CASE WHEN status = 'observed_reconciliation' THEN 'await_bounded_convergence' END FROM ({RECONCILIATIONS}) r
UNION ALL SELECT claim_id, 'proof_surface', status, CASE WHEN status = 'observed_proof_surface_mismatch' THEN 'item' ELSE 'rejected' END, CASE WHEN status = 'observed_proof_surface_mismatch' THEN 'produce_required_proof_artifact' END FROM ({PROOFS}) s
"""


@query("front_1_episode_front", FRONT)
def _(t):
    return _front(t)


@query("front_2_episode_detail", f"""
SELECT c.claim_id, 'use_accepted_guard' AS next, c.discriminator, c.value_ref, c.repair_marker, c.guard, c.guard_marker, c.guard_evidence,
       c.enforcement_kind, c.enforcement_path, c.scope_ref, r.number AS repair
FROM {{lesson_claims}} c JOIN ({LESSONS}) l ON l.claim_id = c.claim_id AND l.status = 'observed_promotion' JOIN {{lesson_repairs}} r ON r.claim_id = c.claim_id
""")
def _(t):
    lessons = _lessons(t).select(F.col("claim_id").alias("id"), "status", F.lit("lesson_promotion").alias("family"))
    empty_reviews = _dispositions(t).select(F.col("concern_id").alias("id"), F.col("disposition").alias("status"), "matches")
    front = fr.episode_front(empty_reviews, lessons)
    return fr.episode_detail(front, t("lesson_claims"), t("lesson_repairs"))
