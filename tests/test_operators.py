import random

from conftest import rows
from pyspark.sql import functions as F

from sparkwitness.functions import identity, paths, references
from sparkwitness.operators import applicability, branches, ci, coordination, decisions, memory, packets, policy, promotion, refinement, reports, snapshots
from sparkwitness.operators import work as wk
from sparkwitness.plans.ordered import running_before
from sparkwitness.plans.scopes import overlap_join
from sparkwitness.sources import admission
from sparkwitness.sources import packets as source_packets


def frame(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


# Column functions


def test_canonical_paths(spark):
    good = ["a", "a/b.rs", ".a/..b", "é/x y"]
    bad = ["", "/a", "a/", "a//b", "./a", "a/../b", "a\\b", "a\x00b", "..", None]
    df = frame(spark, "p string", *[(p,) for p in good + bad])
    found = {r.p: r.ok for r in df.select("p", paths.is_canonical_path(F.col("p")).alias("ok")).collect()}
    assert all(found[p] for p in good) and not any(found[p] for p in bad)


def test_scope_is_component_wise(spark):
    df = frame(spark, "m string, s string, p string", ("prefix", "src", "src/a"), ("prefix", "src", "srcx"), ("exact", "src", "src/a"), ("prefix", "src", "src"))
    found = df.select(paths.scope_matches(F.col("m"), F.col("s"), F.col("p")).alias("ok"))
    assert [r.ok for r in found.collect()] == [True, False, False, True]


def test_relation_lines(spark):
    cases = {
        "Closes #1": "closes", " FIXED\t#2": "closes", "closes": None, "closes: #1": None, "Follow up to #3": "follow_up_to",
        "continuation from x": "continuation_from", "Deployment continuation": "continuation_from", "Parent:#4": "parent",
        "related: x": "related", "see related: x": None,
    }
    df = frame(spark, "s string", *[(c,) for c in cases])
    assert {r.s: r.r for r in df.select("s", references.relation_of(F.col("s")).alias("r")).collect()} == cases


def test_references_and_mentions_treat_the_character_before_differently(spark):
    df = frame(spark, "s string", ("#1 x#2 a.#3 (#4) #05 #6b #7",))
    row = df.select(
        references.refs(F.col("s")).alias("refs"),
        *[references.mentions(F.col("s"), F.lit(n)).alias(f"m{n}") for n in (2, 5, 7)],
    ).first()
    assert row.refs == [1, 4, 7] and (row.m2, row.m5, row.m7) == (True, False, True)


def _bag(spark, members, parts=2):
    df = frame(spark, "k string, m string", *[("k", m) for m in members]).repartition(parts)
    return identity.bag_digest(df, ["k"], F.col("m"), "v").first()


def test_bag_digest_sees_content_and_not_order(spark):
    import hashlib

    named = lambda s: [hashlib.sha256(c.encode()).hexdigest() for c in s]
    base = _bag(spark, named("abc"), 1)
    assert base == _bag(spark, named("cab"), 3) == _bag(spark, named("abc") + [None])
    others = [_bag(spark, named(s)) for s in ("ab", "abd", "abcc")]
    assert len({base.digest, *[o.digest for o in others]}) == 4 and others[2].members == 4
    assert _bag(spark, [None]) is None


def test_bags_of_equal_sums_differ(spark):
    """Members whose digits add up to the same sums, word by word."""
    of = lambda *tails: _bag(spark, ["0" * 63 + t for t in tails]).digest
    assert len({of("0", "3"), of("1", "2"), of("3"), of("1", "1", "1")}) == 4
    spread = lambda *heads: _bag(spark, [h + "0" * 57 for h in heads]).digest
    assert spread("0000010", "0000030") != spread("0000020", "0000020")


def test_bag_digest_is_the_stated_tree(spark):
    import hashlib
    import random

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    choice = random.Random(2)
    members = ["".join(choice.choice("01") for _ in range(64)) for _ in range(300)]
    level = [(m, m) for m in members]
    for digits in (6, 3):
        groups = {}
        for head, item in level:
            groups.setdefault(head[:digits], []).append(item)
        level = [(head, sha(head + ":" + ",".join(sorted(items)))) for head, items in groups.items()]
    assert _bag(spark, members).digest == sha("v|300|" + ",".join(sorted(item for _, item in level)))


def test_branch_inventory_counts_what_the_limit_leaves_out(spark):
    refs = frame(spark, "repository string, branch string", ("r", "a"), ("r", "b"), ("r", "c"), ("r", "open"), ("q", "a"), ("p", "open"))
    heads = frame(spark, "repository string, branch string", ("r", "open"), ("p", "open"))
    found = rows(branches.branch_inventory(refs, heads, limit=2), "repository", "candidates", "selected", "omitted")
    assert found == [("p", 0, 0, 0), ("q", 1, 1, 0), ("r", 3, 2, 1)]


def test_framing_separates_null_from_empty_and_shifts(spark):
    df = frame(spark, "a string, b string", ("ab", "c"), ("a", "bc"), ("", None), (None, ""))
    assert df.select(identity.digest(F.col("a"), F.col("b")).alias("d")).distinct().count() == 4


# Plans


def test_running_prefix_over_blocks_equals_one_window(spark):
    choice = random.Random(3)
    data = [("hot" if choice.random() < 0.7 else f"g{choice.randint(0, 5)}", i, choice.randint(0, 50)) for i in range(500)]
    df = frame(spark, "g string, i long, v long", *data)
    for combine, of in [(F.sum, sum), (F.max, max)]:
        found = running_before(df, ["g"], F.floor(F.col("i") / 16), [F.col("i")], F.col("v"), combine, "before")
        for r in found.collect():
            earlier = [v for g, i, v in data if g == r.g and i < r.i]
            assert r.before == (of(earlier) if earlier else None)


def test_overlap_join_equals_the_symmetric_predicate(spark):
    names = ["a", "a/b", "a/b/c", "ab", "a/bc", "d/e", "d"]
    left = frame(spark, "k int, l string", *[(1, n) for n in names])
    right = frame(spark, "k int, r string", *[(1, n) for n in names])
    covers = lambda x, y: x == y or y.startswith(x + "/")
    expected = sorted((x, y) for x in names for y in names if covers(x, y) or covers(y, x))
    assert rows(overlap_join(left, right, ["k"], "l", "r"), "l", "r") == expected


# Applicability

EVIDENCE = "evidence_id string, context_set string, repository string, revision string, work string, scope_mode string, scope_path string"
CONTEXT = "context_set string, context_id string, repository string, revision string, work string, path string"


def _status(spark, evidence, context):
    e = frame(spark, EVIDENCE, ("e", "s", *evidence))
    c = frame(spark, CONTEXT, ("s", "c", *context))
    return applicability.applicability(e, c).first().status


def test_mismatch_beats_missing(spark):
    assert _status(spark, ("r", "v", None, None, None), ("r", "v", None, None)) == "applies"
    assert _status(spark, ("r", "v", None, None, None), ("x", None, None, None)) == "invalid"
    assert _status(spark, ("r", "v", None, None, None), ("r", None, None, None)) == "unknown"
    assert _status(spark, (None, None, None, "prefix", "src"), ("r", None, None, "srcs/a")) == "invalid"
    assert _status(spark, (None, None, None, "prefix", "src"), ("r", None, None, None)) == "unknown"
    assert _status(spark, (None, None, None, None, None), ("r", "v", "w", "p")) == "rejected"


def test_irrelevant_coordinates_do_not_change_a_status(spark):
    requirement = (None, "v", None, None, None)
    assert _status(spark, requirement, ("r", "v", "w", "p")) == _status(spark, requirement, (None, "v", None, None)) == "applies"


# Refinement

OBS = "cohort_id string, outcome string, facts map<string,string>"


def _refine(spark, data, current, min_support=3):
    observations = frame(spark, OBS, *[("c", o, f) for o, f in data])
    asked = frame(spark, "cohort_id string, discriminator string", ("c", "d"))
    now = frame(spark, "cohort_id string, facts map<string,string>", ("c", current))
    return refinement.evaluate_refinements(observations, asked, now, min_support).first().status


def test_refinement_statuses(spark):
    good = [("support", {"d": "a"})] * 99
    assert _refine(spark, good + [("counterexample", {"d": "b"})], {"d": "a"}) == "candidate"
    assert _refine(spark, [("support", {"d": "a"})] * 94 + [("counterexample", {"d": "a"})] * 6, {"d": "a"}) == "no_improvement"
    assert _refine(spark, good + [("counterexample", {})], {"d": "a"}) == "incomplete_evidence"
    assert _refine(spark, good + [("counterexample", {"d": "b"})], {}) == "unknown_current"
    assert _refine(spark, good + [("counterexample", {"d": "b"})], {"d": "z"}) == "unknown_current"
    assert _refine(spark, [("support", {"d": "a"})] * 2 + [("counterexample", {"d": "b"})], {"d": "a"}) == "overfit"
    same_rate = ([("support", {"d": "a"}), ("counterexample", {"d": "a"})] + [("support", {"d": "b"}), ("counterexample", {"d": "b"})]) * 5
    assert _refine(spark, same_rate, {"d": "a"}) == "no_improvement"


# Coordination


def _brute_targets(body):
    fence, found = None, []
    for raw in body.split("\n"):
        line = raw.rstrip("\r")
        indent = len(line) - len(line.lstrip(" "))
        content = line[indent:] if indent <= 3 else None
        run = 0
        if content and content[0] in "`~":
            run = len(content) - len(content.lstrip(content[0]))
        if fence:
            mark, width = fence
            closing = 0 if content is None else len(content) - len(content.lstrip(mark))
            if content is not None and closing >= width and content[closing:].strip() == "":
                fence = None
            continue
        if run >= 3:
            fence = (content[0], run)
            continue
        prefix = "Do not merge while #"
        if line.startswith(prefix):
            rest = line[len(prefix):]
            digits = rest[: len(rest) - len(rest.lstrip("0123456789"))]
            tail = rest[len(digits):]
            if digits and digits[0] != "0" and tail.startswith(" ") and tail.strip():
                found.append("#" + digits)
    return found


def test_hold_clauses_honour_fences(spark):
    choice = random.Random(11)
    pool = [
        "Do not merge while #7 is open", "Do not merge while #8 ", "Do not merge while #09 x", "  Do not merge while #7 x", "```", "````", "~~~",
        "   ```rust", "    ```", "``` x", "~~~~  ", "text", "", "Do not merge while #3 lands\r", "``", "`````\r",
    ]
    bodies = [(f"#{i + 100}", "\n".join(choice.choice(pool) for _ in range(choice.randint(1, 14)))) for i in range(150)]
    df = frame(spark, "snapshot_id string, id string, source string, body string", *[("s", i, "src", b) for i, b in bodies])
    found = coordination.hold_clauses(df)
    assert rows(found, "from_id", "to_id") == sorted(((i, t) for i, b in bodies for t in _brute_targets(b)), key=repr)


def test_self_is_by_id_in_one_rule_and_by_head_in_the_other(spark):
    items = frame(spark, "snapshot_id string, id string, head_sha string, activity string", ("s", "#1", "h", "confirmed_active"), ("s", "#2", "h", "unresolved"))
    touched = frame(spark, "snapshot_id string, id string, path string", ("s", "#1", "a"), ("s", "#2", "a"))
    current = frame(spark, "snapshot_id string, id string", ("s", "#1"))
    overlaps = wk.inventory_overlap(items, touched, current)
    assert rows(overlaps, "other_id", "finding_kind") == [("#2", "path_overlap_activity_unknown")]
    focus = frame(spark, "snapshot_id string, path string", ("s", "b"))
    assert wk.heads_up(items, touched, focus, current).count() == 0


def test_several_currents_of_a_snapshot_are_kept_apart(spark):
    items = frame(spark, "snapshot_id string, id string, head_sha string, activity string", *[("s", f"#{i}", f"h{i}", "preparation") for i in range(200)])
    touched = frame(spark, "snapshot_id string, id string, path string", ("s", "#1", "a"), ("s", "#2", "b"), *[("s", f"#{i}", "a") for i in range(3, 150)], ("s", "#150", "b"))
    current = frame(spark, "snapshot_id string, id string", ("s", "#1"), ("s", "#2"), ("s", "#199"))
    focus = frame(spark, "snapshot_id string, path string", ("s", "b"))
    found = wk.heads_up(items, touched, focus, current, limit=3)
    # 1 meets 147 on a, and 2 and 150 on its focus b; 2 meets 150 on b; 199 meets 2 and 150 by its focus alone.
    assert rows(found, "current_id", "other_id", "rank", "omitted") == sorted([
        ("#1", "#10", 1, 146), ("#1", "#100", 2, 146), ("#1", "#101", 3, 146), ("#2", "#150", 1, 0), ("#199", "#150", 1, 0), ("#199", "#2", 2, 0)], key=repr)
    assert rows(wk.has_overlap(touched, current), "current_id", "overlaps") == [("#1", True), ("#199", False), ("#2", True)]
    counted = wk.inventory_counts(items, current, wk.inventory_overlap(items, touched, current))
    assert rows(counted, "current_id", "direct_overlaps") == [("#1", 147), ("#199", 0), ("#2", 1)]


def test_quiet_pairs_stay(spark):
    a = frame(spark, "a string, path string", ("x", "p"), ("x", "q"))
    b = frame(spark, "b string, path string", ("y", "q"), ("z", "r"))
    pairs = frame(spark, "pair_id int, a string, b string", (1, "x", "y"), (2, "x", "z"), (3, "x", "none"))
    found = wk.change_overlap(a, b, pairs)
    assert rows(found, "pair_id", "size_a", "size_b", "path") == [(1, 2, 1, "q"), (2, 2, 1, None), (3, 2, 0, None)]


# Policy


def _brute_pairs(events):
    held, out = [], []
    for session, seq, action, guard, resource in sorted(events, key=lambda e: e[1]):
        if action == "release":
            held = [h for h in held if h[0] != guard]
        else:
            if held:
                out.append((session, seq, held[-1][1], resource))
            held.append((guard, resource))
    return out


def test_held_pairs_equal_a_walk_for_any_block_size(spark):
    choice = random.Random(7)
    events = []
    for session in ("hot", "cold"):
        for seq in range(400 if session == "hot" else 15):
            action = "release" if choice.random() < 0.35 else "acquire"
            events.append((session, seq, action, f"g{choice.randint(0, 4)}", f"r{choice.randint(0, 3)}"))
    df = frame(spark, "session string, seq long, action string, guard string, resource string", *events)
    expected = sorted((p for s in ("hot", "cold") for p in _brute_pairs([e for e in events if e[0] == s])), key=repr)
    for block, fan in ((1, 4), (8, 3), (1000, 1000)):
        assert rows(policy.held_pairs(df, block, fan), "session", "seq", "held", "acquired") == expected


def test_effects_at_any_position_stand_between_their_neighbours(spark):
    """A call hands back more effects than any fixed stride has room for."""
    deep = 70_000
    effects = spark.range(deep).select(F.lit("h").alias("helper"), F.col("id").alias("position"), F.concat(F.lit("e"), F.col("id") % 3).alias("resource"))
    effects = effects.union(frame(spark, "helper string, position long, resource string", ("h", deep, "last")))
    events = frame(
        spark, "session string, seq long, action string, guard string, resource string",
        ("s", 1, "acquire", "a", "r1"), ("s", 2, "call", "b", "h"), ("s", 3, "acquire", "c", "r2"), ("s", 4, "release", "b", None),
        ("s", 5, "acquire", "d", "r3"), ("s", 6, "call", "x", "unknown"), ("s", 7, "acquire", "e", "r1"),
    )
    expanded = policy.expand_effects(events, effects)
    assert expanded.count() == 5 + deep + 1
    # Only the effects at both ends, so that the block stays small: their order is what counts.
    few = expanded.where("origin = 'direct' OR position < 2 OR position >= 70000 - 1")
    found = rows(policy.held_pairs(few, block=2, fan=2), "seq", "position", "held", "acquired")
    assert found == [(2, 0, "r1", "e0"), (2, 1, "e0", "e1"), (2, 69_999, "e1", "e0"), (2, 70_000, "e0", "last"), (3, 0, "last", "r2"), (5, 0, "r2", "r3"), (7, 0, "r3", "r1")]


# Lineage


def test_file_lineage_is_whole_and_survives_cycles(spark):
    steps = [("r", f"p{i + 1}", f"p{i}") for i in range(40)] + [("r", "y", "x"), ("r", "x", "y"), ("q", "other", "p0")]
    renames = frame(spark, "repository string, old_path string, new_path string", *steps)
    targets = frame(spark, "repository string, target string", ("r", "p0"), ("r", "p39"), ("r", "x"), ("r", "none"))
    found = decisions.file_lineage(renames, targets)
    expected = [("r", "p0", f"p{i}") for i in range(1, 41)] + [("r", "p39", "p40"), ("r", "x", "y")]
    assert rows(found, "repository", "target", "historical_path") == sorted(expected, key=repr)


def test_a_thousand_steps_take_ten_rounds_and_leave_nothing_behind(spark):
    from pathlib import Path

    from sparkwitness.plans.durable import shared_folder

    steps = [("r", f"p{i + 1}", f"p{i}") for i in range(1000)]
    dead = [("r", f"p{0}", f"front{k}") for k in range(3)] + [("r", f"front{k}", f"far{k}") for k in range(3)]
    other = [("q", f"p{i + 1}", f"p{i}") for i in range(300)]
    renames = frame(spark, "repository string, old_path string, new_path string", *steps, *dead, *other)
    told = []
    before = set(Path(shared_folder(spark)).glob("lineage-*"))
    found = decisions.file_lineage(renames, frame(spark, "repository string, target string", ("r", "p0")), lambda *a: told.append(a))
    assert sorted(r.historical_path for r in found.collect()) == sorted(f"p{i}" for i in range(1, 1001))
    assert len(told) == 10 and told[-1][1:] == (1001, 0)
    assert told[0][2] <= 1003  # nothing of the other repository is ever joined
    left = set(Path(shared_folder(spark)).glob("lineage-*")) - before
    assert len(left) == 1  # the result; no round before it


def test_a_hub_expands_once(spark):
    """Anchor 1 reaches the hub directly and again through 2; the hub links to 10,000 artifacts and back."""
    links = [("r", 1, 5), ("r", 1, 2), ("r", 2, 5), ("r", 5, 1)] + [("r", 5, n) for n in range(10, 10_010)] + [("r", n, 5) for n in range(10, 40)]
    edges = frame(spark, "repository string, from_number long, to_number long", *links)
    anchors = frame(spark, "repository string, number long", ("r", 1), ("r", None))
    found = memory.lineage(edges, anchors.where("number IS NOT NULL"), 3)
    depths = {r.number: r.depth for r in found.collect()}
    assert depths == {1: 0, 2: 1, 5: 1} | {n: 2 for n in range(10, 10_010)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 3 and plan.count("LogicalRDD") == 4  # links once per level, anchors once


def test_lineage_keeps_the_smallest_depth(spark):
    edges = frame(spark, "repository string, from_number long, to_number long", ("r", 1, 2), ("r", 2, 3), ("r", 1, 3), ("r", 3, 4), ("r", 4, 5), ("r", 3, 1))
    anchors = frame(spark, "repository string, number long", ("r", 1))
    assert rows(memory.lineage(edges, anchors, 2), "number", "depth") == [(1, 0), (2, 1), (3, 1), (4, 2)]


# Packets


def test_packing_equals_evicting_one_by_one(spark):
    choice = random.Random(2)
    data = [(t, choice.choice(packets.KEEP_ORDER), i, choice.randint(1, 30)) for t in ("a", "b") for i in range(120)]
    df = frame(spark, "target string, class string, rank long, bytes long", *data)
    for budget in (0, 200, 900, 10_000):
        found = packets.pack_evidence(df, frame(spark, "target string, budget long", ("a", budget), ("b", budget)))
        kept = {(r.target, r["class"], r.rank): r.kept for r in found.collect()}
        for target in ("a", "b"):
            left = sorted((r for r in data if r[0] == target), key=lambda r: (packets.KEEP_ORDER.index(r[1]), r[2]))
            core = [r for r in left if r[1] == "core"]
            while sum(r[3] for r in left) > budget and len(left) > len(core):
                left.pop()
            fits = sum(r[3] for r in core) <= budget
            for r in (r for r in data if r[0] == target):
                assert kept[r[:3]] == ((r in left) if fits else None)


# Admission

PACKET = "struct<schema_version:int,items:array<struct<id:string,at:struct<path:string>>>>"


def test_unknown_fields_are_rejected_at_every_level(spark):
    from pyspark.sql.types import _parse_datatype_string

    texts = {
        '{"schema_version":1,"items":[{"id":"a","at":{"path":"p"}}]}': None,
        '{"schema_version":1}': None,
        '{"schema_version":1,"more":1}': "unknown_field",
        '{"schema_version":1,"items":[{"id":"a"},{"id":"b","more":null}]}': "unknown_field",
        '{"schema_version":1,"items":[{"id":"a","at":{"path":"p","more":[]}}]}': "unknown_field",
        '{"schema_version":2}': "unsupported_schema_version",
        "{}": "unsupported_schema_version",
        "nothing": "malformed",
    }
    df = frame(spark, "raw string", *[(t,) for t in texts])
    found = admission.admit(df, "raw", _parse_datatype_string(PACKET), 1)
    assert {r.raw: r.reason for r in found.collect()} == texts


def test_duplicates_and_conflicts(spark):
    df = frame(spark, "id string, a string, b string", ("1", "x", "y"), ("1", "x", "y"), ("2", "x", None), ("2", None, "x"), ("3", "z", "z"))
    assert rows(admission.duplicate_ids(df, ["id"]), "id", "rows", "kind") == [("1", 2, "duplicate"), ("2", 2, "conflicting")]


# Workflow filters


def test_filters_of_workflow_lines(spark):
    cases = {
        "- run: cargo test --lib name": "name",
        "  cargo +nightly test --features 'a b' x --lib": None,
        "run: cargo test --lib 'quoted_one' -- --nocapture": "quoted_one",
        "cargo test --lib a b": None,
        "cargo test --lib -p core a": None,
        "cargo test a": None,
        "cargo test --lib mod::a": None,
        "cargo test --lib a --jobs": None,
        "cargo test --jobs 4 a -q --lib": "a",
        "cargo +bad! test --lib a": None,
        "# cargo test --lib a": None,
        "cargo test --lib a \\": None,
        "cargo test -- --lib a": None,
    }
    df = frame(spark, "text string", *[(c,) for c in cases]).withColumns({"repository": F.lit("r"), "path": F.lit("w"), "line": F.lit(1)})
    found = {r.filter for r in ci.ci_commands(df).collect()}
    assert found == {v for v in cases.values() if v}
    per_line = {r.text: r.f for r in df.select("text", ci.lib_test_filter(ci.shell_line(F.col("text"))).alias("f")).collect()}
    assert per_line == cases


# Promotion and identity


def test_first_branch_of_the_ladder_wins(spark):
    schema = (
        "promotion_id string, conflict boolean, mergeable boolean, tested_change_set string, current_change_set string, tested_merge_tree string, "
        "current_merge_tree string, tested_base_tree string, current_base_tree string, scope_complete boolean"
    )
    p = frame(
        spark, schema, ("1", True, False, "a", "b", "m", "m", "t", "t", True), ("2", False, False, "a", "b", "m", "m", "t", "t", True),
        ("3", False, True, "a", "b", "m", "m", "t", "t", True), ("4", False, True, "a", "a", "m", "m", "t", "t", True),
        ("5", False, True, "a", "a", "m", "n", "t", "t", True), ("6", False, True, "a", "a", "m", "n", "t", "u", True),
        ("7", False, True, "a", "a", "m", "n", "t", "u", True), ("8", False, True, "a", "a", "m", "n", "t", "u", False),
    )
    overlaps = frame(spark, "promotion_id string, kind string", ("6", "applicable_policy"), ("6", "branch_path"), ("4", "branch_path"))
    found = {r.promotion_id: (r.disposition, r.reasons) for r in promotion.promotion_receipts(p, overlaps).collect()}
    assert [found[k][1] for k in sorted(found)] == [
        ["merge_conflict"], ["not_mergeable"], ["change_set_changed"], ["exact_effective_merge_tree_identity"],
        ["equivalent_change_set_same_base_tree"], ["branch_path_overlap", "applicable_policy_overlap"],
        ["complete_compatibility_scope_no_relevant_change"], ["semantic_independence_unknown"],
    ]
    assert [found[k][0] for k in sorted(found)] == ["rerun_required"] * 3 + ["receipt_reusable"] * 2 + ["rerun_required", "receipt_reusable", "inspect_semantic_overlap"]


def _work_identity(spark, items, touched, edges):
    return snapshots.work_fact_identity(
        frame(spark, "snapshot_id string, id string, head_sha string, activity string", *items),
        frame(spark, "snapshot_id string, id string, path string", *touched),
        frame(spark, "snapshot_id string, kind string, from_id string, to_id string, source string", *edges),
    ).first().work_fact_identity


def test_work_identity_ignores_order_case_and_provenance(spark):
    items, touched = [("s", "1", "ab", "preparation"), ("s", "2", "cd", "unresolved")], [("s", "1", "p"), ("s", "1", "q")]
    edge = [("s", "blocks", "1", "2", "x")]
    base = _work_identity(spark, items, touched, edge)
    assert base == _work_identity(spark, [("s", "2", "CD", "unresolved"), ("s", "1", "AB", "preparation")], touched[::-1], [("s", "blocks", "1", "2", "y"), *edge])
    changed = [
        _work_identity(spark, items, touched[:1], edge), _work_identity(spark, items, touched, [("s", "blocks", "2", "1", "x")]),
        _work_identity(spark, [items[0], ("s", "2", "cd", "preparation")], touched, edge),
    ]
    assert base not in changed and len(set(changed)) == 3


def test_report_fingerprint_depends_on_order_and_content(spark):
    def of(order, note="n"):
        df = frame(spark, "report string, position int, name string", *[("r", i, n) for i, n in enumerate(order)])
        nested = reports.findings(
            df, ["report", "position"], F.lit("k"), F.col("name"), reports.location(F.col("name"), F.lit(1)),
            [reports.claim("proven", F.lit(note), reports.evidence(F.col("name")))],
        )
        return reports.report_fingerprint(nested, ["report"], "position").first().fingerprint

    assert of("ab") == of("ab") and len({of("ab"), of("ba"), of("ab", "m")}) == 3


def test_report_sink_round_trips(spark, tmp_path):
    df = frame(spark, "repository string, name string", ("r", "a"), ("q", "b"))
    nested = reports.findings(
        df, ["repository"], F.lit("k"), F.col("name"), reports.location(F.col("name")),
        [reports.claim("observed", F.lit("m"), reports.evidence(F.lit("e"), reports.location(F.col("name")))), reports.claim("unknown", F.lit("u"))],
    )
    source_packets.write_report(nested, str(tmp_path / "out"))
    back = source_packets.read_packets(spark, str(tmp_path / "out"), nested.schema, multiline=False)
    flat = lambda d: rows(reports.flatten(d, ["repository"]))
    assert flat(back) == flat(nested) and len(flat(back)) == 4


def test_rows_of_claims_that_name_nothing_are_dealt_by_claim(spark):
    from sparkwitness.operators import claims as cl

    claims = frame(spark, "claim_id string, repository string, subject long, behavior_evidence string, requirement_evidence string, behavior_marker string, "
                   "requirement_marker string, required_kind string, event_id long, event_url string, review_state string, event_body string, body_marker string",
                   *[(f"c{i}", "r", i, "x", "x", "x", "x", "k", i, "u", None, "b", "b") for i in range(50)])
    own = cl._homed(cl.proof_rows(claims)).where("number IS NULL")
    assert own.count() == own.select("_home").distinct().count() == 50
    # A claim named like a repository meets nothing of it.
    artifacts = frame(spark, "repository string, kind string, number long, merged boolean, evidence_text string", *[("r", "pull_request", i, True, "x") for i in range(25)], ("c1", "pull_request", None, True, ""))
    found = {r.claim_id: r.status for r in cl.proof_surfaces(claims, artifacts).collect()}
    assert len(found) == 50 and all(found[f"c{i}"] == ("produced_artifact_unclassifiable" if i < 25 else "rejected") for i in range(50))


def test_local_names_of_one_file_are_many_keys(spark):
    from sparkwitness.operators import conventions

    facts = frame(spark, "repository string, path string, name string, line long", *[("r", "f", f"n{i % 40}", i) for i in range(200)], ("r", "g", "n0", 1))
    found = conventions.precedent_local_names(facts, facts)
    assert rows(found.select("line", "name", "local_name")) == sorted([(i, f"n{i % 40}", f"n{k}") for i in range(200) for k in range(40) if k != i % 40], key=repr)
    assert "_part" in found._jdf.queryExecution().optimizedPlan().toString()


def test_small_bags_take_one_shuffle_and_have_the_tree_s_root(spark, monkeypatch):
    """both ways give the same digests, for members that share nodes of the tree and for those that do not."""
    # Members are given as digests; the first digits decide which nodes they share.
    data = [(f"k{k}" if k else None, f"{(i * (k % 3)) % 7:06x}{i:058x}" if k % 2 else f"{(i * 4129) % 16**6:06x}{i:058x}") for k in range(12) for i in range(k * 3 + 1)]
    given = frame(spark, "k string, m string", *data, ("k3", None), ("empty", None))
    found = {None: rows(identity.bag_digest(given, ["k"], F.col("m"), "v/1"), "k", "digest", "members")}
    for limit in (0, 5, 64):
        monkeypatch.setattr(identity, "SMALL_BAG", limit)
        bags = identity.bag_digest(given, ["k"], F.col("m"), "v/1", mostly_small=True)
        found[limit] = rows(bags, "k", "digest", "members")
    assert found[None] == found[0] == found[5] == found[64] and len(found[0]) == 12
    small = identity._small_roots(given.withColumnRenamed("m", "_item"), ["k"])
    small.collect()
    assert small._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_first_earlier_path_is_found_before_decisions_multiply(spark):
    """decisions of one prefix meet a target's earlier paths once."""
    renames = frame(spark, "repository string, old_path string, new_path string", *[("r", f"old/f{i + 1:02d}", f"old/f{i:02d}" if i else "src/a") for i in range(20)])
    targets = frame(spark, "repository string, target string", ("r", "src/a"))
    named = [("r", f"d{i}", "old") for i in range(30)] + [("r", "d0", "old"), ("r", "deep", "old/f07"), ("r", "s", "src"), ("q", "x", "old")]
    found = decisions.decisions_via_lineage(frame(spark, "repository string, decision_id string, path_prefix string", *named), targets, renames)
    expected = [(f"d{i}", "old", "git_file_lineage", "old/f01") for i in range(30)] + [("deep", "old/f07", "git_file_lineage", "old/f07"), ("s", "src", "direct", "src/a")]
    assert rows(found, "decision_id", "path_prefix", "matched_via", "matched_path") == sorted(expected, key=repr)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "min(historical_path" in plan and not any("decision_id" in line and "min(historical_path" in line for line in plan.splitlines())


def test_large_packet_parts_are_many_files(spark, tmp_path):
    """every run is a whole array; the files together hold the documents once."""
    from sparkwitness.catalog.changes import packet_runs

    docs = [(k % 2, k, f'{{"document_id":"{k}",\n "x": 1}},') for k in range(200)]
    given = frame(spark, "part long, place long, value string", *docs, *[(p, -1 - 200, "[") for p in (0, 1)], *[(p, 300, "{}]") for p in (0, 1)])
    lines = packet_runs(given, 5).repartition("part", "run").sortWithinPartitions("part", "run", "place")
    lines.select("value", "part", "run").write.partitionBy("part", "run").text(str(tmp_path / "p"))
    back = source_packets.read_packets(spark, str(tmp_path / "p"), "document_id string, x int").where("document_id IS NOT NULL")
    assert len(back.inputFiles()) == 10 and rows(back, "document_id", "x") == sorted([(str(k), 1) for k in range(200)], key=repr)
