from conftest import rows
from pyspark.sql import functions as F

from sparkwitness.operators import history as op
from sparkwitness.sources import commit_log, diffs

COMMIT = "repository string, sha string, log_pos long, subject string, is_merge boolean"
PATH = "repository string, sha string, path string"


def _history(spark, supported, total):
    commits = [("r", f"c{i:03}", i, "Change", False) for i in range(total)]
    paths = [("r", f"c{i:03}", "a.rs") for i in range(total)]
    paths += [("r", f"c{i:03}", "b.rs") for i in range(total) if i not in supported]
    return spark.createDataFrame(commits, COMMIT), spark.createDataFrame(paths, PATH)


def test_support_of_99_in_100_keeps_its_counterexample(spark):
    commits, paths = _history(spark, {41}, 100)
    cohort = op.anchor_cohort(commits, paths, spark.createDataFrame([("r", "a.rs")], "repository string, anchor string"))
    found = op.companions(cohort, paths).collect()
    assert [(r.path, r.support, r.opportunities, r.support_percent) for r in found] == [("b.rs", 99, 100, 99.0)]
    assert found[0].examples == ["c000", "c001", "c002"] and found[0].counterexamples == ["c041"]


def test_both_directions_differ(spark):
    commits, paths = _history(spark, set(), 94)
    more = [("r", f"d{i}", 100 + i, "Change", False) for i in range(6)]
    commits = commits.union(spark.createDataFrame(more, COMMIT))
    paths = paths.union(spark.createDataFrame([("r", f"d{i}", "b.rs") for i in range(6)], PATH))
    found = op.directional_pairs(op.companions(op.anchor_cohort(commits, paths), paths))
    assert rows(found, "anchor", "support_percent", "reverse_percent") == [("a.rs", 100.0, 94.0), ("b.rs", 94.0, 100.0)]


def test_limit_applies_before_exclusion(spark):
    log = [("r", "s0", 0, "  Revert it", False), ("r", "s1", 1, "merge", True), ("r", "s2", 2, "x", False), ("r", "s3", 3, "y", False)]
    commits = spark.createDataFrame(log, COMMIT)
    paths = spark.createDataFrame([("r", f"s{i}", "a") for i in range(4)] + [("r", "s2", "b")], PATH)
    cohort = op.anchor_cohort(commits, paths, max_commits=2, max_paths=1).where("anchor = 'a'")
    assert rows(cohort, "sha", "considered", "reason") == [("s0", False, "revert"), ("s2", False, "broad")]


def test_row_order_and_partitioning_do_not_matter(spark):
    commits, paths = _history(spark, {3, 7, 8, 9, 20}, 40)
    once = rows(op.companions(op.anchor_cohort(commits.repartition(1), paths.repartition(1)), paths))
    again = op.companions(op.anchor_cohort(commits.orderBy(F.desc("sha")).repartition(8), paths.orderBy(F.rand(1)).repartition(7)), paths)
    assert rows(again) == once


def test_hot_path_is_pruned_before_the_shuffle(spark):
    commits, paths = _history(spark, set(), 50)
    plan = op.anchor_cohort(commits, paths, max_commits=5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_common_directory_needs_two_paths(spark):
    data = [("t", "a/b/x"), ("t", "a/b/c/y"), ("u", "a/x"), ("v", "a/x"), ("v", "b/x"), ("w", "x"), ("w", "y")]
    found = op.common_directory(spark.createDataFrame(data, "task string, path string"))
    assert rows(found, "task", "scope") == [("t", "a/b"), ("u", None), ("v", None), ("w", None)]


def test_common_directory_explodes_no_paths_and_knows_odd_ones(spark):
    data = [("t", "a/b/x"), ("t", "a/bc/x"), ("u", "/a/x"), ("u", "/b"), ("v", "é/x/1"), ("v", "é/x/2"), ("v", "é/x/2"), ("n", None), ("n", "a/x"), ("o", "a/b"), ("o", "a/b/c")]
    found = op.common_directory(spark.createDataFrame(data, "task string, path string"))
    assert rows(found, "task", "scope", "paths") == sorted([("t", "a", 2), ("u", "", 2), ("v", "é/x", 2), ("n", None, 2), ("o", "a", 2)], key=repr)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_marker_only_counts_in_the_header(spark):
    late = "\n".join(["x"] * 40 + ["@generated"])
    wide = "é" * 5000 + "\n@generated"
    data = [("r", "a", "\n  // DO NOT EDIT  \n@generated"), ("r", "b", late), ("r", "c", wide)]
    found = op.generated_markers(spark.createDataFrame(data, "repository string, path string, content string"))
    assert rows(found, "path", "line", "marker") == [("a", 2, "// DO NOT EDIT")]


def test_log_positions_are_exact_over_many_splits(spark, tmp_path):
    for repo, count in [("one", 3000), ("two", 700)]:
        records = "".join(f"\x1esha{i}\x1f2024-01-01T00:00:00Z\x1fSubject {i}\n\nsrc/{i % 7}.rs\nsrc/{i % 7}.rs\n" for i in range(count))
        (tmp_path / f"{repo}.log").write_text(records)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        commits, paths = commit_log.read_commit_log(spark, str(tmp_path))
        assert commits.rdd.getNumPartitions() >= 1
        found = commits.select("repository", "log_pos", "sha").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(tuple(r) for r in found) == sorted(
        [("one", i, f"sha{i}") for i in range(3000)] + [("two", i, f"sha{i}") for i in range(700)]
    )
    assert paths.count() == 3700


def _reference_ranges(text):
    """The stated rules, line by line."""
    out, path, at = {}, None, None
    for raw in text.split("\n"):
        line = raw.rstrip("\r")
        if line.startswith("+++ "):
            path, at = (None if line[4:] == "/dev/null" else line[4:]), None
        elif line.startswith("@@"):
            part = next((p for p in line.split() if p.startswith("+")), "")
            number = part.lstrip("+").split(",")[0]
            at = int(number) if number.isdigit() else None
        elif at is None:
            continue
        elif line.startswith("+") and not line.startswith("+++"):
            if path is not None:
                ranges = out.setdefault(path, [])
                if ranges and at <= ranges[-1][1] + 1:
                    ranges[-1][1] = max(ranges[-1][1], at)
                else:
                    ranges.append([at, at])
            at += 1
        elif line.startswith("-") and not line.startswith("---"):
            continue
        elif not line.startswith("\\"):
            at += 1
    return sorted((p, a, b) for p, rs in out.items() for a, b in rs)


def test_changed_ranges_follow_the_rules_line_by_line(spark):
    import random

    choice = random.Random(5)
    texts = []
    for i in range(60):
        lines = []
        for name in ["a.rs", "/dev/null", "b/c.rs"]:
            lines += ["diff --git x y", "--- " + name, "+++ " + name]
            at = 1
            for _ in range(choice.randint(0, 6)):
                at += choice.randint(1, 4)
                lines.append(f"@@ -1 +{at},3 @@ fn")
                for _ in range(choice.randint(1, 6)):
                    kind = choice.choice(["+", "+", "-", " ", "", "\\ none", "---", "+++x"])
                    lines.append(kind + choice.choice(["x", "@@", ""]) if kind in "+- " else kind)
                    at += kind != "-"
        texts.append((f"t{i}", "\n".join(lines) + choice.choice(["", "\n"])))
    found = diffs.changed_ranges(spark.createDataFrame(texts, "change_id string, diff string"))
    expected = [(c, *r) for c, text in texts for r in _reference_ranges(text)]
    assert rows(found, "change_id", "path", "start", "end") == sorted(expected, key=repr)


def test_ranges_of_files_do_not_depend_on_splits(spark, tmp_path):
    """Random diffs of several changes to a file, in splits of 200 bytes and whole."""
    import random

    choice = random.Random(11)
    expected = []
    for f in range(3):
        text, named = "", f"d{f}/x"
        for change in [named] + [f"c{f}-{i}" for i in range(4)]:
            lines = []
            for name in ["a.rs", "/dev/null", "b c.rs"]:
                lines += ["diff --git x y", "--- " + name, "+++ " + name]
                at = 1
                for _ in range(choice.randint(0, 6)):
                    at += choice.randint(1, 4)
                    lines.append(f"@@ -1 +{at},3 @@ fn" if choice.random() < 0.9 else "@@ -1 +q @@")
                    for _ in range(choice.randint(1, 9)):
                        kind = choice.choice(["+", "+", "+", "-", " ", "", "\\ none", "---", "+++x"])
                        lines.append(kind + choice.choice(["x", "@@", ""]) if kind in "+- " else kind)
                        at += kind != "-"
            body = "\n".join(lines) + "\n"
            expected += [(change, *r) for r in _reference_ranges(body)]
            text += ("" if change == named else diffs.CHANGE + change + "\n") + body
        (tmp_path / f"d{f}").mkdir()
        (tmp_path / f"d{f}" / "x.diff").write_text(text)
    for size in ("200", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            found = rows(diffs.ranges_of_files(spark, str(tmp_path)), "change_id", "path", "start", "end")
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert found == sorted(expected, key=repr)


def test_ranges_of_files_walk_a_split_in_chunks(spark, tmp_path, monkeypatch):
    """A split is many groups, whatever its headers are; the ranges are those of the whole text."""
    text = "+++ a\n@@ -1 +5,9 @@\n" + "+x\n" * 30 + " c\n-d\n" + "+x\r\n" * 30 + "+++ b\n@@ -1 +2 @@\n+y\n"
    (tmp_path / "x.diff").write_text(text, newline="")
    monkeypatch.setattr(diffs, "CHUNK_BITS", 2)
    found = diffs.ranges_of_files(spark, str(tmp_path))
    assert rows(found, "change_id", "path", "start", "end") == sorted([("x", "a", 5, 34), ("x", "a", 36, 65), ("x", "b", 2, 2)], key=repr)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(chunk" in plan


def test_logs_of_one_name_in_two_folders_are_two_repositories(spark, tmp_path):
    for folder in ("a", "b c+d"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "log.txt").write_text("".join(f"\x1e{folder}{i}\x1f2024-01-01T00:00:00Z\x1fS\n\nx.rs\n" for i in range(3)))
    commits, _ = commit_log.read_commit_log(spark, str(tmp_path))
    assert rows(commits, "repository", "log_pos", "sha") == sorted([(f"{d}/log", i, f"{d}{i}") for d in ("a", "b c+d") for i in range(3)], key=repr)
    alone, _ = commit_log.read_commit_log(spark, str(tmp_path / "a" / "log.txt"))
    assert rows(alone, "repository", "log_pos") == [("log", 0), ("log", 1), ("log", 2)]


def test_a_very_long_hunk_is_one_run(spark):
    text = "+++ a\n@@ -0,0 +1,200000 @@\n" + "+x\n" * 200_000
    found = diffs.changed_ranges(spark.createDataFrame([("c", text)], "change_id string, diff string"))
    assert rows(found) == [("c", "a", 1, 200_000)]


def test_facts_and_ranges_meet_across_blocks(spark):
    facts = spark.createDataFrame([("a", n) for n in (1, 1023, 1024, 5000)], "path string, line int")
    ranges = spark.createDataFrame([("a", 1000, 3000), ("a", 4999, 5000)], "path string, start int, end int")
    assert rows(diffs.facts_in_ranges(facts, ranges, ["path"])) == [("a", 1023), ("a", 1024), ("a", 5000)]


def test_cohort_counts_compute_the_cohort_once(spark):
    """F16: the cohort is ranked and written once, and read twice."""
    from sparkwitness.catalog import core

    plan = core.queries()["hist_7_cohort_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan
