"""Tests of the findings in FINDINGS_r04.md."""

import random
import time
from pathlib import Path

from conftest import rows
from pyspark.sql import functions as F
from test_history import _reference_ranges

from sparkwitness.catalog import core
from sparkwitness.operators import claims, closures
from sparkwitness.plans import durable
from sparkwitness.sources import diffs

QUERIES = core.queries()
FOLDER = "/root/testdata/sf0.001"


def test_lines_of_diff_files_are_sorted_once(spark, tmp_path):
    (tmp_path / "x.diff").write_text("+++ a\n@@ -1 +5,9 @@\n+x\n-y\n+x\n")
    found = diffs.ranges_of_files(spark, str(tmp_path))
    assert rows(found, "change_id", "path", "start", "end") == [("x", "a", 5, 6)]
    done = found._jdf.queryExecution().executedPlan().toString()
    done = done[: done.index("Initial Plan")] if "Initial Plan" in done else done
    assert done.count("FileScan text") == 1 and done.count("Sort [chunk") <= 2  # of the lines, and of the chunks where they are joined
    assert "ReusedExchange" in done


def test_runs_of_diff_files_meet_over_chunks_whatever_their_order(spark, tmp_path, monkeypatch):
    """Hunks that go back, chunks without added lines, names without a header of their own, lines that end in CR."""
    monkeypatch.setattr(diffs, "CHUNK_BITS", 2)
    choice, expected = random.Random(3), []
    for f in range(4):
        text = ""
        for change in [f"x{f}"] + [f"c{f}-{i}" for i in range(3)]:
            lines = ["+lost", "@@ -1 +7 @@", "+lost too"]
            for name in ["a.rs", "/dev/null", "b.rs", "a.rs"]:
                lines += ["--- " + name, "+++ " + name]
                for _ in range(choice.randint(0, 5)):
                    lines.append(f"@@ -1 +{choice.randint(1, 20)},3 @@" if choice.random() < 0.9 else "@@ -1 +q @@")
                    for _ in range(choice.randint(0, 14)):
                        lines.append(choice.choice(["+", "+", "+a", "-", "-a", " ", "", "\\ none", "---", "+++x", "+@@"]))
            body = "\n".join(lines) + "\n"
            expected += [(change, *r) for r in _reference_ranges(body)]
            text += ("" if change == f"x{f}" else diffs.CHANGE + change + "\n") + body
        (tmp_path / f"x{f}.diff").write_text(text.replace("\n", "\r\n") if f % 2 else text, newline="")
    assert rows(diffs.ranges_of_files(spark, str(tmp_path)), "change_id", "path", "start", "end") == sorted(expected, key=repr)


def moves_of(spark, df):
    given = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", given)


def test_a_claim_of_one_row_is_shuffled_once(spark):
    t = core.Tables(spark, FOLDER)
    plan = moves_of(spark, lambda: claims.proof_surfaces(t("proof_claims"), t("artifacts")))
    assert plan.count("Exchange hashpartitioning") == 2  # the claims and the artifacts, no fold


def test_texts_are_not_moved_on_to_the_paths(spark):
    t = core.Tables(spark, FOLDER)
    plan = moves_of(spark, lambda: claims.proxy_revisions(t("proxy_claims"), t("artifacts"), t("artifact_paths")))
    assert "_number_text" not in plan[: plan.index("Exchange hashpartitioning(_home")]


def test_the_front_reads_artifacts_once(spark):
    plan = moves_of(spark, lambda: QUERIES["front_1_episode_front"](spark, FOLDER))
    assert plan.count("orders.parquet") <= 7


def test_what_a_claim_says_itself_counts_in_a_row_of_its_own_and_in_that_of_a_pull_request(spark):
    t = core.Tables(spark, "/root/testdata/sf0.01")
    counts = claims.lesson_counts(t("lesson_repairs"), t("lesson_adjacent"), t("lesson_covered"))
    of = lambda apart: claims.statuses(
        {
            "lesson": claims.lesson_rows(t("lesson_claims"), counts, apart), "proxy": claims.proxy_rows(t("proxy_claims"), apart),
            "reconciliation": claims.reconciliation_rows(t("reconciliation_claims"), apart), "proof": claims.proof_rows(t("proof_claims"), apart),
        },
        t("artifacts"), t("artifact_paths"),
    )
    together = of(False)
    assert together.count() == together.select("family", "claim_id").distinct().count() > 1000
    assert of(True).exceptAll(together).count() == together.exceptAll(of(True)).count() == 0


def test_rejections_of_others_and_comments_that_say_nothing_do_not_count(spark):
    bot, end = closures.BOT, closures.INACTIVE_END
    issues = spark.createDataFrame(
        [("r", 1, "closed", "u", "b"), ("r", 2, "open", "v", "**Re-reporting** the bug from #1")],
        "repository string, number long, state string, reporter string, body string")
    said = [
        (1, bot, f"{closures.INACTIVE_START}r{end}"), (2, bot, f"{closures.INACTIVE_START}q{end}"), (3, "x", closures.REJECTION), (4, None, closures.REJECTION),
        (5, "u", None), (6, "u", closures.REJECTION), (7, bot, f"{closures.DUPLICATE_LIST} {closures.DUPLICATE_NOTICE}"), (8, "u", "hello"),
    ]
    comments = spark.createDataFrame([("r", 1, *s) for s in said], "repository string, number long, comment_id long, actor string, body string")
    found = closures.closure_episodes(issues, comments)
    assert rows(found, "prior_issue", "later_issue", "closure_comment_id", "challenge", "disposition") == [(1, 2, 1, "challenged", "inspect_prior_failure")]


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f.name for d in dirs for f in Path(d.getPath()).rglob("shuffle_*")}


def test_what_is_written_in_a_releasing_session_leaves_no_shuffle_files(spark):
    given, beside = spark.conf.getAll, durable.releasing(spark)
    before = shuffle_files(spark)
    rows_of = lambda session: session.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    [here] = durable.kept_for(rows_of(beside), "released", spark)
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert here.sparkSession is spark and here.count() == 7 and spark.conf.getAll == given
    durable.kept(rows_of(spark), "unreleased")
    assert shuffle_files(spark) - before


def test_the_front_writes_its_parts_first(spark):
    plan = moves_of(spark, lambda: QUERIES["front_1_episode_front"](spark, FOLDER))
    assert "lineitem.parquet" not in plan and plan.count("Exchange hashpartitioning") <= 16


def test_the_front_reads_a_store_that_only_the_session_knows(spark):
    link = "fs.viewfs.mounttable.data.link./sf"
    spark.conf.set(link, f"file://{FOLDER}")
    try:
        assert QUERIES["front_1_episode_front"](spark, "viewfs://data/sf").count() == QUERIES["front_1_episode_front"](spark, FOLDER).count()
    finally:
        spark.conf.unset(link)
