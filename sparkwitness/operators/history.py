"""Commit cohorts, co-change companions and history windows.

``commits(repository, sha, log_pos, subject, is_merge)``: a smaller ``log_pos`` is newer.
``commit_paths(repository, sha, path)`` holds distinct rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import present
from ..functions.paths import ancestors
from ..plans.durable import kept as written
from ..plans.scopes import with_ancestors

EXAMPLES = 3
WORD = 50  # bits of a cohort bitmap in one long, clear of its sign
HEADER_LINES = 40
HEADER_BYTES = 8192
# Texts by which a file says that it is generated.
GENERATED_MARKERS = ["@generated", "do not edit", "automatically generated", "auto-generated"]


def is_revert(subject: Column) -> Column:
    return F.coalesce(subject.rlike(r"(?i)^\s*revert"), F.lit(False))


def path_counts(commit_paths: DataFrame) -> DataFrame:
    return commit_paths.groupBy("repository", "sha").agg(F.count(F.lit(1)).alias("changed_paths"))


def anchor_cohort(
    commits: DataFrame,
    commit_paths: DataFrame,
    anchors: DataFrame | None = None,
    max_commits: int = 100,
    max_paths: int = 100,
) -> DataFrame:
    """Newest ``max_commits`` non-merge commits per anchor; the limit applies before exclusions.

    Paths, log and path counts meet on the commit, so the paths are shuffled once.  The rank filter
    then becomes a group limit in front of the second shuffle: a path touched by most commits sends
    at most ``max_commits`` rows per task.
    """
    touched = commit_paths.withColumnRenamed("path", "anchor")
    if anchors is not None:
        touched = touched.join(anchors.select("repository", "anchor").distinct(), ["repository", "anchor"])
    log = commits.where(~F.col("is_merge")).select("repository", "sha", "log_pos", "subject")
    newest = Window.partitionBy("repository", "anchor").orderBy("log_pos")
    reason = F.when(is_revert(F.col("subject")), "revert").when(F.col("changed_paths") > max_paths, "broad")
    return (
        touched.join(log, ["repository", "sha"])
        .join(path_counts(commit_paths), ["repository", "sha"])
        .withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= max_commits)
        .withColumn("reason", reason)
        .withColumn("considered", F.col("reason").isNull())
        .select(
            "repository", "anchor", "sha", "log_pos", "subject", "considered", "reason", "changed_paths"
        )
    )


def _percent(support: Column, opportunities: Column) -> Column:
    return F.round(F.lit(1000.0) * support / opportunities) / 10.0


def _bits(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def _lowest(words: list[Column]) -> tuple[Column, list[Column]]:
    """Number of the lowest bit set in the words (null if none), and the words without it."""
    first, cleared, above = F.lit(None).cast("int"), [], F.lit(False)
    for k, word in enumerate(words):
        mine = ~above & (word != 0)
        first = F.when(mine, F.bit_count(word.bitwiseAND(-word) - 1) + k * WORD).otherwise(first)
        cleared.append(F.when(mine, word.bitwiseAND(word - 1)).otherwise(word))
        above = above | (word != 0)
    return first, cleared


def companions(cohort: DataFrame, commit_paths: DataFrame, examples: int = EXAMPLES, max_commits: int = 100) -> DataFrame:
    """Paths that changed together with an anchor, with both kinds of example.

    A considered commit is known by its place in the anchor's cohort, so a companion is a bitmap of
    ``max_commits`` bits in longs: support is a bit count, the absent commits are the other bits, and the
    newest of both are the lowest ones.  The bitmaps combine before the shuffle; a commit has at most ``max_paths``
    paths, which bounds the join.  A cohort of more than ``max_commits`` commits is an error.
    """
    newest = Window.partitionBy("repository", "anchor").orderBy("log_pos")
    kept = (
        cohort.where("considered").select("repository", "anchor", "sha", "log_pos")
        .withColumn("_place", F.row_number().over(newest) - 1)
    )
    anchors = kept.groupBy("repository", "anchor").agg(
        F.count(F.lit(1)).alias("opportunities"),
        F.sort_array(F.collect_list(F.struct("_place", "sha")))["sha"].alias("_shas"),
    )
    n_words = -(-max_commits // WORD)
    bit = F.when(F.col("_place") < max_commits, _bits(F.col("_place") % WORD)).otherwise(
        F.raise_error(F.lit(f"a cohort holds more than max_commits={max_commits} commits")).cast("long"))
    words = [F.bit_or(F.when(F.floor(F.col("_place") / WORD) == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"_w{k}") for k in range(n_words)]
    whole = lambda k: _bits(F.least(F.greatest(F.col("opportunities") - k * WORD, F.lit(0)), F.lit(WORD))) - 1
    found = (
        kept.join(commit_paths, ["repository", "sha"])
        .where(F.col("path") != F.col("anchor"))
        .groupBy("repository", "anchor", "path").agg(*words)
        .join(anchors, ["repository", "anchor"])
        .withColumn("support", sum((F.bit_count(f"_w{k}") for k in range(1, n_words)), F.bit_count("_w0")).cast("long"))
    )
    present, absent = [F.col(f"_w{k}") for k in range(n_words)], [whole(k).bitwiseXOR(F.col(f"_w{k}")) for k in range(n_words)]
    for i in range(examples):  # the next place of each kind, step by step
        steps = {}
        for kind, bits in (("p", present), ("a", absent)):
            first, cleared = _lowest(bits)
            steps |= {f"_{kind}{i}": first} | {f"_{kind}{i}_w{k}": c for k, c in enumerate(cleared)}
        found = found.withColumns(steps)
        present, absent = ([F.col(f"_{kind}{i}_w{k}") for k in range(n_words)] for kind in "pa")
    named = lambda kind: F.transform(F.array_compact(F.array(*[F.col(f"_{kind}{i}") for i in range(examples)])), lambda i: F.get("_shas", i))
    return found.select(
        "repository",
        "anchor",
        "path",
        "support",
        "opportunities",
        _percent(F.col("support"), F.col("opportunities")).alias("support_percent"),
        named("p").alias("examples"),
        named("a").alias("counterexamples"),
    )


def directional_pairs(companion_rows: DataFrame) -> DataFrame:
    """P(path given anchor) beside P(anchor given path); a missing direction stays null.

    Both directions of two paths meet in one aggregation, so the companions are computed once.
    """
    figures = ["support", "opportunities", "support_percent"]
    low, high = F.least("anchor", "path"), F.greatest("anchor", "path")
    ahead = F.col("anchor") < F.col("path")
    both = companion_rows.groupBy("repository", low.alias("_low"), high.alias("_high")).agg(
        *[F.max(F.when(ahead, F.col(c))).alias(f"_ahead_{c}") for c in figures], *[F.max(F.when(~ahead, F.col(c))).alias(f"_back_{c}") for c in figures])

    def direction(anchor: str, path: str, mine: str, other: str) -> Column:
        names = ["reverse_support", "reverse_opportunities", "reverse_percent"]
        return F.when(F.col(f"_{mine}_support").isNotNull(), F.struct(
            F.col(anchor).alias("anchor"), F.col(path).alias("path"), *[F.col(f"_{mine}_{c}").alias(c) for c in figures],
            *[F.col(f"_{other}_{c}").alias(n) for c, n in zip(figures, names, strict=True)]))

    rows = F.array_compact(F.array(direction("_low", "_high", "ahead", "back"), direction("_high", "_low", "back", "ahead")))
    return both.select("repository", F.inline(rows))


def generated_markers(files: DataFrame) -> DataFrame:
    """First self-identification within the header of ``files(repository, path, content)``."""
    raw = F.col("content").cast("binary")
    header = F.make_valid_utf8(F.substring(raw, 1, HEADER_BYTES).cast("string"))
    lines = F.slice(F.split(header, "\r?\n", -1), 1, HEADER_LINES)
    hits = F.filter(
        F.transform(lines, lambda text, i: F.struct((i + 1).alias("line"), text.alias("marker"))),
        lambda h: h["marker"].rlike("(?i)" + "|".join(GENERATED_MARKERS)),
    )
    first = F.get(hits, 0)
    return (
        files.select("repository", "path", present(first).alias("hit"))
        .select("repository", "path", F.col("hit.line").cast("long").alias("line"), F.regexp_replace("hit.marker", r"^\s+|\s+$", "").alias("marker"))
    )


def classify_changes(source_commits: DataFrame, file_versions: DataFrame) -> DataFrame:
    """Change class of each (sha, path) from the fingerprints before and after.

    ``source_commits(repository, sha, parent_sha, path)``,
    ``file_versions(repository, sha, path, fingerprint)``; a null fingerprint did not parse.
    """
    after = file_versions.select("repository", "sha", "path", F.col("fingerprint").alias("after_fp"))
    before = file_versions.select(
        "repository",
        F.col("sha").alias("parent_sha"),
        "path",
        F.col("fingerprint").alias("before_fp"),
    )
    change_class = (
        F.when(F.col("before_fp").isNull() | F.col("after_fp").isNull(), "unclassified")
        .when(F.col("before_fp") == F.col("after_fp"), "comments_or_docs_only")
        .otherwise("syntax_changed")
    )
    return (
        source_commits.join(after, ["repository", "sha", "path"], "left")
        .join(before, ["repository", "parent_sha", "path"], "left")
        .select("repository", "sha", "path", change_class.alias("change_class"))
    )


def tagged_cohort(cohort: DataFrame, source_commits: DataFrame, file_versions: DataFrame) -> DataFrame:
    """Considered commits of every cohort with the ``change_class`` of the anchor in them.

    (repository, source, sha, log_pos, change_class); null where ``source_commits`` has no row, which holds distinct rows as
    ``classify_changes`` states them.  Only versions that a cohort asks for are compared, and both of a commit are looked
    up in one join.  The cohort is best a written table: its commits, and then the versions asked for, are met by the large tables
    first, so that these are cut down before they are shuffled wherever the cohort is small enough to be broadcast.
    """
    focused = cohort.where("considered").select("repository", F.col("anchor").alias("source"), "sha", "log_pos")
    known = source_commits.join(focused.select("repository", "sha"), ["repository", "sha"], "left_semi")
    asked = focused.join(
        known.select("repository", "sha", F.col("path").alias("source"), "parent_sha", F.lit(True).alias("_known")), ["repository", "sha", "source"], "left")
    sides = F.explode(F.array(F.struct(F.lit(True).alias("after"), F.col("sha").alias("at")), F.struct(F.lit(False).alias("after"), F.col("parent_sha").alias("at"))))
    asked = written(asked.withColumn("_side", sides).withColumn("_at", F.col("_side.at")), "asked-versions")
    versions = file_versions.select("repository", F.col("sha").alias("_at"), F.col("path").alias("source"), "fingerprint")
    versions = versions.join(asked.select("repository", "source", "_at"), ["repository", "source", "_at"], "left_semi")
    change_class = (
        F.when(F.col("_known").isNull(), None).when(F.col("_before").isNull() | F.col("_after").isNull(), "unclassified")
        .when(F.col("_before") == F.col("_after"), "comments_or_docs_only").otherwise("syntax_changed")
    )
    return (
        asked.join(versions, ["repository", "source", "_at"], "left")
        .groupBy("repository", "source", "sha", "log_pos").agg(
            F.max("_known").alias("_known"), F.max(F.when(F.col("_side.after"), F.col("fingerprint"))).alias("_after"),
            F.max(F.when(~F.col("_side.after"), F.col("fingerprint"))).alias("_before"),
        )
        .select("repository", "source", "sha", "log_pos", change_class.alias("change_class"))
    )


def class_cohort(tagged: DataFrame, commit_paths: DataFrame, pairs: DataFrame) -> DataFrame:
    """Support of each (source, output) pair among the syntax-changing commits of the source.

    ``tagged`` as of ``tagged_cohort``; distinct ``pairs(repository, source, output)``, of which every one keeps a row, even without
    history.  A pair asks for its output in the commits of its source, at most ``max_commits`` of them, so other companions are
    never built, and paths of other commits are left out first.  ``tagged`` is best a written table, as it is read twice.
    """
    history = tagged.where(F.col("change_class").isNotNull())
    present = commit_paths.join(history.select("repository", "sha"), ["repository", "sha"], "left_semi").select("repository", "sha", F.col("path").alias("output"), F.lit(True).alias("_present"))
    is_class = lambda name: F.col("change_class") == name
    hit = is_class("syntax_changed") & F.col("_present")
    return (
        pairs.select("repository", "source", "output").join(history, ["repository", "source"], "left")
        .join(present, ["repository", "sha", "output"], "left")
        .groupBy("repository", "source", "output")
        .agg(
            F.count_if(is_class("syntax_changed")).alias("opportunities"),
            F.count_if(hit).alias("support"),
            F.count_if(is_class("comments_or_docs_only")).alias("comments_or_docs_only"),
            F.count_if(is_class("unclassified")).alias("unclassified"),
            F.slice(F.sort_array(F.collect_list(F.when(hit, F.struct("log_pos", "sha")))), 1, EXAMPLES)["sha"].alias("examples"),
        )
    )


def cohort_compare(tagged: DataFrame, commit_paths: DataFrame, top: int = 15) -> DataFrame:
    """Class-filtered support beside support over all considered commits, ``top`` per source.

    ``omitted`` is the number of companions of the source that the limit leaves out.  A source's own row gives its totals; a
    source has at most max_commits * max_paths companions, which bounds the windows.
    """
    source = Window.partitionBy("repository", "source")
    ranked = source.orderBy(F.col("path") == F.col("source"), F.desc("class_support"), F.desc("all_support"), "path")
    own = F.col("path") == F.col("source")
    return (
        tagged.withColumn("_syntax", F.coalesce(F.col("change_class") == "syntax_changed", F.lit(False)))
        .join(commit_paths, ["repository", "sha"])
        .groupBy("repository", "source", "path")
        .agg(F.count(F.lit(1)).alias("all_support"), F.count_if("_syntax").alias("class_support"))
        .where(F.col("class_support") > 0)
        .withColumn("rank", F.row_number().over(ranked).cast("long"))
        .withColumn("all_opportunities", F.max(F.when(own, F.col("all_support"))).over(source))
        .withColumn("class_opportunities", F.max(F.when(own, F.col("class_support"))).over(source))
        .withColumn("omitted", F.greatest(F.count(F.lit(1)).over(source) - 1 - top, F.lit(0).cast("long")))
        .where(~own & (F.col("rank") <= top))
        .select(
            "repository", "source", "path", "rank",
            "class_support", "class_opportunities", "all_support", "all_opportunities", "omitted",
        )
    )


def cohort_counts(cohort: DataFrame, tagged: DataFrame) -> DataFrame:
    """What a comparison rests on, per source: commits found, those set aside and why, and the classes of the rest."""
    found = cohort.select(
        "repository", F.col("anchor").alias("source"), F.coalesce("reason", F.lit("focused")).alias("_what"), F.lit(1).alias("_found"))
    rows = found.unionByName(tagged.select("repository", "source", F.coalesce("change_class", F.lit("no_version")).alias("_what"), F.lit(0).alias("_found")))
    of = lambda what: F.count_if(F.col("_what") == what)
    return rows.groupBy("repository", "source").agg(
        F.sum("_found").alias("discovered"), of("focused").alias("focused"), of("syntax_changed").alias("syntax_changed"),
        of("comments_or_docs_only").alias("comments_or_docs_only"), (of("unclassified") + of("no_version")).alias("unclassified"),
        of("revert").alias("excluded_reverts"), of("broad").alias("excluded_broad"),
    )


def _limited(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Newest ``limit`` rows per key.  One row more is ranked, to tell whether the window was cut."""
    newest = Window.partitionBy(*keys).orderBy("log_pos")
    ranked = rows.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= limit + 1)
    whole = Window.partitionBy(*keys)
    return (
        ranked.withColumn("truncated", F.max("_rank").over(whole) > limit)
        .where(F.col("_rank") <= limit)
        .drop("_rank")
    )


def recent_history(commits: DataFrame, commit_paths: DataFrame, targets: DataFrame, limit: int = 20) -> DataFrame:
    """Newest commits touching each ``targets(repository, target)`` path."""
    touched = commit_paths.join(
        targets.select("repository", F.col("target").alias("path")).distinct(), ["repository", "path"]
    ).withColumnRenamed("path", "target")
    log = commits.where(~F.col("is_merge")).select("repository", "sha", "log_pos", "subject")
    return _limited(touched.join(log, ["repository", "sha"]), ["repository", "target"], limit).select(
        "repository", "target", "sha", "log_pos", "subject", "truncated"
    )


def scope_history(commits: DataFrame, commit_paths: DataFrame, targets: DataFrame, limit: int = 20) -> DataFrame:
    """Newest commits below each target's directory that are not in the target's own window.

    ``targets(repository, target, scope)``.  The scope window is computed once per distinct
    scope, not once per target.
    """
    scopes = targets.select("repository", "scope").distinct()
    touched = (
        with_ancestors(commit_paths, "path", "scope")
        .join(scopes, ["repository", "scope"], "left_semi")
        .select("repository", "scope", "sha")
        .distinct()
    )
    log = commits.where(~F.col("is_merge")).select("repository", "sha", "log_pos", "subject")
    window = _limited(touched.join(log, ["repository", "sha"]), ["repository", "scope"], limit)
    own = recent_history(commits, commit_paths, targets, limit).select("repository", "target", "sha")
    return (
        targets.select("repository", "target", "scope").distinct()
        .join(window, ["repository", "scope"])
        .join(own, ["repository", "target", "sha"], "left_anti")
        .select("repository", "target", "scope", "sha", "log_pos", "truncated")
    )


def common_directory(task_paths: DataFrame) -> DataFrame:
    """Deepest directory above all ``task_paths(task, path)`` rows.

    Null when a task has fewer than two paths or its paths share no directory.
    """
    distinct = task_paths.select("task", "path").distinct()
    # A directory is above all paths when it is above the first and the last of them in byte order.
    spans = distinct.groupBy("task").agg(
        F.count(F.lit(1)).alias("_paths"), F.count("path").alias("_known"), F.min("path").alias("_low"), F.max("path").alias("_high"))
    shared = F.filter(ancestors(F.col("_low"), False), lambda d: F.startswith(F.col("_high"), F.concat(d, F.lit("/"))))
    deepest = F.array_max(F.transform(shared, lambda d: F.struct(F.length(d).alias("n"), d.alias("dir"))))["dir"]
    known = (F.col("_paths") >= 2) & (F.col("_known") == F.col("_paths"))
    return spans.select("task", F.when(known, deepest).alias("scope"), F.col("_paths").alias("paths"))


def subject_presence(required: DataFrame, history: DataFrame) -> DataFrame:
    """Whether each ``required(repository, target, subject)`` text occurs in a subject of the
    target's window.  The window is bounded by its limit, which bounds the join."""
    seen = history.select("repository", "target", F.col("subject").alias("_seen"))
    return (
        required.join(seen, ["repository", "target"], "left")
        .groupBy("repository", "target", "subject")
        .agg(F.coalesce(F.bool_or(F.col("_seen").contains(F.col("subject"))), F.lit(False)).alias("present"))
    )
