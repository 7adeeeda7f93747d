"""Test filters in workflow lines that select nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let, present

# Flags a filtered test command may carry, with and without a value.  Any other
# flag makes the line unsupported.
PLAIN_FLAGS = [
    "--locked", "--quiet", "-q", "--release", "--no-fail-fast", "--no-default-features", "--all-features", "--frozen", "--offline",
]
VALUE_FLAGS = ["--features", "--color", "--jobs", "-j", "--profile", "--target", "--target-dir", "--config"]
TRIM = r"^\s+|\s+$"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, TRIM, "")


def shell_line(line: Column) -> Column:
    """The command of a workflow line, or null."""

    def command_of(text: Column) -> Column:
        step = F.when(text.startswith("- "), _strip(F.substr(text, F.lit(3)))).otherwise(text)
        return let(
            step,
            lambda s: let(
                F.when(s.startswith("run:"), _strip(F.substr(s, F.lit(5)))).otherwise(s),
                lambda c: F.when(c.startswith("cargo test ") | c.startswith("cargo +"), c),
            ),
        )

    return let(
        _strip(line),
        lambda text: F.when((text != "") & ~text.startswith("#") & ~text.endswith("\\"), command_of(text)),
    )


def lib_test_filter(command: Column) -> Column:
    """The one bare filter of a ``--lib`` test command, or null if the line is not supported.

    A fold over the tokens: a flag with a value skips the next token, ``--`` ends the command.
    """
    return let(F.split(command, r"\s+"), _filter_of)


def _filter_of(tokens: Column) -> Column:
    toolchain = F.get(tokens, F.lit(1)).startswith("+")
    good_toolchain = F.get(tokens, F.lit(1)).rlike(r"^\+[A-Za-z0-9._-]+$")
    at = F.when(toolchain, F.lit(2)).otherwise(F.lit(1))
    rest = F.slice(tokens, at + 2, F.size(tokens))
    state = F.struct(
        F.lit(True).alias("ok"), F.lit(False).alias("skip"), F.lit(False).alias("done"), F.lit(False).alias("lib"),
        F.lit(None).cast("string").alias("filter"),
    )

    def step(acc, token):
        bare = F.regexp_replace(token, r"""^['"]+|['"]+$""", "")
        set_ = lambda ok=acc["ok"], skip=F.lit(False), done=acc["done"], lib=acc["lib"], flt=acc["filter"]: F.struct(
            ok.alias("ok"), skip.alias("skip"), done.alias("done"), lib.alias("lib"), flt.alias("filter")
        )
        return (
            F.when(acc["done"] | ~acc["ok"], acc)
            .when(acc["skip"], set_())
            .when(token == "--", set_(done=F.lit(True)))
            .when(token == "--lib", set_(lib=F.lit(True)))
            .when(token.isin(PLAIN_FLAGS), acc)
            .when(token.isin(VALUE_FLAGS), set_(skip=F.lit(True)))
            .when(token.startswith("-") | acc["filter"].isNotNull() | ~bare.rlike("^[A-Za-z0-9_]+$"), set_(ok=F.lit(False)))
            .otherwise(set_(flt=bare))
        )

    finish = lambda acc: F.when(acc["ok"] & acc["lib"] & ~acc["skip"], acc["filter"])
    return F.when(
        (F.size(tokens) >= 4)
        & (F.get(tokens, F.lit(0)) == "cargo")
        & (~toolchain | good_toolchain)
        & (F.get(tokens, at) == "test"),
        F.aggregate(rest, state, step, finish),
    )


def ci_commands(workflow_lines: DataFrame) -> DataFrame:
    """``workflow_lines(repository, path, line, text)`` with a supported filtered command."""
    return (
        workflow_lines.withColumn("command", present(shell_line(F.col("text"))))
        .withColumn("filter", present(lib_test_filter(F.col("command"))))
        .select("repository", "path", "line", "command", "filter")
    )


def filter_outcomes(commands: DataFrame, names: DataFrame, parse_failures: DataFrame) -> DataFrame:
    """matched / unmatched per command; suppressed where the inventory proves nothing.

    ``names(repository, kind, name)``: explicit tests and module fragments.  A filter matches as a
    substring.  Names are cut into their substrings of the lengths that the repository's filters
    have, so containment is an equi-join on the substring.
    """
    lengths = commands.select("repository", F.length("filter").alias("_len")).distinct()
    fragments = (
        names.select("repository", "name").distinct()
        .join(lengths, "repository")
        .where(F.length("name") >= F.col("_len"))
        .select(
            "repository",
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.length("name") - F.col("_len") + 1),
                    lambda i: F.substring(F.col("name"), i, F.col("_len")),
                )
            ).alias("filter"),
        )
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    flagged = lambda df, flag: df.select("repository").distinct().withColumn(flag, F.lit(True))
    outcome = (
        F.when(F.col("_broken"), "suppressed_parse_failures")
        .when(F.col("_tests").isNull(), "suppressed_no_tests")
        .when(F.col("_hit"), "matched")
        .otherwise("unmatched")
    )
    return (
        commands.join(fragments, ["repository", "filter"], "left")
        .join(flagged(parse_failures, "_broken"), "repository", "left")
        .join(flagged(names.where(F.col("kind") == "test"), "_tests"), "repository", "left")
        .select("repository", "path", "line", "command", "filter", outcome.alias("outcome"))
    )


def unmatched_filters(commands: DataFrame, names: DataFrame, parse_failures: DataFrame) -> DataFrame:
    return filter_outcomes(commands, names, parse_failures).where(F.col("outcome") == "unmatched").drop("outcome")
