"""Joins of commits with pull requests, of pairs of predictions, and wide merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodemill.functions.regex import java

#: The first pull-request number in a message.
NUMBER = r"#(\d+)"


def first_number(message: Column) -> Column:
    got = F.regexp_extract(F.coalesce(message, F.lit("")), java(NUMBER), 1)
    return F.when(got != "", got)


def _by_sha(prs: DataFrame) -> DataFrame:
    """One pull request for each repository and commit: the last one, and its merge commit after its head."""
    keys = prs.select("repo", "number", "ord", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("head_sha").alias("sha")), F.struct(F.lit(1).alias("k"), F.col("merge_sha").alias("sha")))).alias("key"))
    keys = keys.where("key.sha is not null and key.sha <> ''")
    return keys.groupBy("repo", F.col("key.sha").alias("sha")).agg(F.max_by("number", F.struct("ord", "key.k")).alias("by_sha"))


def _by_number(prs: DataFrame) -> DataFrame:
    """The last pull request of each number, as text."""
    return prs.where("number is not null").groupBy("repo", F.col("number").cast("string").alias("n")).agg(F.max_by("number", "ord").alias("by_number"))


def link_first(commits: DataFrame, prs: DataFrame) -> DataFrame:
    """Each commit with ``pr_number``: by commit hash, else by the first number in its message; else null."""
    keyed = commits.withColumn("n", first_number(F.col("message")))
    joined = keyed.join(_by_sha(prs), ["repo", "sha"], "left").join(_by_number(prs), ["repo", "n"], "left")
    return joined.withColumn("pr_number", F.coalesce("by_sha", "by_number")).drop("n", "by_sha", "by_number")


def link_all(commits: DataFrame, prs: DataFrame) -> DataFrame:
    """Each commit with ``pr_numbers``: that of its hash and that of its message, if they differ."""
    keyed = commits.withColumn("n", first_number(F.col("message")))
    joined = keyed.join(_by_sha(prs), ["repo", "sha"], "left").join(_by_number(prs), ["repo", "n"], "left")
    return joined.withColumn("pr_numbers", F.array_distinct(F.array_compact(F.array("by_sha", "by_number")))).drop("n", "by_sha", "by_number")


def wide_merge(base: DataFrame, others: list[tuple[str, DataFrame]], key: str, order: str = "ord") -> DataFrame:
    """Left merge of tables by ``key``, each one's columns under its prefix; of repeated keys the last row, gaps empty.

    A table without rows adds its columns, empty.
    """
    out = base
    for prefix, table in others:
        names = [c for c in table.columns if c not in (key, order)]
        last = table.groupBy(key).agg(*[F.max_by(F.struct(*names), order).alias("last")])
        out = out.join(last, key, "left").select("*", *[F.coalesce(F.col(f"last.{c}").cast("string"), F.lit("")).alias(prefix + c) for c in names]).drop("last")
    return out


def merge_first(left: DataFrame, right: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """Left merge by ``key`` with the first of its rows."""
    names = [c for c in right.columns if c not in (key, order)]
    first = right.groupBy(key).agg(F.min_by(F.struct(*names), order).alias("first"))
    return left.join(first, key, "left").select("*", *[F.col(f"first.{c}").alias(c) for c in names]).drop("first")


def cells(left: DataFrame, right: DataFrame, skip: DataFrame) -> DataFrame:
    """Every combination of two small dimension tables but those to skip."""
    return left.crossJoin(right).join(skip, skip.columns, "left_anti")


def waterfall(*lookups: tuple[str, Column]) -> tuple[Column, Column]:
    """The first value found and the name of its lookup."""
    value = F.coalesce(*[c for _, c in lookups])
    name = None
    for label, c in lookups:
        name = F.when(c.isNotNull(), label) if name is None else name.when(c.isNotNull(), label)
    return value, name


def last_row(keys: list[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(F.col(order).desc())
