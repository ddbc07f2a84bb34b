"""Statistics of datasets: slices in one pass, dimension tables that keep empty rows, histograms, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodemill.functions.scalars import severity
from lodemill.operators import selection
from lodemill.rules.security import TOP_25


def corpus_overview(docs: DataFrame, repository: str, path: str, text: str) -> DataFrame:
    """Files, repositories, root and nested ones, characters, empty ones, and rows in groups of equal content."""
    size = F.length(text)
    groups = docs.groupBy(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("h")).agg(F.count("*").alias("n"))
    repeated = groups.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("in_duplicate_groups"))
    root = ~F.contains(F.col(path), F.lit("/"))
    main = docs.agg(F.count("*").alias("files"), F.countDistinct(repository).alias("repositories"), F.count_if(root).alias("root_files"), F.count_if(~root).alias("nested_files"), F.sum(size).alias("characters"), F.count_if(F.coalesce(size, F.lit(0)) == 0).alias("empty"))
    return main.crossJoin(F.broadcast(repeated)).crossJoin(F.broadcast(selection.quantiles(docs, size, {"median_characters": 0.5}).drop("n")))


def sizes_by(docs: DataFrame, by: str, text: str, language: str) -> DataFrame:
    """Documents, characters, median length (truncated) and languages of each group."""
    size = F.length(text)
    sums = docs.groupBy(by).agg(F.count("*").alias("n_docs"), F.sum(size).alias("n_chars"), F.countDistinct(language).alias("n_langs"))
    middle = selection.quantiles(docs, size, {"median_chars": 0.5}, [by]).select(F.col(by).alias("__by"), F.col("median_chars").cast("long").alias("median_chars"))
    return sums.join(middle, F.col(by).eqNullSafe(F.col("__by")), "left").select(by, "n_docs", "n_chars", "median_chars", "n_langs")


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A02."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def name_counts(docs: DataFrame, path: str, repository: str, order: str) -> DataFrame:
    """Files of each name without regard to case, its first spelling, and its repositories."""
    name = F.substring_index(path, "/", -1)
    return docs.groupBy(F.lower(name).alias("name_key")).agg(F.count("*").alias("files"), F.min_by(name, order).alias("spelling"), F.countDistinct(repository).alias("repositories"))


def size_histogram(rows: DataFrame, value: Column, bins: int = 40, top: float = 0.99) -> DataFrame:
    """Equal bins between the least value and a high percentile, to which larger ones are cut."""
    limits = rows.agg(F.min(value).cast("double").alias("lo")).crossJoin(F.broadcast(selection.quantiles(rows, value, {"hi": top}).drop("n")))
    cut = rows.select(value.cast("double").alias("v")).where("v is not null").crossJoin(F.broadcast(limits)).withColumn("v", F.least("v", "hi"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0)
    counted = cut.groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def sliced(rows: DataFrame, slices: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates over all rows and over each slice alone, in one pass: ``slice``, ``value`` and the aggregates."""
    every = [F.struct(F.lit("all").alias("slice"), F.lit("all").alias("value"))] + [F.struct(F.lit(s).alias("slice"), F.col(s).cast("string").alias("value")) for s in slices]
    return rows.withColumn("__s", F.explode(F.array(*every))).groupBy(F.col("__s.slice").alias("slice"), F.col("__s.value").alias("value")).agg(*aggregates)


def severity_counts(rows: DataFrame, score: str, by: str | None = None, dashboard: bool = False) -> DataFrame:
    """A21."""
    keys = [by] if by else []
    bands = ["critical", "high", "medium", "low"] + ([] if dashboard else ["unscored"])
    band = severity(F.col(score), dashboard)
    return rows.groupBy(*keys).agg(*[F.count_if(band == b).alias(b) for b in bands])


def score_histogram(rows: DataFrame, score: str) -> DataFrame:
    """Unit bins from 2 to 10, the last up to 10.05; ``height`` is scaled to 95 for the largest."""
    s = F.col(score)
    placed = rows.where((s >= 2) & (s < 10.05)).groupBy(F.least(F.lit(9), F.floor(s)).cast("int").alias("low")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(2, 10).select(F.col("id").cast("int").alias("low"))
    full = every.join(placed, "low", "left").select("low", F.coalesce("n", F.lit(0)).alias("n"))
    most = F.max("n").over(Window.partitionBy())
    return full.withColumn("height", F.when(most > 0, F.round(F.col("n") / most * 95, 1)).otherwise(0.0))


def by_language(rows: DataFrame, key: str, language: str, languages: list[str], score: str) -> DataFrame:
    """Rows of a key by language, and its scores in order."""
    return rows.groupBy(key).agg(*[F.count_if(F.col(language) == x).alias(x) for x in languages], F.sort_array(F.collect_list(score)).alias("scores"))


def weakness_ranks(rows: DataFrame, cwe: str, catalogue: list[str]) -> DataFrame:
    """Rows of each weakness, their percentage, its rank among the 25 and whether it is catalogued; listed ones without rows stay."""
    listed = rows.sparkSession.createDataFrame([(c, k) for k, c in enumerate(TOP_25, 1)], "cwe string, rank int")
    counted = rows.groupBy(F.col(cwe).alias("cwe")).agg(F.count("*").alias("n"))
    out = counted.join(F.broadcast(listed), "cwe", "full").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy())
    return out.withColumns({"pct": F.round(F.coalesce(F.try_divide(100.0 * F.col("n"), total), F.lit(0.0)), 2), "in_catalogue": F.col("cwe").isin(catalogue)})


def funnel(advisories: DataFrame, cwes: str, status: str, statuses: list[str]) -> DataFrame:
    """Advisories of each weakness by status."""
    return advisories.select(F.explode(cwes).alias("cwe"), status).groupBy("cwe").agg(F.count("*").alias("n"), *[F.count_if(F.col(status) == s).alias(s) for s in statuses])


def cell_counts(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of cells that have enough, with the cell's size."""
    counts = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count("*").alias("cell_n")).where(F.col("cell_n") >= least)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(counts, same).drop(*[f"__{k}" for k in keys])
