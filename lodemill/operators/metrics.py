"""Scores of predictions: confusion, slices, pairs and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemill.operators import selection


def share(a: Column, b: Column, places: int = 4) -> Column:
    """A ratio; 0 where there is nothing to divide by."""
    return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), places)


def confusion(rows: DataFrame, truth: Column, flagged: Column, by: list[str] | None = None, cwe_hit: Column | None = None, unknown: Column | None = None) -> DataFrame:
    """Counts and rates of a binary prediction, whole or by slice, in one aggregate.

    ``unknown`` rows are counted and not scored; ``cwe_hit`` adds the accuracy on positives and the joint one.
    """
    known = ~unknown if unknown is not None else F.lit(True)
    hit = cwe_hit if cwe_hit is not None else F.lit(False)
    count = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    cells = [
        F.count("*").alias("n"),
        count(~known).alias("unknown"),
        count(known & truth & flagged).alias("tp"),
        count(known & ~truth & flagged).alias("fp"),
        count(known & ~truth & ~flagged).alias("tn"),
        count(known & truth & ~flagged).alias("fn"),
        count(known & truth & hit).alias("cwe_correct"),
        count(known & ((truth & flagged & hit) | (~truth & ~flagged))).alias("joint_correct"),
    ]
    out = rows.groupBy(*(by or [])).agg(*cells)
    c = F.col
    scored = c("tp") + c("fp") + c("tn") + c("fn")
    return out.select(
        "*",
        scored.alias("scored"),
        share(c("tp") + c("tn"), scored).alias("accuracy"),
        share(c("tp"), c("tp") + c("fp")).alias("precision"),
        share(c("tp"), c("tp") + c("fn")).alias("recall"),
        share(c("tn"), c("tn") + c("fp")).alias("specificity"),
        share(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"),
        share(c("cwe_correct"), c("tp") + c("fn")).alias("cwe_accuracy"),
        share(c("joint_correct"), scored).alias("joint_accuracy"),
    )


def paired(rows: DataFrame, pair: str, true_label: str = "true_label", predicted: str = "predicted_label", cwe_hit: Column | None = None) -> DataFrame:
    """Of pairs with both sides: flagged, cleared and ideal ones, in two aggregates without a self join."""
    bad, safe = F.col(true_label) == "VULNERABLE", F.col(true_label) == "SAFE"
    last = lambda test, value: F.max_by(F.when(test, value), F.when(test, F.lit(1)))
    hit = cwe_hit if cwe_hit is not None else F.lit(True)
    sides = rows.groupBy(pair).agg(last(bad, F.col(predicted)).alias("v"), last(safe, F.col(predicted)).alias("s"), F.bool_or(bad & hit).alias("hit"), F.bool_or(bad).alias("has_v"), F.bool_or(safe).alias("has_s")).where("has_v and has_s")
    flagged, cleared = F.col("v") == "VULNERABLE", F.col("s") == "SAFE"
    counted = sides.agg(F.count("*").alias("pairs"), F.count_if(flagged).alias("parent_flagged"), F.count_if(cleared).alias("fix_cleared"), F.count_if(flagged & cleared & F.col("hit")).alias("ideal"))
    rate = lambda c: share(F.col(c), F.col("pairs")).alias(f"{c}_rate")
    return counted.select("*", rate("ideal"), rate("parent_flagged"), rate("fix_cleared"))


def latency(rows: DataFrame, seconds: str, by: list[str] | None = None, places: int = 4) -> DataFrame:
    """Count, mean, median, p90, least, most and rows a second; p90 is the value at place ⌊0.9·(n−1)⌋, not between two."""
    s, n, keys = F.col(seconds), F.count(F.col(seconds)), by or []
    known = rows.where(s.isNotNull())
    sums = known.groupBy(*keys).agg(n.alias("n"), F.round(F.avg(s), places).alias("mean"), F.min(s).alias("least"), F.max(s).alias("most"), F.round(F.try_divide(n, F.sum(s)), places).alias("per_second"))
    size = F.col("n")
    at = {"__lo": F.floor((size - 1) / 2), "__hi": F.floor(size / 2), "p90": F.floor(F.lit(0.9) * (size - 1))}
    found = selection.places(known, s, at, keys).withColumn("median", F.round((F.col("__lo").cast("double") + F.col("__hi").cast("double")) / 2, places)).drop("__lo", "__hi", "n")
    if not keys:
        return sums.crossJoin(F.broadcast(found)).select("n", "mean", "median", "least", "most", "per_second", F.col("p90").cast(known.schema[seconds].dataType))
    named = found.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "median", "p90")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return sums.join(named, same).select(*keys, "n", "mean", "median", "least", "most", "per_second", F.col("p90").cast(known.schema[seconds].dataType))


def category_shares(rows: DataFrame, column: str) -> DataFrame:
    """Rows of each category and their percentage."""
    from pyspark.sql import Window

    counted = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counted.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


def scorecard(scored: DataFrame) -> DataFrame:
    """Rates and means of six tasks over scored rows, nulls left out of the means."""
    rate = lambda c: share(F.count_if(F.coalesce(F.col(c), F.lit(False))), F.count("*"))
    mean = lambda c: F.round(F.avg(c), 4)
    return scored.agg(
        F.count("*").alias("n"),
        rate("flagged").alias("detection"),
        rate("cwe_correct").alias("cwe"),
        rate("owasp_correct").alias("owasp"),
        rate("severity_correct").alias("severity"),
        rate("cvss_within_1").alias("cvss_within_1"),
        mean("cvss_abs_err").alias("cvss_mae"),
        mean("explanation_f1").alias("explanation_f1"),
        rate("location_hit").alias("location"),
        mean("similarity").alias("fix_similarity"),
        rate("fp_within").alias("fp_within"),
        rate("fn_within").alias("fn_within"),
    )
