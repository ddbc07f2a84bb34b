"""Security posture of repositories: documentation signals, advisories, dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodemill.functions.regex import all_matches, found
from lodemill.functions.text import base_name, signals
from lodemill.rules import documents as R


def doc_signals(docs: DataFrame, sample: DataFrame, repository: str = "repository", path: str = "path", text: str = "text") -> DataFrame:
    """Flags and counts of each repository of the sample; one without documents has none.

    Policy flags are of SECURITY.md files alone. A signal counts if any file has it; signals that
    would only match across two files' ends do not.
    """
    name = F.upper(base_name(F.col(path)))
    is_policy, is_readme = name == "SECURITY.MD", F.startswith(name, F.lit("README"))
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    guard = {k: any_of(v).alias(k) for k, v in signals(F.col(text), R.GUARDRAILS).items()}
    policy = {k: any_of(is_policy & v).alias(k) for k, v in signals(F.col(text), R.POLICIES).items()}
    kept = docs.join(sample.select(repository).distinct(), repository, "left_semi")
    out = kept.groupBy(repository).agg(
        F.count("*").alias("n_docs"),
        any_of(is_readme).alias("has_readme"),
        any_of(is_policy).alias("has_security"),
        F.coalesce(F.sum(F.when(is_policy, F.length(text))) + F.count_if(is_policy) - 1, F.lit(0)).alias("security_chars"),
        *guard.values(),
        *policy.values(),
    )
    full = sample.select(repository).distinct().join(out, repository, "left").fillna(0).fillna(False)
    return full.withColumn("guardrail_signals", sum(F.col(k).cast("int") for k in guard))


def advisory_ids(texts: DataFrame, repository: str, source: str, text: str) -> DataFrame:
    """Distinct CVE and GHSA ids of each repository and source, in upper case, and all mentions."""
    cve, ghsa = all_matches(F.col(text), R.CVE, ignore_case=True), all_matches(F.col(text), R.GHSA, ignore_case=True)
    both = texts.select(repository, source, F.transform(F.concat(cve, ghsa), F.upper).alias("ids"))
    counted = both.groupBy(repository, source).agg(F.sum(F.size("ids")).alias("mentions"))
    ids = both.select(repository, source, F.explode("ids").alias("id")).groupBy(repository, source).agg(F.array_sort(F.collect_set(F.when(F.startswith("id", F.lit("CVE")), F.col("id")))).alias("cves"), F.array_sort(F.collect_set(F.when(F.startswith("id", F.lit("GHSA")), F.col("id")))).alias("ghsas"))
    empty = F.array().cast("array<string>")
    return counted.join(ids, [repository, source], "left").withColumns({"cves": F.coalesce("cves", empty), "ghsas": F.coalesce("ghsas", empty)})


def signal_union(rows: DataFrame, sources: list[str], strict_case: bool = False) -> DataFrame:
    """Per repository distinct ids over all sources, the sources with any, and a flag.

    Rows have an array of ids for each source. With ``strict_case`` ids that differ in case alone
    count apart, as they do where one source keeps its case.
    """
    every = F.flatten(F.array(*[F.coalesce(F.col(s), F.array().cast("array<string>")) for s in sources]))
    ids = F.array_distinct(every if strict_case else F.transform(every, F.upper))
    named = F.array_compact(F.array(*[F.when(F.size(F.col(s)) > 0, s) for s in sources]))
    starts = lambda p: F.size(F.filter(ids, lambda i: F.startswith(F.upper(i), F.lit(p))))
    return rows.withColumns({"n_cve": starts("CVE-"), "n_ghsa": starts("GHSA-"), "sources": F.array_join(named, "; "), "any_signal": F.size(ids) > 0})


def dependency_risk(packages: DataFrame, vulnerabilities: DataFrame, repository: str = "repository", keys: tuple[str, ...] = ("ecosystem", "name", "version"), shown: int = 5, ids_shown: int = 3) -> DataFrame:
    """Packages, vulnerable ones (repeated ones count), distinct ids, their ratio, and the worst packages as text.

    ``vulnerabilities`` has one row for a package and id.
    """
    listed = vulnerabilities.select(*keys, "vuln_id").distinct()
    known = listed.groupBy(*keys).agg(F.count("vuln_id").alias("n_ids"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("vuln_id"))
    first = listed.where("vuln_id IS NOT NULL").withColumn("nth", nth).where(F.col("nth") <= ids_shown).groupBy(*keys).agg(F.array_sort(F.collect_list("vuln_id")).alias("ids"))
    # A repository's packages once each, with how often it has them: no list of ids meets a row of packages.
    joined = packages.groupBy(repository, *keys).agg(F.count("*").alias("n")).join(known, list(keys), "left")
    bad = F.col("n_ids").isNotNull()
    counts = joined.groupBy(repository).agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("vulnerable"), F.count_if(bad).alias("vulnerable_packages"))
    one = joined.where(bad)
    # Ids of the same packages are in the same repositories: each such set of packages is looked at once, with its number of ids.
    sets = listed.where("vuln_id IS NOT NULL").groupBy("vuln_id").agg(F.sort_array(F.collect_list(F.struct(*keys))).alias("packages"))
    sets = sets.groupBy("packages").agg(F.count("*").alias("alike"), F.min("vuln_id").alias("of"))
    held = sets.select("of", "alike", F.explode("packages").alias("p")).select("of", "alike", "p.*")
    ids = one.select(repository, *keys).join(held, list(keys)).groupBy(repository, "of").agg(F.first("alike").alias("alike")).groupBy(repository).agg(F.sum("alike").alias("distinct_ids"))
    place = F.row_number().over(Window.partitionBy(repository).orderBy(F.desc("n_ids"), "name", "version", "ecosystem"))
    told = F.concat("name", F.lit("@"), "version", F.lit(" ("), F.array_join(F.coalesce("ids", F.array().cast("array<string>")), ", "), F.lit(")"))
    few = one.withColumn("place", place).where(F.col("place") <= shown).join(first, list(keys), "left")
    worst = few.groupBy(repository).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", told.alias("t")))), lambda s: s["t"]), "; ").alias("worst"))
    out = counts.join(ids, repository, "left").join(worst, repository, "left").fillna(0, ["distinct_ids"]).fillna("", ["worst"])
    return out.withColumn("ratio", F.round(F.coalesce(F.try_divide(F.col("vulnerable"), F.col("total")), F.lit(0.0)), 4))


def missed_changelogs(rows: DataFrame, names: str, canonical: list[str]) -> DataFrame:
    """File names that look like a changelog's but are not among the canonical ones."""
    return rows.withColumn("missed", F.array_join(F.filter(names, lambda n: found(n, R.CHANGELOG_NAME) & ~F.upper(n).isin(canonical)), ", "))
