"""De-duplication, ranking and set operations with explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodemill.functions.scalars import code_key
from lodemill.functions.text import normal_hash, version_key


def keep_one(rows: DataFrame, keys: list[Column | str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order. One pass of partial aggregation, no sort of groups."""
    whole = F.struct(*rows.columns)
    best = rows.groupBy(*[k.alias(f"__k{i}") if isinstance(k, Column) else F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min_by(whole, F.struct(*order)).alias("__row"))
    return best.select("__row.*")


def top_n(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, with their ``place``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def union_ranked(*tables: DataFrame) -> DataFrame:
    """The tables one after another, with ``source_rank``; missing columns are null."""
    out = None
    for k, t in enumerate(tables):
        ranked = t.withColumn("source_rank", F.lit(k))
        out = ranked if out is None else out.unionByName(ranked, allowMissingColumns=True)
    return out


def duplicate_counts(rows: DataFrame, key: Column) -> DataFrame:
    """Distinct keys, rows beyond the first of each, and rows in groups of several."""
    groups = rows.groupBy(key.alias("k")).agg(F.count("*").alias("n"))
    return groups.agg(F.count("*").alias("uniques"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extras"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("grouped"))


def canonical_texts(docs: DataFrame, repository: str = "repository", path: str = "path", text: str = "text", ord_: str = "ord") -> DataFrame:
    """Every row with the ``canonical`` row (its ``ord``) whose text stands for it.

    The shortest path stands for a page's versions, the first group for groups of equal texts.
    """
    rows = docs.where(F.col(text).isNotNull()).withColumn("__v", version_key(F.col(repository), F.col(path)))
    size = F.struct(F.length(path), F.col(ord_))
    groups = rows.groupBy("__v").agg(F.min(ord_).alias("__first"), F.min_by(F.struct(F.col(ord_).alias("o"), F.col(text).alias("t")), size).alias("__best"))
    hashed = groups.select("__v", "__first", F.col("__best.o").alias("__o"), normal_hash(F.col("__best.t")).alias("__h"))
    owner = hashed.groupBy("__h").agg(F.min_by("__o", "__first").alias("canonical"))
    mapped = hashed.join(owner, "__h").select("__v", "canonical")
    return rows.join(mapped, "__v").drop("__v")


def exam_split(rows: DataFrame, kb: DataFrame) -> DataFrame:
    """The exam: in order, without ids and code of the knowledge base, one row for each id and code.

    Advisory rows (kind ``ghsa``) come first; they are kept whatever their code, and own it. Rows
    have ``sample_id``, ``language``, ``code``, ``kind`` and ``ord``.
    """
    keyed = rows.withColumn("__key", code_key(F.col("language"), F.col("code"))).withColumn("__g", F.when(F.col("kind") == "ghsa", 0).otherwise(1))
    kb_ids, kb_keys = kb.select("sample_id").distinct(), kb.select(code_key(F.col("language"), F.col("code")).alias("__key")).distinct()
    left = keyed.join(kb_ids, "sample_id", "left_anti")
    left = left.where("__g = 0").unionByName(left.where("__g = 1").join(kb_keys, "__key", "left_anti"))
    order = [F.col("__g"), F.col("ord")]
    one_id = keep_one(left, ["sample_id"], order)
    by_key = Window.partitionBy("__key").orderBy(*order)
    return one_id.withColumn("__n", F.row_number().over(by_key)).where("__g = 0 or __n = 1").drop("__key", "__g", "__n")


def only_new(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not known yet."""
    return rows.join(known.select(*keys).distinct(), keys, "left_anti")


def both_sides(pairs: DataFrame, vulnerable: str, fixed: str, id_col: str) -> DataFrame:
    """Two rows of each pair, vulnerable and safe, in one pass."""
    side = lambda label, code, end: F.struct(F.concat(F.col(id_col), F.lit(end)).alias("case_id"), F.lit(label).alias("label"), F.col(code).alias("code"))
    rest = [c for c in pairs.columns if c not in (vulnerable, fixed)]
    return pairs.select(*rest, F.explode(F.array(side("vulnerable", vulnerable, "_VULN"), side("safe", fixed, "_FIXED"))).alias("s")).select(*rest, "s.*")
