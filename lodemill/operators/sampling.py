"""Samples: seeded, balanced and stratified."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodemill.operators.checks import require
from lodemill.operators.numbering import numbered
from lodemill.sources.readers import Scratch


def turn_of(seed: int, *keys: Column) -> Column:
    """A place in a random order that is the same for one seed: the MD5 of the seed and the keys' texts."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))


def seeded(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """N rows at random, the same for one seed however the rows are dealt out."""
    return rows.orderBy(turn_of(seed, F.col(key)), key).limit(n)


@contextmanager
def _limits(spark, most: int):
    """Windows that are cut at so many rows are cut in the map tasks already."""
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(max(most + 1, int(before or 1000))))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def balanced(rows: DataFrame, per_repo: int, per_folder: int, seed: int = 42, repository: str = "repository", path: str = "path") -> DataFrame:
    """In a seeded order, rows while their repository, folder and sibling name are below their caps.

    Caps count accepted rows alone, so a row depends on those before it; but one that would be taken even if all open
    rows before it were, is taken at once, together with all such rows, and one with a full counter goes. Rounds of this
    settle every row as the order itself would; each takes the first open row of every repository at least. A round looks
    at a repository's first open rows only, as many as its cap leaves, and finds them in the map tasks,
    so one repository may hold all rows. A row without a repository or path counts as one of its own kind.
    """
    require("per_repo", per_repo, 1)
    require("per_folder", per_folder, 1)
    scratch = Scratch(rows.sparkSession, "balanced")
    parts = F.split(F.coalesce(F.col(path), F.lit("")), "/")
    up = lambda n: F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - n, F.lit(0))), "/")
    turn = turn_of(seed, F.col(repository), F.col(path))
    keyed = scratch.keep(rows.withColumns({"__turn": turn, "__id": F.monotonically_increasing_id()}), "rows")
    keys = {"repo": ["__repo"], "folder": ["__repo", "__folder"], "name": ["__repo", "__up", "__name"]}
    caps = {"repo": per_repo, "folder": per_folder, "name": per_folder}
    open_ = keyed.select("__id", "__turn", F.coalesce(F.col(path), F.lit("")).alias("__path"), F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("__repo"), up(1).alias("__folder"), up(2).alias("__up"), F.element_at(parts, -1).alias("__name"))
    taken, used, r = None, {}, 0
    order = ["__turn", "__path", "__id"]
    while True:
        place = {k: F.row_number().over(Window.partitionBy(*by).orderBy(*order)) for k, by in keys.items()}
        first = open_.withColumn("__at", place["repo"]).where(F.col("__at") <= per_repo)
        for k, by in keys.items():
            first = first.join(used[k], by, "left") if used else first.withColumn(f"__used_{k}", F.lit(0))
            first = first.withColumn(f"__room_{k}", caps[k] - F.coalesce(f"__used_{k}", F.lit(0))).drop(f"__used_{k}")
        first = first.where("__at <= __room_repo").withColumns({"__f": place["folder"], "__n": place["name"]})
        with _limits(rows.sparkSession, per_repo):
            now = scratch.keep(first.where("__f <= __room_folder AND __n <= __room_name").select("__id", *dict.fromkeys(sum(keys.values(), []))), f"taken-{r}")
        taken = now if taken is None else taken.unionByName(now)
        used = {k: scratch.keep(taken.groupBy(*by).agg(F.count("*").alias(f"__used_{k}")), f"used-{r}-{k}") for k, by in keys.items()}
        left = open_.join(now.select("__id"), "__id", "left_anti")
        for k, by in keys.items():
            left = left.join(used[k].where(F.col(f"__used_{k}") >= caps[k]).select(*by), by, "left_anti")
        open_ = scratch.keep(left, f"open-{r}")
        if open_.isEmpty():
            return keyed.join(taken.select("__id"), "__id", "left_semi").drop("__turn", "__id")
        r += 1


def strided(rows: DataFrame, strata: list[tuple[Column, int]], order: str, total: int) -> DataFrame:
    """Every k-th row of each stratum up to its share, then the first others up to a total."""
    label = None
    for k, (test, _) in enumerate(strata):
        label = F.when(test, k) if label is None else label.when(test, k)
    share = F.element_at(F.array(*[F.lit(n) for _, n in strata]), F.col("__s") + 1)
    labelled = rows.withColumn("__s", label)
    placed = numbered(labelled.where(F.col("__s").isNotNull()), [order], "__i", ["__s"], "__n")
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / share))
    picked = (F.col("__i") % step == 0) & (F.floor(F.col("__i") / step) < share)
    both = placed.withColumn("__p", F.when(picked, 0).otherwise(1)).unionByName(labelled.where(F.col("__s").isNull()).withColumn("__p", F.lit(1)), allowMissingColumns=True)
    return both.orderBy("__p", F.when(F.col("__p") == 0, F.col("__s")), order).limit(total).drop("__s", "__i", "__n", "__p")


def cap_group(rows: DataFrame, test: Column, key: str, most: int, seed: int = 42) -> DataFrame:
    """All rows but those of one dominant group beyond a number, chosen by a seeded hash."""
    return rows.where(~test | test.isNull()).unionByName(rows.where(test).orderBy(turn_of(seed, F.col(key)), key).limit(most))


#: Bytes of text for each partition of rows of like length.
LENGTH_BYTES = 64 << 20


def by_length(rows: DataFrame, text: str, partitions: int) -> DataFrame:
    """Rows of like length together, for batches that waste little; ``partitions`` at least, and more for much text.

    Rows of one length go by a hash of the whole row, so that a frequent length is spread.
    """
    size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    whole = F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind])
    return rows.repartitionByRange(max(partitions, -(-size // LENGTH_BYTES)), F.length(text), whole).sortWithinPartitions(F.length(text))
