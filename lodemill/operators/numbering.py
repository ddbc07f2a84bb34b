"""Global row numbers without sorting a table in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodemill.sources.readers import Scratch

#: The bits of a number given by ``monotonically_increasing_id`` that count within a partition.
_INSIDE = 33


def numbered(rows: DataFrame, order: list[str], name: str, within: list[str] | None = None, total: str = "__total") -> DataFrame:
    """Rows with their place by ``order``, from 0, among all or among those with the same ``within``, and how many these are.

    Rows are dealt by ranges of the order, sorted, and stored with their place in their range; what the ranges before
    hold is added. Equal keys go by a hash of the whole row, so that a frequent key is spread over ranges;
    equal rows are placed in any order. Nulls come first.
    """
    groups, spark = within or [], rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [*[F.col(g) for g in groups], *[F.col(c) for c in order], F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind])]
    ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    held = Scratch(spark, "numbered").keep(ranged, "rows").withColumn("__range", F.shiftright("__id", _INSIDE))
    counts = held.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")  # a row for each range
    starts = counts.select("__range", before.alias("__before"))
    inside = F.col("__id").bitwiseAND(F.lit((1 << _INSIDE) - 1))
    placed = held.join(F.broadcast(starts), "__range").withColumn(name, F.col("__before") + inside).drop("__id", "__range", "__before")
    if not groups:
        every = counts.agg(F.sum("__n").alias(total))
        return placed.crossJoin(F.broadcast(every)).withColumn(name, F.col(name).cast("long"))
    sizes = placed.groupBy(*[F.col(g).alias(f"__g{k}") for k, g in enumerate(groups)]).agg(F.min(name).alias("__first"), F.count("*").alias(total))
    same = F.lit(True)
    for k, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{k}"))
    return placed.join(sizes, same).withColumn(name, (F.col(name) - F.col("__first")).cast("long")).drop("__first", *[f"__g{k}" for k in range(len(groups))])
