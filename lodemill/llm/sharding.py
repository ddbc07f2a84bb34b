"""Sharding by extendible hashing: only buckets beyond the byte limit split on another hash bit.

The directory maps prefixes of a key's 32-bit hash to shards. Bytes are summed by a prefix that is
a few bits longer than the average shard needs, all shorter prefixes' sums follow from those, and
a prefix's shard is its shortest one within the limit. What is still too large is summed again
over longer prefixes, until it fits or the hash has no more bits: rows with one hash, such as all
rows of a hot key, then go to pages of the shard, each within the limit, counted on in every input
partition. A single row beyond the limit has a shard or a page of its own and is marked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodemill.llm.common import Shared

#: Bytes of text that a task writes.
TASK_BYTES = 256 << 20

BITS = 32
#: Bits beyond the average shard's that are summed at first, and bits added for what is still too large.
SPARE, MORE = 3, 8
#: Directory rows up to which it is broadcast to the rows; beyond, it is joined.
BROADCAST_ROWS = 100_000


def key_hash(key: Column) -> Column:
    """The first 32 bits of the MD5 of the key's text; a null key is the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def prefix(hashed: Column, bits: int | Column) -> Column:
    """The first bits of a hash as a number."""
    return F.shiftright(hashed, BITS - bits) if isinstance(bits, int) else F.floor(hashed / F.pow(F.lit(2.0), F.lit(BITS) - bits)).cast("long")


def directory(sizes: DataFrame, limit: int, shared: Shared) -> tuple[DataFrame, list[int]]:
    """Rows (bits, prefix, bytes, rows, fits) of the shards of (h, bytes), and the bit counts that occur.

    Shards at the last bit that do not fit have ``fits`` false.
    """
    total = sizes.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    upto = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE)
    begun, parts, rest = 0, [], sizes
    while True:
        leaves = shared.table(rest.groupBy(prefix(F.col("h"), upto).alias("leaf")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")), f"leaves-{upto}")
        every = leaves.select("leaf", "bytes", "rows", F.explode(F.sequence(F.lit(begun), F.lit(upto))).alias("bits"))
        level = every.groupBy("bits", F.floor(F.col("leaf") / F.pow(F.lit(2.0), F.lit(upto) - F.col("bits"))).cast("long").alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        level = shared.table(level.withColumn("fits", F.col("bytes") <= limit), f"levels-{upto}")
        # A shard is a prefix that fits while the one a bit shorter does not.
        parent = level.where("not fits").select((F.col("bits") + 1).alias("bits"), F.col("prefix").alias("up"))
        split = level.withColumn("up", F.shiftright("prefix", 1)).join(parent, ["bits", "up"], "left_semi").select("bits", "prefix", "bytes", "rows", "fits")
        shards = split.unionByName(level.where(F.col("bits") == 0)) if begun == 0 else split
        parts.append(shards.where("fits"))
        large = shards.where(~F.col("fits") & (F.col("bits") == upto))
        if upto == BITS:
            parts.append(large)
            break
        large = shared.table(large.select("prefix"), f"large-{upto}")
        if not large.limit(1).count():
            break
        rest = sizes.join(large, prefix(F.col("h"), upto) == large.prefix, "left_semi")
        begun, upto = upto, min(BITS, upto + MORE)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = shared.table(out.coalesce(8), "directory")
    return out, sorted(r["bits"] for r in out.select("bits").distinct().collect())


def assign(rows: DataFrame, limit: int, shared: Shared, key: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """``key``, ``bytes``, ``shard``, ``bits``, ``shard_bytes``, ``shard_rows`` and ``oversize`` of each row.

    ``shard`` is the prefix in binary digits (``*`` for no bit), with a page after a dot where rows
    of one hash do not fit together. A null text has no bytes; repeated rows count each; a null
    key is a key of its own. Other columns are not read, but with ``carry`` the whole row goes along
    as ``row``.
    """
    also = ["row"] if carry else []
    own = rows.select(F.col(key), *([F.struct("*").alias("row")] if carry else []), key_hash(F.col(key)).alias("h"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"))
    # Where a row comes from splits rows of one hash into pages later: joins bring them together.
    sized = shared.table(own.withColumn("part", F.spark_partition_id()), "sized")
    shards, levels = directory(sized.select("h", "bytes"), limit, shared)
    digits = F.when(F.col("bits") == 0, F.lit("*")).otherwise(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("bits"), F.lit("0")))
    named = shards.select(F.col("bits").alias("at_bits"), F.col("prefix").alias("at"), digits.alias("shard"), "bits", F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"), "fits")
    small = named.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # A row has one prefix for each bit count that occurs; one of them is in the directory.
    tried = sized.withColumn("try", F.explode(F.array(*(F.struct(F.lit(b).alias("b"), prefix(F.col("h"), b).alias("p")) for b in levels)))) if levels else sized.withColumn("try", F.struct(F.lit(0).alias("b"), F.lit(0).cast("long").alias("p"))).limit(0)
    found = tried.join(F.broadcast(named) if small else named, (F.col("try.b") == F.col("at_bits")) & (F.col("try.p") == F.col("at"))).drop("try", "at_bits", "at")
    fitting = found.where("fits").select(key, "bytes", "shard", "bits", "shard_bytes", "shard_rows", *also)
    if not shards.where("not fits").limit(1).count():
        return fitting.withColumn("oversize", F.lit(False))
    # Rows of one hash: each input partition fills pages of its own.
    crowd = found.where("not fits")
    before = Window.partitionBy("h", "part").orderBy("bytes", key)
    paged = shared.table(crowd.withColumn("page", F.floor((F.sum("bytes").over(before.rowsBetween(Window.unboundedPreceding, 0)) - 1) / F.lit(max(1, limit // 2))).cast("long")), "paged")
    # A row that straddles two pages is counted where it ends, so a page holds half the limit and one row.
    alone = paged.withColumn("own", F.col("bytes") > limit // 2)
    turn = F.row_number().over(Window.partitionBy("h", "part").orderBy("bytes", key))
    alone = alone.withColumn("page", F.when(F.col("own"), F.concat(F.lit("r"), turn.cast("string"))).otherwise(F.col("page").cast("string")))
    pages = alone.withColumn("shard", F.concat_ws(".", "shard", F.col("part").cast("string"), "page"))
    sums = pages.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    full = pages.drop("shard_bytes", "shard_rows").join(sums, "shard").select(key, "bytes", "shard", "bits", "shard_bytes", "shard_rows", *also)
    return fitting.unionByName(full).withColumn("oversize", F.col("shard_bytes") > limit)


def write_shards(rows: DataFrame, limit: int, shared: Shared, path: str, key: str = "doc_id", text_col: str = "text", task_bytes: int = TASK_BYTES) -> None:
    """Write the rows by shard: one folder a shard, and a task's rows of one shard in one file. Keys may be null and repeat.

    There are as many tasks as the texts have ``task_bytes``.
    """
    placed = shared.table(assign(rows, limit, shared, key, text_col, carry=True).select("row", "bytes", "shard"), "placed")
    total = placed.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    placed.select("row.*", "shard").repartition(max(8, -(-total // task_bytes)), "shard").sortWithinPartitions("shard").write.partitionBy("shard").parquet(path)


#: The shards of the query over ``documents``; pages do not occur there.
def shard_sql(limit: int) -> str:
    return f"""
WITH sized AS (
  SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h,
         CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes
  FROM documents),
levels AS (SELECT CAST(range AS INTEGER) AS bits FROM range(0, 33)),
sums AS (
  SELECT bits, h >> (32 - bits) AS prefix, CAST(sum(bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows
  FROM sized, levels GROUP BY ALL),
best AS (
  SELECT h, min(s.bits) AS bits FROM (SELECT DISTINCT h FROM sized) AS d, sums AS s
  WHERE s.prefix = d.h >> (32 - s.bits) AND s.shard_bytes <= {limit} GROUP BY h)
SELECT doc_id, bytes,
       CASE WHEN b.bits = 0 THEN '*' ELSE right(lpad(bin(s.prefix), 32, '0'), b.bits) END AS shard,
       b.bits AS bits, shard_bytes, shard_rows, FALSE AS oversize
FROM sized JOIN best AS b USING (h) JOIN sums AS s ON s.bits = b.bits AND s.prefix = h >> (32 - b.bits)"""
