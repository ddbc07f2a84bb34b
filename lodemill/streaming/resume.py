"""Incremental appends: a stream of records in which every key is written once.

Beside the records lies an index of their keys, by hash bucket: for each batch and bucket the keys'
hashes and a Bloom filter over them. A new batch asks the filters first; only buckets in which some
key may be known are read, and only their hashes, never the records.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEYS = ["repository", "branch", "path", "sha"]
#: Parts of the key index; bits of a filter for each key, and bits that a key sets.
BUCKETS, BITS, HASHES = 256, 12, 6


def _there(spark: SparkSession, place: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _keyed(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Rows with the hash of their key, null apart from every text, and its bucket."""
    told = F.concat(*[F.coalesce(F.concat(F.length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string")), F.lit("-;")) for k in keys])
    return rows.withColumn("__key", F.md5(told.cast("binary"))).withColumn("__bucket", F.pmod(F.xxhash64("__key"), F.lit(buckets)).cast("int"))


def _bits(keys: list[str], size: int) -> np.ndarray:
    """The bits that each key sets in a filter of a size: HASHES of each, by double hashing."""
    raw = np.frombuffer(bytes.fromhex("".join(keys)), ">u8").reshape(-1, 2).astype(np.uint64)
    step = np.arange(HASHES, dtype=np.uint64)
    return ((raw[:, :1] + step * (raw[:, 1:] | np.uint64(1))) % np.uint64(size)).astype(np.int64)


def _filters(batches) -> Iterator[pa.RecordBatch]:
    """One filter for each bucket of sorted rows (bucket, key)."""
    held: dict[int, list[str]] = {}

    def out(bucket: int) -> pa.RecordBatch:
        keys = held.pop(bucket)
        size = max(64, BITS * len(keys))
        bits = np.zeros(size, bool)
        bits[_bits(keys, size).reshape(-1)] = True
        return pa.RecordBatch.from_pydict({"__bucket": pa.array([bucket], pa.int32()), "size": pa.array([size], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    for b in batches:
        for bucket, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for done in [x for x in held if x != bucket]:
                yield out(done)
            held.setdefault(bucket, []).append(key)
    for bucket in list(held):
        yield out(bucket)


def _perhaps(left: pa.Table, right: pa.Table) -> pa.Table:
    """The keys of a bucket that one of its filters holds."""
    keys = left.column("__key").to_pylist()
    maybe = np.zeros(len(keys), bool)
    for size, bits in zip(right.column("size").to_pylist(), right.column("bits").to_pylist(), strict=True):
        if keys:
            maybe |= np.unpackbits(np.frombuffer(bits, np.uint8))[_bits(keys, size)].all(1)
    return left.filter(pa.array(maybe))


def known_keys(rows: DataFrame, target: str, but: str = "") -> DataFrame:
    """Of keyed rows (``__bucket``, ``__key``) those that the target's index has, but for one batch's.

    Reads the filters, and the hashes of the buckets in which a filter holds a key.
    """
    spark, index = rows.sparkSession, f"{target}/_keys"
    filters = spark.read.parquet(f"{index}/filters").where(F.col("batch") != but)
    asked = rows.select("__bucket", "__key")
    maybe = asked.groupBy("__bucket").cogroup(filters.select("__bucket", "size", "bits").groupBy("__bucket")).applyInArrow(_perhaps, "__bucket int, __key string")
    hit = sorted(r[0] for r in maybe.select("__bucket").distinct().collect())  # as many as there are buckets at most
    if not hit:
        return asked.limit(0)
    hashes = spark.read.option("basePath", f"{index}/hashes").parquet(*[f"{index}/hashes/bucket={b}" for b in hit])
    return maybe.join(hashes.where(F.col("batch") != but).select(F.col("bucket").alias("__bucket"), "__key"), ["__bucket", "__key"], "left_semi")


def append_batch(batch: DataFrame, target: str, name: str, keys: list[str] | None = None, buckets: int = BUCKETS) -> None:
    """Append the records whose keys the target does not have, as the batch ``name``; the same batch again takes its own place.

    Of records with one key in a batch one stays. ``buckets`` belongs to the target and must stay the same.
    """
    by, spark, index = keys or KEYS, batch.sparkSession, f"{target}/_keys"
    fresh = _keyed(batch.dropDuplicates(by), by, buckets)
    if _there(spark, f"{index}/filters"):
        fresh = fresh.join(known_keys(fresh, target, name).select("__key"), "__key", "left_anti")
    place = f"{target}/batch={name}"
    fresh.drop("__key", "__bucket").write.mode("overwrite").parquet(place)
    written = _keyed(spark.read.schema(batch.schema).parquet(place), by, buckets).select("__bucket", "__key").repartition("__bucket").sortWithinPartitions("__bucket", "__key")
    once = {"partitionOverwriteMode": "dynamic"}
    written.select(F.col("__bucket").alias("bucket"), "__key", F.lit(name).alias("batch")).write.mode("overwrite").options(**once).partitionBy("bucket", "batch").parquet(f"{index}/hashes")
    made = written.mapInArrow(_filters, "__bucket int, size long, bits binary").withColumn("batch", F.lit(name))
    made.write.mode("overwrite").options(**once).partitionBy("batch").parquet(f"{index}/filters")


def read_appended(spark: SparkSession, target: str) -> DataFrame:
    """The records of a target."""
    return spark.read.parquet(target).drop("batch")


def append_new(stream: DataFrame, target: str, checkpoint: str, keys: list[str] | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Append records whose keys the target does not have; a batch that is tried again adds nothing twice."""
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        append_batch(batch, target, f"{run}-{number}", keys, buckets)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", ts: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums of events by window and kind, for streams and tables alike."""
    timed = events.withColumn("__t", F.col(ts).cast("timestamp"))
    held = timed.withWatermark("__t", late) if events.isStreaming else timed
    return held.groupBy(F.window("__t", size).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")
