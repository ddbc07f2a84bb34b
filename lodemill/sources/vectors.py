"""A cache of vectors that knows what it holds."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, place: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _write(spark: SparkSession, place: str, text: str) -> None:
    """A whole file or none."""
    fs, _ = _fs(spark, place)
    path = spark._jvm.org.apache.hadoop.fs.Path
    folder, _, name = place.rpartition("/")
    part = path(f"{folder}/.{name}.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, path(place)):
        raise OSError(f"{place} could not be published")


def _read(spark: SparkSession, place: str) -> str:
    fs, path = _fs(spark, place)
    source = fs.open(path)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def manifests(spark: SparkSession, place: str) -> list[dict]:
    """The batches that were written whole, in order; what is unreadable does not count."""
    fs, path = _fs(spark, place)
    if not fs.exists(path):
        return []
    found = []
    for entry in sorted(str(x.getPath()) for x in fs.listStatus(path)):
        if entry.endswith(".json") and not entry.rpartition("/")[2].startswith("."):
            try:
                found.append(json.loads(_read(spark, entry)))
            except ValueError:
                continue
            except Py4JJavaError as e:
                if "ChecksumException" not in str(e.java_exception):
                    raise
    return found


def embedding_cache(rows: DataFrame, signature: dict, folder: str, make: Callable[[DataFrame], DataFrame], key: str, content: str, vector: str = "embedding") -> DataFrame:
    """``key`` and ``vector`` (an array) for each row; those that the cache lacks are made, the others read.

    A vector belongs to a key, the hash of its ``content`` and the ``signature`` of what made it: a row that
    is new or has changed is made, one that is gone is not returned, another signature starts anew. ``make`` gives ``key`` and
    ``vector`` for rows; it must return each row once, with vectors of the length that the cache has. A batch counts once its
    manifest (signature, rows, dimensions) is there, which is written last and whole; what an earlier run left
    half written is not read. Null keys have no vector; null contents are a content of their own.
    """
    spark = rows.sparkSession
    stamp = json.dumps(signature, sort_keys=True, ensure_ascii=False)
    place = f"{folder.rstrip('/')}/signature={hashlib.sha256(stamp.encode()).hexdigest()[:16]}"
    known = [m for m in manifests(spark, place) if m.get("signature") == signature]
    digest = F.sha2(F.coalesce(F.concat(F.lit("1"), F.col(content).cast("string")), F.lit("0")).cast("binary"), 256)
    asked = rows.where(F.col(key).isNotNull()).withColumn("__content", digest)
    read = lambda batches: spark.read.parquet(*[f"{place}/{m['batch']}" for m in batches])
    left = asked
    if known:
        left = asked.join(read(known).select(key, "__content"), [key, "__content"], "left_anti")
    if not left.isEmpty():
        batch = f"batch-{uuid.uuid4().hex}"
        made = make(left.drop("__content")).select(key, vector).join(left.select(key, "__content"), key)
        made.write.parquet(f"{place}/{batch}")
        got = spark.read.parquet(f"{place}/{batch}").agg(F.count("*").alias("n"), F.countDistinct(key).alias("keys"), F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high")).first()
        dims = {m["dimensions"] for m in known} | {got["low"], got["high"]}
        wanted = left.select(key).distinct().count()
        if got["n"] != wanted or got["keys"] != wanted or len(dims) > 1:
            raise ValueError(f"{wanted} rows were asked for, {got['n']} came, of lengths {sorted(map(str, dims))}")
        entry = {"signature": signature, "batch": batch, "rows": got["n"], "dimensions": got["low"]}
        _write(spark, f"{place}/manifest-{len(known):06d}-{batch}.json", json.dumps(entry, sort_keys=True))
        known.append(entry)
    if not known:
        return asked.select(key, F.lit(None).cast("array<double>").alias(vector)).limit(0)
    return read(known).join(asked.select(key, "__content").distinct(), [key, "__content"], "left_semi").select(key, vector)
