"""Exact order statistics by radix selection: values are counted by their leading bits, pass after pass.

A value becomes a number whose order is the value's, 64 bits wide. A pass counts, for each group and
each run of leading bits that is still asked for, the next bits; a running sum over these few counts tells in which
of them a place lies. After the last pass the bits are the value. A group of any size, with any
values, is spread over all tasks; only counts meet, DIGIT bits' worth for each group and place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits that a pass settles.
DIGIT = 16
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _codes(values: np.ndarray) -> np.ndarray:
    """Doubles as longs of the same order; both zeros are one, NaN is above all."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def _values(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < 0, codes ^ np.int64(0x7FFFFFFFFFFFFFFF), codes).view(np.float64)


def _mapped(rows: DataFrame, column: str, change, kind: str) -> DataFrame:
    """One column through numpy, the others as they are."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(column)
            made = pa.array(change(b.column(at).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([made if k == at else c for k, c in enumerate(b.columns)], names=b.schema.names)

    schema = ", ".join(f"`{f.name}` {kind if f.name == column else f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, schema)


def places(rows: DataFrame, value: Column, at: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """The values at some places of each group's ascending order: ``by`` (or nothing), ``n``, and a column for each name of ``at``.

    ``at`` gives places from 0 by ``n``, the group's number of values that are not null; a place outside has null, and so
    has a group without values. Decimals are taken as doubles; whole numbers stay longs. Null group keys are a group.
    """
    by = by or []
    held = rows.select(*by, value.alias("__v")).where("__v IS NOT NULL")
    whole = held.schema["__v"].dataType.simpleString() in _WHOLE
    if whole:
        coded = held.withColumn("__c", F.col("__v").cast("long")).drop("__v")
    else:
        coded = _mapped(held.withColumn("__c", F.col("__v").cast("double")).drop("__v"), "__c", _codes, "bigint")
    groups = [f"__g{k}" for k in range(len(by))]
    coded = coded.select(*[F.col(b).alias(g) for b, g in zip(by, groups, strict=True)], "__c")
    sizes = coded.groupBy(*groups).agg(F.count("*").alias("n"))
    names = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place.cast("long").alias("left")) for name, place in at.items()]))
    # What is asked for: of each group and name the leading bits that are settled, and the place among the values that have them.
    asked = sizes.select(*groups, "n", names.alias("a")).select(*groups, "a.name", "a.left", F.lit(0).cast("long").alias("prefix")).where((F.col("left") >= 0) & (F.col("left") < F.col("n")))
    same = lambda a, b: _all([F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in groups])
    bits = F.col("__c").bitwiseXOR(F.lit(-(1 << 63)))  # as an unsigned number its order is the long's
    for shift in range(64 - DIGIT, -1, -DIGIT):
        above = F.shiftrightunsigned(bits, shift + DIGIT) if shift + DIGIT < 64 else F.lit(0).cast("long")
        digit = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
        numbered = coded.select(*groups, above.alias("prefix"), digit.alias("digit"))
        if shift + DIGIT < 64:
            wanted = asked.select(*groups, "prefix").distinct().alias("w")
            numbered = numbered.alias("c").join(wanted, same("c", "w") & (F.col("c.prefix") == F.col("w.prefix")), "left_semi")
        counts = numbered.groupBy(*groups, "prefix", "digit").agg(F.count("*").alias("c"))
        upto = F.sum("c").over(Window.partitionBy(*groups, "prefix").orderBy("digit"))
        counts = counts.withColumn("upto", upto).alias("k")
        found = asked.alias("a").join(counts, same("a", "k") & (F.col("a.prefix") == F.col("k.prefix")) & (F.col("a.left") < F.col("k.upto")) & (F.col("a.left") >= F.col("k.upto") - F.col("k.c")))
        asked = found.select(*[F.col(f"a.{g}").alias(g) for g in groups], "a.name", (F.col("a.left") - F.col("k.upto") + F.col("k.c")).alias("left"), F.shiftleft(F.col("a.prefix"), DIGIT).bitwiseOR(F.col("k.digit")).alias("prefix"))
    codes = asked.select(*groups, "name", F.col("prefix").bitwiseXOR(F.lit(-(1 << 63))).alias("__c"))
    if not whole:
        codes = _mapped(codes, "__c", _values, "double")
    wide = codes.groupBy(*groups).agg(*[F.max(F.when(F.col("name") == name, F.col("__c"))).alias(name) for name in at])
    joined = sizes.alias("s").join(wide.alias("w"), same("s", "w"), "left")
    return joined.select(*[F.col(f"s.{g}").alias(b) for b, g in zip(by, groups, strict=True)], "s.n", *[F.col(f"w.{name}") for name in at])


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def between(share: float) -> tuple[Column, Column, Column]:
    """The places on both sides of a share of the way from the first value to the last, and how far it is from the lower."""
    at = F.lit(share) * (F.col("n") - 1)
    return F.floor(at), F.ceil(at), at - F.floor(at)


def quantiles(rows: DataFrame, value: Column, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, as ``percentile`` gives them: ``by``, ``n`` and a column for each name; a median is 0.5."""
    at: dict[str, Column] = {}
    for name, share in shares.items():
        low, high, _ = between(share)
        at |= {f"__lo_{name}": low, f"__hi_{name}": high}
    found = places(rows, value, at, by)
    out = [*(by or []), "n"]
    for name, share in shares.items():
        low, high, part = F.col(f"__lo_{name}").cast("double"), F.col(f"__hi_{name}").cast("double"), between(share)[2]
        out.append(F.when(low == high, low).otherwise(low * (1 - part) + high * part).alias(name))
    return found.select(*out)
