"""A layout of few dimensions that keeps neighbours together, in rounds of tables.

A row's distances to its neighbours become weights that fall from its nearest one on and sum to the
logarithm of their number; a pair is as strong as either end makes it. Rows start at their
principal components. In each round the pairs that are drawn pull their ends together, as often as their weight says, and rows
that are drawn for all push every row away; what moves, how far and in which order is fixed by
hashes, so the same rows give the same layout up to rounding. Pairs stay where they are, dealt out by one end; a
round moves positions alone: those of the ends, and sums for each row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemill.sources.readers import Scratch

#: Rows that push in a round, how much they push for each pull, and the largest step in a dimension.
PUSHERS, PUSH, STEP = 256, 5.0, 4.0
#: Rows that meet all pushers at once: a batch's would take a hundred times the bytes of its places.
PUSHED = 512


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a and b of 1 / (1 + a d^2b), fitted to 1 up to ``min_dist`` and an exponential fall from there."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    p = np.array([1.0, 1.0])
    for _ in range(200):  # damped Gauss-Newton
        power = x ** (2 * p[1])
        f = 1 / (1 + p[0] * power)
        j = np.stack([-power * f * f, -p[0] * power * 2 * np.log(x) * f * f], 1)
        step = np.linalg.solve(j.T @ j + 1e-9 * np.eye(2), j.T @ (y - f))
        p = np.maximum(p + 0.5 * step, 1e-3)
    return float(p[0]), float(p[1])


def fuzzy_weights(graph: DataFrame) -> DataFrame:
    """``i``, ``j``, ``w`` for both directions of each pair of neighbours: a + b - ab of what the ends give each other."""

    def weigh(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, near in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                d = np.array([x["distance"] for x in near])
                w = _falling(d)
                yield pa.RecordBatch.from_pydict({"i": pa.array([i] * len(near), pa.int64()), "j": pa.array([x["neighbour"] for x in near], pa.int64()), "w": w})

    lists = graph.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("distance", "neighbour"))).alias("near"))
    one = lists.mapInArrow(weigh, "i long, j long, w double")
    ends = one.select(F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "w")
    both = ends.groupBy("lo", "hi").agg(F.max("w").alias("a"), F.when(F.count("*") > 1, F.min("w")).otherwise(0.0).alias("b"))
    pairs = both.select("lo", "hi", (F.col("a") + F.col("b") - F.col("a") * F.col("b")).alias("w"))
    return pairs.select(F.col("lo").alias("i"), F.col("hi").alias("j"), "w").unionByName(pairs.select(F.col("hi").alias("i"), F.col("lo").alias("j"), "w"))


def _falling(d: np.ndarray) -> np.ndarray:
    """Weights of ascending distances: 1 for the nearest that is not 0, and a sum of log2 of their number."""
    above = d[d > 0]
    rho, want = (above[0] if len(above) else 0.0), np.log2(max(2, len(d)))
    low, high, sigma = 0.0, np.inf, 1.0
    for _ in range(64):
        total = np.exp(-np.maximum(d - rho, 0) / sigma).sum()
        if abs(total - want) < 1e-6:
            break
        low, high = (low, sigma) if total > want else (sigma, high)
        sigma = 2 * sigma if np.isinf(high) else (low + high) / 2
    return np.exp(-np.maximum(d - rho, 0) / max(sigma, 1e-3 * (d.mean() or 1.0)))


def principal(rows: DataFrame, dims: int, id_col: str, vector: str) -> DataFrame:
    """``id`` and ``place``: principal components, scaled to 10 at most, and a little apart where rows are equal."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    held = rows.select(F.col(id_col).cast("long").alias("id"), array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    got = PCA(k=dims, inputCol="v", outputCol="p").fit(held).transform(held).select("id", vector_to_array("p").alias("p"))
    far = got.agg(*[F.max(F.abs(F.col("p")[k])).alias(f"m{k}") for k in range(dims)]).first()
    scale = 10.0 / max(max(x or 0.0 for x in far), 1e-12)
    middle = got.agg(*[F.avg(F.col("p")[k]) for k in range(dims)]).first()
    apart = lambda k: (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 20)) / F.lit(float(1 << 20)) - 0.5) * 1e-3
    return got.select("id", F.array(*[(F.col("p")[k] - F.lit(middle[k])) * scale + apart(k) for k in range(dims)]).alias("place"))


def layout(rows: DataFrame, graph: DataFrame, dims: int = 5, rounds: int = 20, seed: int = 42, id_col: str = "vec_id", vector: str = "embedding", min_dist: float = 0.05) -> DataFrame:
    """``id_col`` and ``place`` (an array of ``dims`` doubles) for each row with a vector.

    ``graph`` is that of ``nearest_graph``. Rows with fewer dimensions than ``dims`` get as many as they have.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "layout")
    first = rows.select(vector).first()
    if first is None:
        return spark.createDataFrame([], f"`{id_col}` long, place array<double>")
    dims = min(dims, len(first[0]))
    a, b = curve(min_dist)
    pairs = scratch.keep(fuzzy_weights(graph).repartition("j"), "pairs")
    strong = pairs.agg(F.max("w")).first()[0]
    at = scratch.keep(principal(rows, dims, id_col, vector), "place-0")
    cols = range(dims)
    for r in range(rounds if strong else 0):
        rate = 1.0 - r / rounds
        turn = F.pmod(F.xxhash64(F.least("i", "j"), F.greatest("i", "j"), F.lit(seed), F.lit(r)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        drawn = pairs.where(turn < F.col("w") / strong).select("i", "j")
        theirs = at.select(F.col("id").alias("j"), *[F.col("place")[k].alias(f"y{k}") for k in cols])
        mine = at.select(F.col("id").alias("i"), *[F.col("place")[k].alias(f"x{k}") for k in cols])
        near = drawn.join(theirs, "j").join(mine, "i")
        square = sum((F.col(f"x{k}") - F.col(f"y{k}")) * (F.col(f"x{k}") - F.col(f"y{k}")) for k in cols)
        pull = F.when(square > 0, -2.0 * a * b * F.pow(square, F.lit(b - 1)) / (1 + a * F.pow(square, F.lit(b)))).otherwise(0.0)
        one = near.select("i", *[F.col(f"x{k}") for k in cols], *[F.col(f"y{k}") for k in cols], pull.alias("pull"))
        cut = lambda c: F.greatest(F.lit(-STEP), F.least(F.lit(STEP), c))
        sums = one.groupBy("i").agg(F.count("*").alias("pulls"), *[F.sum(cut(F.col("pull") * (F.col(f"x{k}") - F.col(f"y{k}")))).alias(f"g{k}") for k in cols])
        pushers = at.orderBy(F.xxhash64("id", F.lit(seed + 1), F.lit(r)), "id").limit(PUSHERS)
        others = [(x["id"], x["place"]) for x in pushers.collect()]  # PUSHERS rows
        moved = at.join(sums.withColumnRenamed("i", "id"), "id", "left").select("id", "place", F.coalesce("pulls", F.lit(0)).alias("pulls"), F.array(*[F.coalesce(F.col(f"g{k}"), F.lit(0.0)) for k in cols]).alias("g"))
        at = scratch.keep(moved.mapInArrow(_pushed(others, rate, a, b, dims), "id long, place array<double>"), f"place-{r + 1}")
    return at.select(F.col("id").alias(id_col), "place")


def _pushed(others: list[tuple[int, list[float]]], rate: float, a: float, b: float, dims: int):
    """Move each row by what pulls it and by what the drawn rows push, in proportion to its pulls."""
    names, y = np.array([i for i, _ in others]), np.array([p for _, p in others])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, PUSHED) for b in batches for k in range(0, b.num_rows, PUSHED)):
            ids = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            pulls = batch.column(2).to_numpy()
            g = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            apart = x[:, None, :] - y[None, :, :]
            square = np.square(apart).sum(2)
            push = 2 * b / ((0.001 + square) * (1 + a * square**b))
            step = np.clip(push[:, :, None] * apart, -STEP, STEP) * (ids[:, None] != names[None, :])[:, :, None]
            total = g + step.mean(1) * (PUSH * pulls)[:, None]
            # Many pulls of one round overshoot together: their mean move is taken, and no more than a few of it.
            new = x + rate * total / np.maximum(1, pulls / 4)[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(new.reshape(-1)), dims).cast(pa.list_(pa.float64()))], names=["id", "place"])

    return run


def trustworthiness(given: np.ndarray, laid: np.ndarray, k: int = 10, metric: str = "cosine") -> float:
    """How many of the laid out neighbours were neighbours: 1 minus the ranks by which the others were off, for a small sample of rows."""
    from lodemill.operators.neighbours import prepared

    x, n = prepared(given, metric), len(given)
    far = np.square(x[:, None, :] - x[None, :, :]).sum(2)
    near = np.square(laid[:, None, :] - laid[None, :, :]).sum(2)
    np.fill_diagonal(far, np.inf)
    np.fill_diagonal(near, np.inf)
    ranks = far.argsort(1, kind="stable").argsort(1)
    chosen = near.argsort(1, kind="stable")[:, :k]
    off = np.maximum(np.take_along_axis(ranks, chosen, 1) - k + 1, 0).sum()
    return 1 - 2.0 * off / (n * k * (2 * n - 3 * k - 1))
