"""Nearest neighbours of all rows: random-projection leaves, then neighbours of neighbours.

Several trees split the rows by random hyperplanes, each node at its mean, until a leaf has few
rows; a tree level is a pass over the rows' projections, not over their vectors. Inside a leaf all
rows are compared, which is a constant for each row. Then rounds of descent: the neighbours of a row
are likely neighbours of each other, so the rows next to a row meet and are compared. The work
grows with the rows, and no task holds more than a leaf or a row's meeting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodemill.sources.readers import Scratch

#: Rows of a leaf (a node beyond them is split again), trees, rounds of descent, and neighbours on each side that meet.
LEAF_ROWS, TREES, ROUNDS, MEET = 768, 4, 1, 10
#: Rows of a meeting that are compared at once.
TOGETHER = 64


def measured(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each row of x from that of y: the same for a pair, whatever it is computed with."""
    squares = np.square(x - y).sum(-1)
    if metric == "euclidean":
        return np.sqrt(squares)
    known = (x != 0).any(-1) & (y != 0).any(-1)  # a vector of no length is like nothing
    return np.where(known, squares / 2, 1.0)


def prepared(vectors: np.ndarray, metric: str) -> np.ndarray:
    """Vectors as doubles, of length one for cosine distance."""
    x = vectors.astype(np.float64)
    if metric == "cosine":
        n = np.sqrt(np.square(x).sum(-1, keepdims=True))
        x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    return x


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _nearest(x: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest other rows of each row, in any order."""
    squares = np.square(x).sum(1)
    d = squares[:, None] + squares[None, :] - 2 * x @ x.T
    np.fill_diagonal(d, np.inf)
    return np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(x) - 1 else np.stack([np.delete(np.arange(len(x)), i) for i in range(len(x))])


def _pairs(ids: np.ndarray, x: np.ndarray, k: int, metric: str) -> pa.RecordBatch:
    near = _nearest(x, min(k, len(ids) - 1))
    rows = np.repeat(np.arange(len(ids)), near.shape[1])
    at = near.reshape(-1)
    return _links(ids[rows], ids[at], measured(x[rows], x[at], metric))


def _links(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d)], names=["id", "neighbour", "distance"])


LINKS = "id long, neighbour long, distance double"


def _best(links: DataFrame, k: int) -> DataFrame:
    """The k nearest of each row's distinct links."""
    place = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))
    return links.distinct().withColumn("place", place).where(F.col("place") <= k)


def nearest_graph(rows: DataFrame, k: int = 30, metric: str = "cosine", id_col: str = "vec_id", vector: str = "embedding", seed: int = 42, trees: int = TREES, rounds: int = ROUNDS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Approximately the k nearest neighbours of each row: ``id``, ``neighbour``, ``distance``, ``place`` from 1.

    ``metric`` is ``cosine`` (1 - cosine) or ``euclidean``. ``id_col`` is a long without repeats; rows
    without a vector or an id are left out, vectors must be of one length. Equal distances go by id. Where all rows fit
    one leaf the neighbours are exact. The same rows give the same neighbours, however they are dealt out.
    """
    scratch = Scratch(rows.sparkSession, "neighbours")
    given = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")

    def unit(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = prepared(_matrix(b.column(1)), metric)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))], names=["id", "v"])

    vectors, n = scratch.counted(given.mapInArrow(unit, "id long, v array<double>"), "vectors")
    depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf_rows))))
    if depth == 0:
        trees, rounds = 1, 0
    leaves = _leaves(vectors, trees, depth, seed, scratch, leaf_rows)
    parts = max(8, (1 << depth) * trees // 8)

    def compared(batches) -> Iterator[pa.RecordBatch]:
        key, ids, held = None, [], []
        for b in batches:
            leaf = b.column(0).to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], leaf[1:] != leaf[:-1], [True])))
            own, x = b.column(1).to_numpy(), _matrix(b.column(2))
            for a, z in zip(edges, edges[1:], strict=False):
                if leaf[a] != key and ids:
                    every = np.concatenate(ids)
                    if len(every) > 1:
                        yield _pairs(every, np.concatenate(held), k, metric)
                    ids, held = [], []
                key = leaf[a]
                ids.append(own[a:z])
                held.append(x[a:z])
        if ids and len(every := np.concatenate(ids)) > 1:
            yield _pairs(every, np.concatenate(held), k, metric)

    dealt = leaves.join(vectors, "id").select("leaf", "id", "v").repartition(parts, "leaf").sortWithinPartitions("leaf", "id")
    graph = scratch.keep(_best(dealt.mapInArrow(compared, LINKS), k), "graph-0")
    for r in range(rounds):
        graph = scratch.keep(_best(graph.select("id", "neighbour", "distance").unionByName(_met(graph, vectors, k, metric, seed + r)), k), f"graph-{r + 1}")
    return graph


def _leaves(vectors: DataFrame, trees: int, depth: int, seed: int, scratch: Scratch, leaf_rows: int) -> DataFrame:
    """The leaf of each row in each tree: ``id`` and ``leaf``."""
    if depth == 0:
        at = vectors.select("id", F.lit(0).cast("long").alias("node"))
    else:

        def projected(batches) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column(1))
                    planes = np.random.default_rng(seed).standard_normal((x.shape[1], trees * depth))
                    p = (x @ planes).reshape(len(x), trees, depth)
                    every = pa.FixedSizeListArray.from_arrays(pa.array(p.reshape(-1)), depth).cast(pa.list_(pa.float64()))
                    tree = np.tile(np.arange(trees, dtype=np.int64), len(x))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), trees)), pa.array(tree), every], names=["id", "node", "p"])

        at = scratch.keep(vectors.mapInArrow(projected, "id long, node long, p array<double>"), "level-0")
        for level in range(depth):
            side = F.col("p")[level]
            middle = at.groupBy("node").agg(F.round(F.avg(side), 6).alias("middle"))
            split = at.join(middle, "node").select("id", (F.col("node") * 2 + (side > F.col("middle")).cast("long")).alias("node"), "p")
            at = scratch.keep(split, f"level-{level + 1}")
    # Equal vectors stay together however they are split; such a leaf is dealt out by id.
    sizes = at.groupBy("node").agg(F.ceil(F.count("*") / F.lit(2 * leaf_rows)).alias("parts"))
    part = F.pmod(F.xxhash64("id", "node"), F.col("parts"))
    return at.join(sizes, "node").select("id", F.xxhash64("node", part).alias("leaf"))


def _met(graph: DataFrame, vectors: DataFrame, k: int, metric: str, seed: int) -> DataFrame:
    """Links between rows that are next to one row, where they are nearer than what one of both has."""
    mine = graph.where(F.col("place") <= MEET).select(F.col("id").alias("host"), F.col("neighbour").alias("id"))
    back = mine.select(F.col("id").alias("host"), F.col("host").alias("id"))
    turn = F.row_number().over(Window.partitionBy("host").orderBy(F.xxhash64("id", "host", F.lit(seed)), "id"))
    few = back.withColumn("turn", turn).where(F.col("turn") <= MEET).drop("turn")
    last = graph.groupBy("id").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(float("inf")).alias("last"))
    guests = mine.unionByName(few).distinct().join(vectors.join(last, "id"), "id").select("host", "id", "last", "v")

    def meet(batches) -> Iterator[pa.RecordBatch]:
        for groups in _meetings(batches):
            most = max(len(g[0]) for g in groups)
            dims = groups[0][2].shape[1]
            ids, last_, x = np.full((len(groups), most), -1, np.int64), np.zeros((len(groups), most)), np.zeros((len(groups), most, dims))
            for g, (i, d, v) in enumerate(groups):
                ids[g, : len(i)], last_[g, : len(i)], x[g, : len(i)] = i, d, v
            squares = np.square(x).sum(2)
            d = squares[:, :, None] + squares[:, None, :] - 2 * np.einsum("gid,gjd->gij", x, x)
            d = d / 2 if metric == "cosine" else np.sqrt(np.maximum(d, 0))
            counts = np.array([len(g[0]) for g in groups])
            inside = np.arange(most) < counts[:, None]
            real = inside[:, :, None] & inside[:, None, :] & ~np.eye(most, dtype=bool)
            g, i, j = np.nonzero(real & (d <= last_[:, :, None] + 1e-9))
            if len(g):
                yield _links(ids[g, i], ids[g, j], measured(x[g, i], x[g, j], metric))

    return guests.repartition("host").sortWithinPartitions("host", "id").mapInArrow(meet, LINKS)


def _meetings(batches) -> Iterator[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Some hosts' guests at a time: ids, distances of their last neighbours, and vectors."""
    out, host, held = [], None, []

    def closed():
        return tuple(np.concatenate(c) for c in zip(*held, strict=True))

    for b in batches:
        hosts, columns = b.column(0).to_numpy(), (b.column(1).to_numpy(), b.column(2).to_numpy(), _matrix(b.column(3)) if b.num_rows else None)
        edges = np.flatnonzero(np.concatenate(([True], hosts[1:] != hosts[:-1], [True]))) if len(hosts) else []
        for a, z in zip(edges, edges[1:], strict=False):
            if held and hosts[a] != host:
                out.append(closed())
                held = []
                if len(out) >= TOGETHER:
                    yield out
                    out = []
            host = hosts[a]
            held.append(tuple(c[a:z] for c in columns))
    if held:
        out.append(closed())
    if out:
        yield out
