"""Lookup tables of long keys: sorted arrays by shard, written by tasks and memory-mapped by workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemill.llm.common import U64, Shared, find, gather, map_arrow, shard_of, shared_key, unsigned


def save_sorted(df: DataFrame, names: list[str], shared: Shared, label: str, shards: int) -> None:
    """Sorted arrays of long columns by shard of the first; small enough to be mapped in parts."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held = [np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches if b.num_rows]
        if not held:
            return
        every = np.concatenate(held, axis=1)
        keys = unsigned(every[0])
        order = np.argsort(keys)
        keys, every = keys[order], every[:, order]
        which = shard_of(keys, shards)
        edges = np.searchsorted(which, np.arange(shards + 1))
        for s in np.unique(which):
            for k, name in enumerate(names):
                part = every[k, edges[s] : edges[s + 1]]
                shared.save(f"{label}-{name}-{s}", part.view(U64) if k == 0 else part)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32())})

    bits = shards.bit_length() - 1
    shard = F.shiftrightunsigned(F.col(names[0]), 64 - bits) if bits else F.lit(0)
    made = {r["shard"] for r in gather(map_arrow(df.select(names).repartition(shards, shared_key(shard, shards)), run, "shard int"))}  # one row for each shard
    for s in set(range(shards)) - made:
        for k, name in enumerate(names):
            shared.save(f"{label}-{name}-{s}", np.zeros(0, U64 if k == 0 else np.int64))


def look_up(keys: np.ndarray, shared: Shared, label: str, names: list[str], shards: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Whether each key is stored, and its other columns."""
    hit = np.zeros(len(keys), bool)
    values = [np.zeros(len(keys), np.int64) for _ in names[1:]]
    which = shard_of(keys, shards)
    order = np.argsort(which, kind="stable")
    edges = np.searchsorted(which[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(edges)):
        rows = order[edges[s] : edges[s + 1]]
        at, ok = find(shared.load(f"{label}-{names[0]}-{s}"), keys[rows])
        hit[rows] = ok
        for k, name in enumerate(names[1:]):
            values[k][rows[ok]] = shared.load(f"{label}-{name}-{s}")[at[ok]]
    return hit, values
