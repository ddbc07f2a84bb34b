"""Runs of sorted keys, dealt to shards by hash range in as many steps as their number asks for."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodemill.llm.common import U64, by_key, map_arrow, pack, shard_of, shared_key, sum_by_key, unpack

#: Parts into which a run is cut at most in one deal: more shards are reached by further deals.
FAN = 1024
#: Bytes of keys and counts that are folded into a run.
RUN_BYTES = 32 << 20

RUN = "part int, run binary"


def widths(shards: int, fan: int | None = None) -> list[int]:
    """The numbers of parts of each deal, the last being the shards; both are powers of two."""
    fan, out = fan or FAN, [shards]
    while out[0] > fan:
        out.insert(0, max(1, out[0] // fan))
    return out


def fold(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of several runs, and the sums of their counts."""
    return sum_by_key(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))


def cut(keys: np.ndarray, counts: np.ndarray, parts: int, place: np.ndarray | None = None) -> pa.RecordBatch:
    """A run of sorted keys as one blob for each range that has some; ``place``: the hashes that deal them, if the keys do not."""
    edges = np.searchsorted(shard_of(keys if place is None else place, parts), np.arange(parts + 1))
    kept = np.flatnonzero(np.diff(edges)).tolist()
    small = counts.astype(np.uint8) if not len(counts) or counts.max() < 256 else counts.astype(np.int64)
    blobs = [pack(keys[edges[p] : edges[p + 1]], small[edges[p] : edges[p + 1]]) for p in kept]
    return pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "run"])


def read(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = unpack(blob)
    return keys, counts.astype(np.int64)


def folded(runs: Iterable[tuple[np.ndarray, np.ndarray]], limit: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs folded together, in pieces of about ``limit`` bytes, or whole where there is none."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for run in runs:
        held.append(run)
        size += len(run[0])
        if len(held) > 1 and size > max(1 << 17, 2 * len(held[0][0])):
            held = [fold(held)]
            size = len(held[0][0])
        if limit and 16 * size >= limit:
            yield fold(held)
            held, size = [], 0
    if held:
        yield fold(held)


def dealt(rows: DataFrame, shards: int, shift: int = 0, fan: int | None = None, recut=None) -> DataFrame:
    """Runs cut into ``widths(shards)[0]`` parts, dealt until a partition has whole shards, sorted by shard.

    ``shift``: how many leading bits short of 64 the keys are. ``recut`` folds blobs and cuts them into more parts where
    they are not keys and counts.
    """
    steps = widths(shards, fan)

    def counted(blobs: Iterable[bytes], parts: int) -> Iterator[pa.RecordBatch]:
        for keys, counts in folded(map(read, blobs), RUN_BYTES):
            yield cut(keys, counts, parts, keys << U64(shift))

    def finer(parts: int):
        def run(batches) -> Iterator[pa.RecordBatch]:
            for _, group in by_key(batches, 1):
                yield from (recut or counted)((r[1] for r in group), parts)

        return run

    by_part = lambda df, n: df.repartition(n, shared_key("part", n)).sortWithinPartitions("part")
    for have, parts in zip(steps, steps[1:], strict=False):
        rows = map_arrow(by_part(rows, have), finer(parts), RUN)
    return by_part(rows, shards)
