"""Benchmark decontamination by a prefix-filtered join of word windows.

A benchmark item is cut into windows of consecutive words. A document holds a window only if it
holds all the window's shingles, so it is enough to look for the rarest one: the prefix of the
window's shingles in the order of their counts in the documents. Where a document has that
shingle, its place gives the only place where the window could lie; bounds on both ends are
checked, then the words themselves. The windows are handled in blocks of bounded size whose
arrays are written by tasks and memory-mapped by the workers, so documents are never shuffled and
no task holds more than a block.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemill.llm.common import ALNUM, ROLL, U64, Shared, by_key, find, gather, hash_words, input_bytes, map_arrow, mix, roll, sum_by_key, tidy, utf8

#: Words of a window, words of a shingle, and bytes of item texts in a block.
WINDOW, SHINGLE, BLOCK_BYTES = 10, 5, 8 << 20
#: Shingles whose counts a task holds before it gives them out.
COUNTED = 1 << 20


@dataclass(frozen=True)
class Index:
    """Names of the blocks in the shared folder; ``sizes`` are the shingle lengths that occur."""

    shared: Shared
    blocks: tuple[str, ...]
    sizes: tuple[int, ...]


def _windows(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each window (padded with 0), its length, and its item's place."""
    h, bounds = hash_words(texts, ALNUM)
    n = np.diff(bounds)
    size = np.minimum(n, window)
    per = np.where(n > 0, n - size + 1, 0)
    owner = np.repeat(np.arange(len(texts)), per)
    start = bounds[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    size = size[owner]
    at = start[:, None] + np.arange(window)
    inside = np.arange(window) < size[:, None]
    return np.where(inside, h[np.minimum(at, len(h) - 1)], U64(0)) if len(h) else np.zeros((0, window), U64), size, owner


def _shingles(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each window's shingles; 0 where a window has fewer. A window of fewer words than a shingle is one."""
    out = np.zeros((len(words), max(1, words.shape[1] - SHINGLE + 1)), U64)
    for length in range(1, words.shape[1] + 1):
        rows = np.flatnonzero(size == length)
        k = min(SHINGLE, length)
        for j in range(length - k + 1):
            if len(rows):
                flat = np.ascontiguousarray(words[rows, j : j + k])
                value = flat[:, 0].copy()
                for c in range(1, k):
                    value = value * ROLL + flat[:, c]
                out[rows, j] = mix(value + U64(k))
    return out


def _valid(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and their places, those across two documents left out."""
    g = roll(h, k)
    ends = np.repeat(bounds[1:], np.diff(bounds))[: len(g)]
    at = np.flatnonzero(np.arange(len(g)) + k <= ends)
    return g[at], at


def build_index(docs: DataFrame, items: DataFrame, shared: Shared, id_col: str = "item_id", text_col: str = "text", doc_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Index:
    """Write the windows of all items, each under its rarest shingle.

    Items with a null id or text, or without words, have no windows; equal windows of several
    items of a block are stored once with all of them. Tasks write the blocks; the driver sees a
    row for each.
    """

    def write(held: list[tuple[str, bytes]], name: str) -> Iterator[pa.RecordBatch]:
        words, length, owner = _windows([t for _, t in held], window)
        if not len(words):
            return
        key = mix(words @ (U64(2) * np.arange(1, window + 1, dtype=U64) + U64(1)) * ROLL + length.astype(U64))
        key = key ^ mix(np.bitwise_xor.reduce(mix(words + np.arange(window, dtype=U64)), axis=1))
        _, first, same = np.unique(key, return_index=True, return_inverse=True)
        pairs = np.unique(np.stack([same, owner]), axis=1)
        for kind, a in {"words": words[first], "length": length[first].astype(np.int32), "owner": pairs[1].astype(np.int32), "owners": np.searchsorted(pairs[0], np.arange(len(first) + 1))}.items():
            shared.save(f"{kind}-{name}", np.ascontiguousarray(a))
        shared.write(f"ids-{name}.json", json.dumps([i for i, _ in held]).encode())
        every = np.unique(_shingles(words[first], length[first]))
        shared.save(f"shingles-{name}", every[every != 0])
        yield pa.RecordBatch.from_pydict({"block": pa.array([name]), "sizes": pa.array([np.unique(np.minimum(length, SHINGLE)).tolist()], pa.list_(pa.int32()))})

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, bytes]] = []
        part, size, k = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                held.append((key, text))
                size += len(text)
                if size >= block_bytes:
                    yield from write(held, f"{part}-{k}")
                    held, size, k = [], 0, k + 1
        if held:
            yield from write(held, f"{part}-{k}")

    rows = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    tasks = max(1, -(-input_bytes(items) // block_bytes))
    made = gather(map_arrow(rows.repartitionByRange(tasks, "i") if tasks > 1 else rows.coalesce(1), run, "block string, sizes array<int>"))
    index = Index(shared, tuple(sorted(r["block"] for r in made)), tuple(sorted({k for r in made for k in r["sizes"]})))
    if made:
        _choose(index, _count(docs, index, doc_text))
    return index


def _count(docs: DataFrame, index: Index, text_col: str) -> DataFrame:
    """How often each shingle of the items occurs in the documents."""
    shared, blocks, sizes = index.shared, index.blocks, index.sizes

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for b, name in enumerate(blocks):
                own = [(at, n) for block, at, n in held if block == b]
                if own:
                    at, n = sum_by_key(np.concatenate([x for x, _ in own]), np.concatenate([x for _, x in own]))
                    yield pa.RecordBatch.from_pydict({"block": pa.array([name] * len(at), pa.string()), "shingle": pa.array(at), "n": pa.array(n)})

        for batch in batches:
            h, bounds = hash_words(utf8(batch.column(0)), ALNUM)
            for k in sizes:
                g, _ = _valid(h, bounds, k)
                for b, name in enumerate(blocks):
                    at, hit = find(shared.load(f"shingles-{name}"), g)
                    held.append((b, *np.unique(at[hit], return_counts=True)))
                    size += len(held[-1][1])
            if size > COUNTED:
                yield from out()
                held, size = [], 0
        yield from out()

    counted = map_arrow(docs.select(text_col), run, "block string, shingle long, n long")
    return counted.groupBy("block", "shingle").agg(F.sum("n").alias("n"))


def _choose(index: Index, counts: DataFrame) -> None:
    """Store each window under the shingle that comes first by count, then by hash; a task for each block."""
    shared, spark = index.shared, counts.sparkSession

    def run(batches) -> Iterator[pa.RecordBatch]:
        for (name,), group in by_key(batches, 1):
            words, length, every = shared.load(f"words-{name}"), shared.load(f"length-{name}"), np.asarray(shared.load(f"shingles-{name}"))
            n = np.zeros(len(every), np.int64)
            for _, at, times in group:
                if at is not None:
                    n[at] = times
            rank = np.empty(len(every), np.int64)
            rank[np.lexsort((every, n))] = np.arange(len(every))
            sh = _shingles(np.asarray(words), np.asarray(length))
            at, real = find(every, sh.ravel())
            score = np.where(real, rank[at], np.iinfo(np.int64).max).reshape(sh.shape)
            offset = score.argmin(1)
            prefix = sh[np.arange(len(sh)), offset]
            order = np.argsort(prefix, kind="stable")
            keys, first = np.unique(prefix[order], return_index=True)
            for kind, a in {"prefix": keys, "starts": np.append(first, len(order)), "window": order.astype(np.int64), "offset": offset[order].astype(np.int64)}.items():
                shared.save(f"{kind}-{name}", a)
            yield pa.RecordBatch.from_pydict({"block": pa.array([name])})

    # A row for each block, too, as no document may hold a shingle of it.
    every = spark.createDataFrame([(b,) for b in index.blocks], "block string").select("block", F.lit(None).cast("long").alias("shingle"), F.lit(0).cast("long").alias("n"))
    with tidy(spark):
        dealt = counts.unionByName(every).repartition(max(1, len(index.blocks)), "block").sortWithinPartitions("block")
        gather(map_arrow(dealt, run, "block string"))  # one row for each block


def find_hits(texts: list[bytes], index: Index) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Words, hit words and sorted ids of the items found, of each text."""
    h, bounds = hash_words(texts, ALNUM)
    cover = np.zeros(len(h) + 1, np.int64)
    found: list[set[str]] = [set() for _ in texts]
    for b in index.blocks:
        words, length = index.shared.load(f"words-{b}"), index.shared.load(f"length-{b}")
        keys, starts = index.shared.load(f"prefix-{b}"), index.shared.load(f"starts-{b}")
        which, offset = index.shared.load(f"window-{b}"), index.shared.load(f"offset-{b}")
        doc_hits, window_hits = [], []
        for k in index.sizes:
            g, place = _valid(h, bounds, k)
            at, hit = find(keys, g)
            at, place = at[hit], place[hit]
            n = starts[at + 1] - starts[at]
            entry = np.repeat(starts[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            window = which[entry]
            start = np.repeat(place, n) - offset[entry]
            size = length[window]
            doc = np.searchsorted(bounds, np.repeat(place, n), "right") - 1
            ok = (start >= bounds[doc]) & (start + size <= bounds[doc + 1])
            window, start, size, doc = window[ok], start[ok], size[ok], doc[ok]
            for j in range(words.shape[1]):  # the words themselves
                same = (j >= size) | (h[np.minimum(start + j, len(h) - 1)] == words[window, j])
                window, start, size, doc = window[same], start[same], size[same], doc[same]
            np.add.at(cover, start, 1)
            np.add.at(cover, start + size, -1)
            doc_hits.append(doc)
            window_hits.append(window)
        doc, window = np.concatenate(doc_hits), np.concatenate(window_hits)
        if len(doc):
            ids, owner, owners = _ids(index, b), index.shared.load(f"owner-{b}"), index.shared.load(f"owners-{b}")
            for d, w in np.unique(np.stack([doc, window]), axis=1).T.tolist():
                found[d].update(ids[o] for o in owner[owners[w] : owners[w + 1]])
    covered = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
    return np.diff(bounds), covered[bounds[1:]] - covered[bounds[:-1]], [sorted(f) for f in found]


_known: dict[tuple[str, str], list[str]] = {}


def _ids(index: Index, block: str) -> list[str]:
    key = (index.shared.uri, block)
    if key not in _known:
        _known.clear()
        _known[key] = json.loads(index.shared.read(f"ids-{block}.json"))
    return _known[key]


def find_contamination(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", keep_items: bool = True) -> DataFrame:
    """``id_col``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated`` and, with ``keep_items``, ``items``.

    A null or empty text has no words. With an empty benchmark nothing is hit. Rows are
    independent of each other and of other columns.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, hits, items = find_hits(utf8(batch.column(1)), index)
            columns = {id_col: batch.column(0), "n_words": pa.array(words), "n_hit": pa.array(hits), "n_items": pa.array([len(x) for x in items], pa.int64())}
            columns["items_sha256"] = pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string())
            columns["contaminated"] = pa.array(hits > 0)
            if keep_items:
                columns["items"] = pa.array(items, pa.list_(pa.string()))
            yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" + (", items array<string>" if keep_items else ""))


def drop_contaminated(docs: DataFrame, index: Index, text_col: str = "text") -> DataFrame:
    """The rows without a hit word, all columns as they were."""
    at = docs.columns.index(text_col)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, hits, _ = find_hits(utf8(batch.column(at)), index)
            yield batch.filter(pa.array(hits == 0))

    return map_arrow(docs, run, docs.schema)
