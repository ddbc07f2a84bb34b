"""Phrase collocations by counting level after level over a minimal perfect hash.

A phrase of k words can be frequent only if its first and its last k - 1 words are. So level k joins
two neighbouring phrases of level k - 1: its key is the pair of their slots. Candidates are the keys
whose hash bucket reaches the threshold when buckets are counted, which takes half the bytes of
counting keys; too many may pass, none is missed. The candidates get a minimal perfect hash, stored
with the keys themselves. Mappers then look each position's key up, verify it, add the slots up with
``bincount``, and write the positions' slots as what the next level reads. Their arrays are added
in a tree. In the end every phrase's parts are read by slot: the first words by following the first
slot of the pairs, the last words by following the second.

Level 1 are words, told apart by 64-bit hashes of word and language; two words with one hash stop the
job. The total of a language is counted as a word of its own without letters.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodemill.llm import perfect, runs
from lodemill.llm.common import BLOCK, U64, Shared, by_key, distinct, find, gather, gathered, hash_block, input_bytes, map_arrow, mix, shard_of, shards_for, shared_key, sum_by_key, tidy, unmix, utf8

#: Words of the longest phrase, its least count, the percentage of its count that a longer one needs to replace it, and phrases of a language.
LONGEST, LEAST, SHARE, TOP = 5, 100, 100, 2000
#: Numerator of the score.
SCALE = 1000
#: Bytes of text that are hashed at once, and slots of a block of counts at least; blocks at most.
TEXT_BYTES, BLOCK_SLOTS, BLOCKS = 2 << 20, 1 << 13, 1024
#: Mappers whose arrays are added in one task.
ADDED = 256
#: Keys that a task remembers to have handed on.
REMEMBERED = 1 << 20

_NONE = np.uint32(0xFFFFFFFF)
_LOW = bytes(range(256)).lower()
_SPLIT = bytes(10 if chr(b) in ".,;:!?" or 10 <= b <= 13 else 32 if b in (9, 32) else _LOW[b] for b in range(256))
_TOTAL = U64(0x5851F42D4C957F2D)


@lru_cache(4096)
def lang_key(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


def total_keys(langs: np.ndarray) -> np.ndarray:
    """Keys under which languages' totals are counted."""
    return mix(langs ^ _TOTAL)


def _whole(x: int) -> int:
    """The least power of two that is not smaller."""
    return 1 << max(0, (x - 1).bit_length())


@dataclass
class Words:
    """The words of some texts: keys, the piece and text each stands in, and where it stands."""

    clean: bytes
    keys: np.ndarray
    piece: np.ndarray
    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    langs: np.ndarray  # of each text


def words_of(texts: list[bytes], langs: list[str]) -> Words:
    clean = b"\n".join(t.translate(_SPLIT) for t in texts)
    parts, at, before = [], 0, 0
    while at < len(clean):
        end = min(at + BLOCK, len(clean))
        if end < len(clean):  # blocks end at a separator
            last = max(clean.rfind(b" ", at, end), clean.rfind(b"\n", at, end))
            if last <= at:
                after = [x for x in (clean.find(b" ", end), clean.find(b"\n", end)) if x >= 0]
                last = min(after, default=len(clean))
            end = last
        block = clean[at:end]
        h, starts, ends = hash_block(block.replace(b"\n", b" "))
        lines = np.cumsum(np.frombuffer(block, np.uint8) == 10)
        parts.append((h, lines[starts] + before, starts + at, ends + at))
        before += int(lines[-1]) if len(lines) else 0
        at = end
    none = np.zeros(0, np.int64)
    h, piece, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, U64), none, none, none)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    text = np.searchsorted(bounds, starts, "right")
    own = np.array([lang_key(x) for x in langs], U64)
    return Words(clean, mix(h ^ own[text]) if len(h) else h, piece, text, starts, ends, own)


def tidy_gaps(slots: np.ndarray) -> np.ndarray:
    """A sequence of slots without those that have no neighbour, one gap between two runs."""
    on = np.concatenate(([False], slots != _NONE, [False]))
    near = on[1:-1] & (on[:-2] | on[2:])
    keep = near.copy()
    keep[1:] |= near[:-1]  # and the gap after each run
    return np.where(near, slots, _NONE)[keep]


def _label(lang: str, word: bytes) -> bytes:
    own = lang.encode()
    return b"%d:" % len(own) + own + word


def _told(label: bytes) -> tuple[bytes, bytes]:
    """Language and word of a label."""
    n, _, rest = label.partition(b":")
    return rest[: int(n)], rest[int(n) :]


def _named(parts: list[tuple[np.ndarray, list[bytes]]]) -> tuple[np.ndarray, list[bytes]]:
    """Keys with their labels, each key once; a key with two labels is an error."""
    keys, labels = np.concatenate([k for k, _ in parts]), [x for _, every in parts for x in every]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    labels = [labels[k] for k in order.tolist()]
    same = np.flatnonzero(keys[1:] == keys[:-1])
    if any(labels[k] != labels[k + 1] for k in same.tolist()):
        raise ValueError("two words share a hash")
    first = np.ones(len(keys), bool)
    first[same + 1] = False
    return keys[first], [labels[k] for k in np.flatnonzero(first).tolist()]


def _cut_names(keys: np.ndarray, labels: list[bytes], parts: int) -> pa.RecordBatch:
    """Sorted keys and their labels as one blob for each range that has some."""
    edges = np.searchsorted(shard_of(keys, parts), np.arange(parts + 1)).tolist()
    kept = [p for p in range(parts) if edges[p] < edges[p + 1]]
    blobs = []
    for p in kept:
        own = labels[edges[p] : edges[p + 1]]
        head = runs.pack(keys[edges[p] : edges[p + 1]], np.array([len(x) for x in own], np.uint32))
        blobs.append(len(head).to_bytes(4, "little") + head + zstandard.ZstdCompressor(level=1).compress(b"".join(own)))
    return pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "run"])


def _read_names(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    n = int.from_bytes(blob[:4], "little")
    keys, sizes = runs.unpack(blob[4 : 4 + n])
    data = zstandard.ZstdDecompressor().decompress(blob[4 + n :])
    ends = np.cumsum(sizes.astype(np.int64)).tolist()
    return keys, [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _folded_names(held: Iterable[tuple[np.ndarray, list[bytes]]], limit: int | None = None) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Runs of names folded together, in pieces of about ``limit`` bytes, or whole where there is none."""
    parts, size = [], 0
    for run in held:
        parts.append(run)
        size += sum(len(x) for x in run[1]) + 64 * len(run[1])
        if limit and size >= limit:
            yield _named(parts)
            parts, size = [], 0
    if parts:
        yield _named(parts)


def _recut_names(blobs: Iterable[bytes], parts: int) -> Iterator[pa.RecordBatch]:
    for keys, labels in _folded_names(map(_read_names, blobs), runs.RUN_BYTES):
        yield _cut_names(keys, labels, parts)


def _packed(slots: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(slots).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).reshape(-1)


@dataclass(frozen=True)
class Level:
    """The candidates of one length: their slots, and their counts in blocks of slots."""

    tables: perfect.Tables
    width: int

    @property
    def blocks(self) -> int:
        return -(-self.tables.total // self.width)

    def block(self, k: int) -> np.ndarray:
        return self.tables.shared.load(f"{self.tables.label}-count-{k}")

    def counts(self, slots: np.ndarray) -> np.ndarray:
        found, back = np.unique(slots, return_inverse=True)
        out = np.zeros(len(found), np.int64)
        edges = np.searchsorted(found, np.arange(self.blocks + 1) * self.width)
        for b in np.flatnonzero(np.diff(edges)):
            part = slice(edges[b], edges[b + 1])
            out[part] = self.block(int(b))[found[part] - b * self.width]
        return out[back]

    def halves(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots, one level below, of all words but the last and but the first."""
        keys = self.tables.keys(slots)
        return (keys >> U64(32)).astype(np.int64), (keys & U64(0xFFFFFFFF)).astype(np.int64)


@dataclass(frozen=True)
class Buckets:
    """The hash buckets that reached the threshold, sorted, by shard."""

    shared: Shared
    label: str
    bits: int
    there: np.ndarray

    def passing(self, hashes: np.ndarray) -> np.ndarray:
        """Which of ascending hashes lie in such a bucket."""
        out, shards = np.zeros(len(hashes), bool), len(self.there)
        edges = np.searchsorted(shard_of(hashes, shards), np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(edges) * self.there):
            part = slice(edges[s], edges[s + 1])
            out[part] = find(self.shared.load(f"{self.label}-{s}"), hashes[part] >> U64(64 - self.bits))[1]
        return out


@dataclass(frozen=True)
class Miner:
    """The job's settings and folder."""

    shared: Shared
    shards: int
    bits: int
    least: int = LEAST
    longest: int = LONGEST
    share: int = SHARE
    top: int = TOP
    parts: int = 0  # of the first deal
    levels: dict[int, Level] = field(default_factory=dict)

    def _buckets(self, rows: DataFrame, keyed, label: str) -> Buckets:
        """Count the buckets of hashes that ``keyed`` makes of batches, and store those that reach the threshold."""
        shift = 64 - self.bits

        def run(batches) -> Iterator[pa.RecordBatch]:
            every = ((h >> U64(shift), n) for h, n in keyed(batches))
            for buckets, n in runs.folded((runs.fold([x]) for x in every), runs.RUN_BYTES):
                yield runs.cut(buckets, n, self.parts, buckets << U64(shift))

        def store(batches) -> Iterator[pa.RecordBatch]:
            for (shard,), group in by_key(batches, 1):
                for buckets, n in runs.folded(runs.read(r[1]) for r in group):
                    kept = buckets[n >= self.least]
                    if len(kept):
                        self.shared.save(f"{label}-{shard}", kept)
                        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32())})

        dealt = runs.dealt(map_arrow(rows, run, runs.RUN), self.shards, shift)
        there = np.zeros(self.shards, bool)
        there[[r["shard"] for r in gather(map_arrow(dealt, store, "shard int"))]] = True  # one row for each shard
        return Buckets(self.shared, label, self.bits, there)

    def _tables(self, made: DataFrame, label: str) -> perfect.Tables:
        sizes = np.zeros(self.shards + 1, np.int64)
        for r in gather(made):  # one row for each shard
            sizes[r["shard"] + 1] = r["n"]
        tables = perfect.Tables(self.shared, label, np.cumsum(sizes))
        if tables.total >= int(_NONE):
            raise ValueError("a level has 2^32 candidates or more")
        return tables

    def _counted(self, rows: DataFrame, looked_up, tables: perfect.Tables, label: str) -> tuple[Level, DataFrame]:
        """The level's counts, and its sequences of slots; ``looked_up`` yields (slots to count, weights or none, sequence)."""
        width = max(BLOCK_SLOTS, _whole(-(-tables.total // BLOCKS)))
        level = Level(tables, width)

        def run(batches) -> Iterator[pa.RecordBatch]:
            part, held, size = TaskContext.get().partitionId(), {}, 0

            def out() -> pa.RecordBatch:
                blobs = [runs.pack(np.flatnonzero(x).astype(U64), x[x > 0]) for x in held.values()]
                return _rows(list(held), part, blobs)

            for slots, weights, sequence in looked_up(batches):
                order = np.sort(slots) if weights is None else slots
                edges = np.searchsorted(order, np.arange(level.blocks + 1) * width) if weights is None else None
                for b in np.flatnonzero(np.diff(edges)).tolist() if weights is None else range(level.blocks):
                    own = slice(edges[b], edges[b + 1]) if weights is None else (slots // width == b)
                    if weights is not None and not own.any():
                        continue
                    more = np.bincount(order[own] - b * width, None if weights is None else weights[own], min(width, tables.total - b * width)).astype(np.int64)
                    if b in held:
                        held[b] += more
                    else:
                        held[b] = more
                        size += more.nbytes
                if len(sequence):
                    yield _rows([-1], part, [_packed(sequence)])
                if size >= runs.RUN_BYTES:
                    yield out()
                    held, size = {}, 0
            if held:
                yield out()

        table = self.shared.table(map_arrow(rows, run, "block int, part int, data binary"), f"{label}-sequences")
        sums = table.where("block >= 0")

        def added(batches) -> Iterator[pa.RecordBatch]:
            for (block, part), group in by_key(batches, 2):
                total = np.zeros(min(width, tables.total - block * width), np.int64)
                for r in group:
                    slots, n = runs.unpack(r[2])
                    total[slots.astype(np.int64)] += n.astype(np.int64)
                yield _rows([block], part, [runs.pack(np.flatnonzero(total).astype(U64), total[total > 0])])

        def stored(batches) -> Iterator[pa.RecordBatch]:
            for (block,), group in by_key(batches, 1):
                total = np.zeros(min(width, tables.total - block * width), np.int64)
                for r in group:
                    slots, n = runs.unpack(r[2])
                    total[slots.astype(np.int64)] += n.astype(np.int64)
                self.shared.save(f"{label}-count-{block}", total)
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32())})

        mappers = table.agg(F.max("part")).first()[0]
        while mappers is not None and mappers >= ADDED:
            sums = sums.withColumn("part", F.floor(F.col("part") / ADDED).cast("int"))
            n = max(level.blocks, min(10_000, level.blocks * (mappers // ADDED)))
            sums = map_arrow(sums.repartition(n, "block", "part").sortWithinPartitions("block", "part"), added, "block int, part int, data binary")
            mappers //= ADDED
        made = {r["block"] for r in gather(map_arrow(sums.repartition(max(1, level.blocks), shared_key("block", max(1, level.blocks))).sortWithinPartitions("block"), stored, "block int"))}  # one row for each block
        for b in set(range(level.blocks)) - made:
            self.shared.save(f"{label}-count-{b}", np.zeros(min(width, tables.total - b * width), np.int64))
        return level, table.where("block < 0").select("data")

    def words(self, docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
        """Level 1; the sequences of candidate words."""
        held = docs.select(F.col(text_col), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))

        def read(batches) -> Iterator[tuple[Words, list[str]]]:
            for batch in gathered(batches, TEXT_BYTES):
                langs = batch.column(1).to_pylist()
                yield words_of(utf8(batch.column(0)), langs), langs

        def totals(w: Words) -> tuple[np.ndarray, np.ndarray]:
            return sum_by_key(w.langs, np.bincount(w.text, minlength=len(w.langs)))

        def keyed(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for w, _ in read(batches):
                if len(w.keys):
                    langs, n = totals(w)
                    yield np.concatenate([w.keys, total_keys(langs)]), np.concatenate([np.ones(len(w.keys), np.int64), n])

        passing = self._buckets(held, keyed, "b1")

        def new_names(batches) -> Iterator[tuple[np.ndarray, list[bytes]]]:
            told = np.zeros(0, U64)
            for w, langs in read(batches):
                keys, first = np.unique(w.keys, return_index=True)
                new = passing.passing(keys) & ~find(told, keys)[1]
                keys, first = keys[new], first[new]
                told = np.union1d(told, keys) if len(told) < REMEMBERED else keys
                spans = zip(w.starts[first].tolist(), w.ends[first].tolist(), w.text[first].tolist(), strict=True)
                own = sorted(set(langs))
                totals_of = total_keys(np.array([lang_key(x) for x in own], U64))
                yield np.concatenate([keys, totals_of]), [*(_label(langs[t], w.clean[a:b]) for a, b, t in spans), *(_label(x, b"") for x in own)]

        def named(batches) -> Iterator[pa.RecordBatch]:
            for keys, labels in _folded_names(new_names(batches), runs.RUN_BYTES):
                yield _cut_names(keys, labels, self.parts)

        def build(batches) -> Iterator[pa.RecordBatch]:
            for (shard,), group in by_key(batches, 1):
                for keys, labels in _folded_names(_read_names(r[1]) for r in group):
                    table = perfect.build(keys, keys)
                    self.shared.write(f"h1-{shard}", table.tobytes())
                    order = np.argsort(perfect.Table(table).slots(keys))
                    names = [x for k in order.tolist() for x in _told(labels[k])]
                    self.shared.save(f"names-{shard}-at", np.cumsum([0, *map(len, names)]))
                    self.shared.save(f"names-{shard}-bytes", np.frombuffer(b"".join(names), np.uint8))
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(keys)], pa.int64())})

        dealt = runs.dealt(map_arrow(held, named, runs.RUN), self.shards, recut=_recut_names)
        tables = self._tables(map_arrow(dealt, build, "shard int, n long"), "h1")

        def looked_up(batches) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray]]:
            for w, _ in read(batches):
                if not len(w.keys):
                    continue
                keys, back = distinct(w.keys)
                slots = tables.find(keys, keys)[back]
                shift = np.concatenate(([0], np.cumsum(np.diff(w.piece) > 0)))
                sequence = np.full(len(slots) + int(shift[-1]), _NONE)
                sequence[np.arange(len(slots)) + shift] = np.where(slots >= 0, slots, int(_NONE)).astype(np.uint32)
                yield slots[slots >= 0], None, tidy_gaps(sequence)
                langs, n = totals(w)
                own, n = sum_by_key(total_keys(langs), n)
                at = tables.find(own, own)
                yield at[at >= 0], n[at >= 0], sequence[:0]

        self.levels[1], sequences = self._counted(held, looked_up, tables, "h1")
        return sequences

    def longer(self, sequences: DataFrame, k: int) -> DataFrame:
        """Level k from the sequences of level k - 1; its sequences."""
        below = self.levels[k - 1]

        def pairs(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Of each sequence the keys at its places, and whether there is one."""
            for batch in batches:
                for blob in batch.column(0).to_pylist():
                    s = _unpacked(blob)
                    on = s != _NONE
                    found, back = np.unique(s[on], return_inverse=True)
                    on[on] = (below.counts(found.astype(np.int64)) >= self.least)[back]
                    yield s[:-1].astype(U64) << U64(32) | s[1:].astype(U64), on[:-1] & on[1:]

        def keyed(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for keys, on in pairs(batches):
                if on.any():
                    yield mix(keys[on]), np.ones(int(on.sum()), np.int64)

        passing = self._buckets(sequences, keyed, f"b{k}")

        def distinct_keys(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for keys, on in pairs(batches):
                h = np.unique(mix(keys[on]))
                h = h[passing.passing(h)]
                if len(h):
                    yield h, np.ones(len(h), np.int64)

        def named(batches) -> Iterator[pa.RecordBatch]:
            for h, n in runs.folded(distinct_keys(batches), runs.RUN_BYTES):
                yield runs.cut(h, n, self.parts)

        def build(batches) -> Iterator[pa.RecordBatch]:
            for (shard,), group in by_key(batches, 1):
                for h, _ in runs.folded(runs.read(r[1]) for r in group):
                    self.shared.write(f"h{k}-{shard}", perfect.build(h, unmix(h)).tobytes())
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(h)], pa.int64())})

        dealt = runs.dealt(map_arrow(sequences, named, runs.RUN), self.shards)
        tables = self._tables(map_arrow(dealt, build, "shard int, n long"), f"h{k}")

        def looked_up(batches) -> Iterator[tuple[np.ndarray, None, np.ndarray]]:
            for keys, on in pairs(batches):
                h, back = distinct(mix(keys[on]))
                first = np.zeros(len(h), np.int64)
                first[back] = np.arange(len(back))
                slots = tables.find(h, keys[on][first])[back]
                sequence = np.full(len(keys), _NONE)
                sequence[on] = np.where(slots >= 0, slots, int(_NONE)).astype(np.uint32)
                yield slots[slots >= 0], None, tidy_gaps(sequence)

        self.levels[k], found = self._counted(sequences, looked_up, tables, f"h{k}")
        return found

    # What is read from the levels

    def part(self, slots: np.ndarray, k: int, first: int, n: int) -> np.ndarray:
        """Slots, at level n, of the n words from the given one on, of phrases at level k."""
        for _ in range(first):
            slots, k = self.levels[k].halves(slots)[1], k - 1
        for _ in range(k - n):
            slots, k = self.levels[k].halves(slots)[0], k - 1
        return slots

    def names(self, slots: np.ndarray) -> list[tuple[bytes, bytes]]:
        """Language and word at some slots of level 1."""
        found, back = np.unique(slots, return_inverse=True)
        out: list[tuple[bytes, bytes]] = []
        for s, _, at in self.levels[1].tables.by_shard(found):
            edges, data = self.shared.load(f"names-{s}-at"), self.shared.load(f"names-{s}-bytes")
            for i in at.tolist():
                a, b, c = (int(edges[2 * i + j]) for j in range(3))
                out.append((data[a:b].tobytes(), data[b:c].tobytes()))
        return [out[k] for k in back.tolist()]

    def scored(self, k: int, slots: np.ndarray) -> Iterator[tuple[bytes, bytes, int, int, int, int, int]]:
        """Language, phrase, a, l, r, n and score of phrases of k words; the arithmetic is exact."""
        a = self.levels[k].counts(slots).tolist()
        cuts = [(self.levels[c].counts(self.part(slots, k, 0, c)).tolist(), self.levels[k - c].counts(self.part(slots, k, c, k - c)).tolist()) for c in range(1, k)]
        words = [self.names(self.part(slots, k, w, 1)) for w in range(k)]
        langs = np.array([lang_key(x[0].decode()) for x in words[0]], U64)
        own, back = np.unique(total_keys(langs), return_inverse=True)
        n = self.levels[1].counts(self.levels[1].tables.find(own, own))[back].tolist()
        for i in range(len(slots)):
            score, _, left, right = min((SCALE * a[i] * n[i] // (x[i] * y[i]), c, x[i], y[i]) for c, (x, y) in enumerate(cuts))
            yield words[0][i][0], b" ".join(w[i][1] for w in words), a[i], left, right, n[i], score


def _rows(blocks: list[int], part: int, blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([part] * len(blocks), pa.int32()), pa.array(blobs, pa.binary())], names=["block", "part", "data"])


COLUMNS = "lang string, phrase string, a long, l long, r long, n long, score long"


def mine(docs: DataFrame, shared: Shared, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """The collocations of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Phrases are runs of 2 to ``longest`` words between separators that occur ``least`` times or more in
    the texts of a language (null: und); null texts are empty. ``l`` and ``r`` belong to the cut with
    the least score, of equals the first. A phrase inside a longer one that occurs ``share`` percent as
    often or more is left out. The first ``top`` by score, count and phrase are given. Rows count as
    often as they are there; other columns play no part; without texts there are no rows.
    """
    spark = docs.sparkSession
    shards = shards_for(docs)
    miner = Miner(shared, shards, min(64, max(24, input_bytes(docs).bit_length() + 4)), least, longest, share, top, runs.widths(shards)[0])
    found = None
    with tidy(spark):
        sequences = miner.words(docs, text_col, lang_col)
        for k in range(2, longest + 1):
            if not miner.levels[k - 1].tables.total:
                break
            sequences = miner.longer(sequences, k)
    top_level = max(miner.levels)
    for k in range(2, top_level + 1):
        if miner.levels[k].blocks:
            part = spark.range(miner.levels[k].blocks).select(F.lit(k).alias("level"), F.col("id").alias("block"))
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], COLUMNS).select("lang", F.lit(1).alias("rank"), "phrase", "a", "l", "r", "n", "score").withColumn("rank", F.col("rank").cast("long"))
    blocks = found.repartition(max(1, sum(x.blocks for x in miner.levels.values())), "level", "block")

    def out(level: int, slots: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(slots), level, np.int32)), pa.array(slots.astype(np.int64))], names=["level", "slot"])

    def frequent(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                level = miner.levels[k]
                yield out(k, np.flatnonzero(level.block(b) >= miner.least) + b * level.width)

    def replaced(batches) -> Iterator[pa.RecordBatch]:
        """Phrases inside one that is a word longer and frequent enough; of a still longer one the same holds for what is between."""
        for batch in batches:
            for k, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                level = miner.levels[k]
                n = level.block(b)
                slots = np.flatnonzero(n >= miner.least)
                if k > 2 and len(slots):
                    halves = level.halves(slots + b * level.width)
                    yield out(k - 1, np.unique(np.concatenate([x[100 * n[slots] >= miner.share * miner.levels[k - 1].counts(x)] for x in halves])))

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[tuple]] = {}
        for batch in batches:
            levels, slots = (c.to_numpy() for c in batch.columns)
            for k in np.unique(levels).tolist():
                for lang, phrase, a, left, right, n, score in miner.scored(k, slots[levels == k]):
                    held.setdefault(lang, []).append((-score, -a, phrase, left, right, n))
            for lang, rows in held.items():
                if len(rows) > 4 * miner.top:
                    held[lang] = heapq.nsmallest(miner.top, rows)
        for lang, rows in held.items():
            rows = heapq.nsmallest(miner.top, rows)
            name = lang.decode()
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(rows), "phrase": [r[2].decode() for r in rows], "a": pa.array([-r[1] for r in rows], pa.int64()), "l": pa.array([r[3] for r in rows], pa.int64()), "r": pa.array([r[4] for r in rows], pa.int64()), "n": pa.array([r[5] for r in rows], pa.int64()), "score": pa.array([-r[0] for r in rows], pa.int64())})

    kept = map_arrow(blocks, frequent, "level int, slot long").join(map_arrow(blocks, replaced, "level int, slot long").distinct(), ["level", "slot"], "left_anti")
    scored = map_arrow(kept, best, COLUMNS)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.hash("phrase"), F.lit(64)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
