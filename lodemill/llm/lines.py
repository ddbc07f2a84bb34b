"""Line de-duplication by a deletion-neighbourhood join over words.

Two lines are the same when their lower-cased words agree, and near when one word's insertion,
deletion or replacement makes them the same; short lines count only as the same, and lines without
words are left alone. Every line but the earliest (by document id, then place) of its like goes.

Near lines have a variant in common: each line gives itself and, for each of its words, itself
without that word, as hashed keys. Under a key that also names the place and the line's length all
lines differ in that place alone; under the key of the shorter line itself stand the lines that
have one word more. So the earliest of a key settles all others, without making pairs, and is
verified against each by the edit distance of their words. Variants are made only for lines that
agree with another in one of their halves, which any two near lines do; halves and variants are
shuffled as sorted runs, and only those that several lines have in common become rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemill.llm import runs
from lodemill.llm.common import ROLL, SPACED, U64, Shared, by_key, gather, hash_words, map_arrow, mix, pack, shard_of, shards_for, signed, unpack
from lodemill.llm.lookup import look_up, save_sorted

#: Words from which a line may go, and from which it goes for a line that is near.
SAME_WORDS, NEAR_WORDS = 1, 4
#: Hashes gathered before a sorted run is given out.
RUN = 1 << 20
NULL_ID = -(1 << 63)
_FACTOR = int(ROLL) ^ 0x6A09E667F3BCC908 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, _FACTOR, U64), np.full(n + 1, pow(_FACTOR, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


def _value(poly: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hash of a word sequence from its polynomial and length."""
    return mix(poly + mix(n.astype(U64)))


class Lines:
    """The lines of a batch of texts as word hashes."""

    def __init__(self, texts: list[bytes]):
        parts = [t.split(b"\n") for t in texts]
        self.texts, self.parts = texts, parts
        self.per = np.array([len(p) for p in parts], np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.per)
        self.pos = np.arange(len(self.doc)) - np.repeat(np.cumsum(self.per) - self.per, self.per)
        self.h, self.bounds = hash_words([line for p in parts for line in p], SPACED)
        self.n = np.diff(self.bounds)
        self.up, self.down = _powers(int(self.n.max()) if len(self.n) else 0)
        place = np.arange(len(self.h)) - np.repeat(self.bounds[:-1], self.n)
        self.total = np.concatenate(([U64(0)], np.cumsum(self.h * self.up[place], dtype=U64)))
        self.other = np.concatenate(([U64(0)], np.cumsum(mix(self.h + U64(77)) * self.up[place], dtype=U64)))
        self.key = _value(self.total[self.bounds[1:]] - self.total[self.bounds[:-1]], self.n)
        self.check = _value(self.other[self.bounds[1:]] - self.other[self.bounds[:-1]], self.n)

    def part(self, lines: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Polynomials of some words of lines, as if they stood at the line's start."""
        at = self.bounds[lines] + first
        return (self.total[at + size] - self.total[at]) * self.down[first]

    def halves(self, lines: np.ndarray) -> np.ndarray:
        """Keys of which two near lines have one in common: front and back halves of a length and of one word less."""
        n, out = self.n[lines], []
        for whole in (n, n - 1):
            front = whole // 2
            back = whole - front
            out.append(mix(_value(self.part(lines, np.zeros_like(n), front), front) + whole.astype(U64) * U64(2)))
            out.append(mix(_value(self.part(lines, n - back, back), back) + whole.astype(U64) * U64(2) + U64(1)))
        return np.stack(out, axis=1)

    def variants(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, roles (0 the line itself, 1 without a word, 2 without the word at a place) and lines."""
        n = self.n[lines]
        own = np.repeat(lines, n)
        place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        size = np.repeat(n, n)
        zero = np.zeros_like(place)
        rest = self.part(own, zero, place) + self.part(own, place + 1, size - place - 1) * self.up[place]
        less = _value(rest, size - 1)
        here = mix(less ^ mix((place + 1).astype(U64) * ROLL + size.astype(U64)))
        keys = np.concatenate([mix(self.key[lines]), mix(less), here])
        roles = np.repeat(np.array([0, 1, 2], np.int8), [len(lines), len(own), len(own)])
        return keys, roles, np.concatenate([lines, own, own])

    def words(self, line: int) -> np.ndarray:
        return self.h[self.bounds[line] : self.bounds[line + 1]]


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the edit distance of two word sequences is at most one."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    front = int(np.argmin(a[:n] == b[:n])) if n and not (a[:n] == b[:n]).all() else n
    back = min(len(a), len(b)) - front
    x, y = a[len(a) - back :] if back else a[:0], b[len(b) - back :] if back else b[:0]
    if len(a) != len(b):
        return bool((x == y).all())
    return bool((x[1:] == y[1:]).all())


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _tie(texts: list[bytes]) -> np.ndarray:
    """Orders documents with one id by their text."""
    return np.array([xxhash.xxh3_64_intdigest(t) >> 1 for t in texts], np.int64)


class Rules:
    """Which lines go: files that ``learn`` wrote."""

    def __init__(self, shared: Shared, shards: int, same_words: int = SAME_WORDS):
        self.shared, self.shards, self.same_words = shared, shards, same_words

    def keep(self, ids: np.ndarray, texts: list[bytes]) -> tuple[Lines, np.ndarray]:
        lines = Lines(texts)
        keep = np.ones(len(lines.doc), bool)
        long = np.flatnonzero(lines.n >= self.same_words)
        keys, check = lines.key[long], signed(lines.check[long])
        hit, (own,) = look_up(keys, self.shared, "gone", ["key", "check"], self.shards)
        keep[long[hit & (own == check)]] = False
        hit, (own, doc, tie, pos) = look_up(keys, self.shared, "first", ["key", "check", "id", "tie", "pos"], self.shards)
        ties = _tie(texts)
        later = hit & (own == check) & ~((doc == ids[lines.doc[long]]) & (tie == ties[lines.doc[long]]) & (pos == lines.pos[long]))
        keep[long[later]] = False
        return lines, keep


class Held:
    """Gathers (hash, line key, role) of a task and gives sorted runs of distinct ones, by hash range."""

    def __init__(self, ranges: int):
        self.ranges, self.parts, self.size = ranges, [], 0

    def add(self, hashes: np.ndarray, keys: np.ndarray, roles: np.ndarray) -> None:
        self.parts.append((hashes, keys, roles))
        self.size += len(hashes)

    def runs(self, least: int = 0) -> list[tuple[int, bytes]]:
        if not self.size or self.size < least:
            return []
        hashes, keys, roles = _distinct(*map(np.concatenate, zip(*self.parts, strict=True)))
        self.parts, self.size = [], 0
        edges = np.searchsorted(shard_of(hashes, self.ranges), np.arange(self.ranges + 1))
        cut = [(s, slice(edges[s], edges[s + 1])) for s in range(self.ranges) if edges[s] < edges[s + 1]]
        return [(s, pack(hashes[c], keys[c], roles[c])) for s, c in cut]


def _distinct(hashes: np.ndarray, keys: np.ndarray, roles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((roles, keys, hashes))
    hashes, keys, roles = hashes[order], keys[order], roles[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (keys[1:] != keys[:-1]) | (roles[1:] != roles[:-1])
    return hashes[new], keys[new], roles[new]


def _shared_ones(blobs: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard's runs what several lines have in common: hashes, lines, roles."""
    held, size, folded = [], 0, 0
    for blob in blobs:
        held.append(tuple(unpack(blob)))
        size += len(held[-1][0])
        if size > max(RUN, 2 * folded):
            held = [_distinct(*map(np.concatenate, zip(*held, strict=True)))]
            size = folded = len(held[0][0])
    hashes, keys, roles = _distinct(*map(np.concatenate, zip(*held, strict=True)))
    at = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    least, most = np.minimum.reduceat(keys, at), np.maximum.reduceat(keys, at)
    kept = np.repeat(least != most, np.diff(np.append(at, len(hashes))))
    return hashes[kept], keys[kept], roles[kept]


def _recut(blobs: Iterable[bytes], parts: int) -> Iterator[pa.RecordBatch]:
    """Runs of a range folded and cut into more ranges."""
    held = Held(parts)

    def out(found: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        if found:
            yield pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in found], pa.int32()), "run": pa.array([r for _, r in found], pa.binary())})

    for blob in blobs:
        held.add(*unpack(blob))
        yield from out(held.runs(RUN))
    yield from out(held.runs())


def _dealt(found: DataFrame, shards: int) -> DataFrame:
    rows = found.where("run is not null").select(F.col("shard").alias("part"), "run")
    return runs.dealt(rows, shards, recut=_recut)


def learn(docs: DataFrame, shared: Shared, id_col: str = "doc_id", text_col: str = "text", same_words: int = SAME_WORDS, near_words: int = NEAR_WORDS) -> Rules:
    """Find the lines of all documents that go.

    Lines of fewer than ``same_words`` words stay, those of fewer than ``near_words`` go only for
    equal ones.
    """
    shards = shards_for(docs)
    parts = runs.widths(shards)[0]
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_col)

    def every(batches) -> Iterator[pa.RecordBatch]:
        held = Held(parts)
        for batch in batches:
            texts = _texts(batch.column(1))
            lines, ids, ties = Lines(texts), _ids(batch.column(0)), _tie(texts)
            long = np.flatnonzero(lines.n >= same_words)
            enough = np.flatnonzero(lines.n >= near_words)
            _, first = np.unique(lines.key[enough], return_index=True)
            halves = lines.halves(enough[first])
            held.add(halves.ravel(), np.repeat(lines.key[enough[first]], 4), np.zeros(halves.size, np.int8))
            yield _row(pa.array(signed(lines.key[long])), pa.array(signed(lines.check[long])), pa.array(ids[lines.doc[long]]), pa.array(ties[lines.doc[long]]), pa.array(lines.pos[long]))
            yield from _blobs(held.runs(RUN))
        yield from _blobs(held.runs())

    def _row(*columns, runs: tuple = (None, None)) -> pa.RecordBatch:
        n = len(columns[0]) if columns else len(runs[0])
        fill = [pa.nulls(n, pa.int64())] * 5
        shard, run = runs if runs[0] is not None else (pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()))
        return pa.RecordBatch.from_arrays([*(columns or fill), shard, run], names=["key", "check", "id", "tie", "pos", "shard", "run"])

    def _blobs(runs: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        if runs:
            yield _row(runs=(pa.array([s for s, _ in runs], pa.int32()), pa.array([r for _, r in runs], pa.binary())))

    found = shared.table(map_arrow(source, every, "key long, check long, id long, tie long, pos long, shard int, run binary"), "found")
    # A line that occurs in very many documents is one row for each task before it is shuffled.
    place = F.struct("id", "tie", "pos")
    lines_ = shared.table(found.where("run is null").groupBy("key", "check").agg(F.min(place).alias("at"), F.count("*").alias("times")), "lines")

    def in_common(batches) -> Iterator[pa.RecordBatch]:
        for (shard,), group in by_key(batches, 1):
            shared.save(f"halves-half-{shard}", np.unique(_shared_ones(run for _, run in group)[0]))
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32())})

    made = {r["shard"] for r in gather(map_arrow(_dealt(found, shards), in_common, "shard int"))}  # one row for each shard
    for s in set(range(shards)) - made:
        shared.save(f"halves-half-{s}", np.zeros(0, U64))
    shared.drop("found")

    def neighbours(batches) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        held = Held(parts)

        def out(keys: list[int], words: list[bytes], runs: list[tuple[int, bytes]]) -> pa.RecordBatch:
            k, r = len(keys), len(runs)
            return pa.RecordBatch.from_pydict({"key": pa.array(signed(np.array(keys, U64)).tolist() + [None] * r, pa.int64()), "words": pa.array(words + [None] * r, pa.binary()), "shard": pa.array([None] * k + [s for s, _ in runs], pa.int32()), "run": pa.array([None] * k + [b for _, b in runs], pa.binary())})

        for batch in batches:
            lines = Lines(_texts(batch.column(1)))
            long = np.flatnonzero(lines.n >= near_words)
            halves = lines.halves(long)
            hit, _ = look_up(halves.ravel(), shared, "halves", ["half"], shards)
            hit = hit.reshape(halves.shape).any(axis=1)
            _, at = np.unique(lines.key[long[hit]], return_index=True)
            chosen = np.array([k for k in long[hit][at] if int(lines.key[k]) not in done], np.int64)
            if len(done) > RUN:  # lines that come again are only given out again
                done.clear()
            done.update(int(x) for x in lines.key[chosen])
            for first in range(0, len(chosen), 2000):
                part = chosen[first : first + 2000]
                keys, roles, own = lines.variants(part)
                held.add(keys, lines.key[own], roles)
                yield out(lines.key[part].tolist(), [lines.words(k).tobytes() for k in part], held.runs(RUN))
        yield out([], [], held.runs())

    variants = shared.table(map_arrow(source, neighbours, "key long, words binary, shard int, run binary"), "variants")

    def members(batches) -> Iterator[pa.RecordBatch]:
        for _, group in by_key(batches, 1):
            hashes, keys, roles = _shared_ones(run for _, run in group)
            for k in range(0, len(hashes), 1 << 16):
                part = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_pydict({"variant": pa.array(signed(hashes[part])), "role": pa.array(roles[part]), "key": pa.array(signed(keys[part]))})

    joined = map_arrow(_dealt(variants, shards), members, "variant long, role byte, key long")
    places = lines_.groupBy("key").agg(F.min("at").alias("at"))
    known = shared.table(joined.join(places, "key"), "members")
    # The earliest line of a variant and role, with what it is; a place's lines settle each other, a line settles those with one word more and they it.
    best = known.groupBy("variant", "role").agg(F.min(F.struct("at", "key")).alias("best"))
    against = best.select("variant", F.when(F.col("role") == 2, 2).when(F.col("role") == 1, 0).otherwise(1).cast("byte").alias("role"), "best")
    told = known.join(against, ["variant", "role"]).where("best.at < at").select("key", F.col("best.key").alias("other")).distinct()
    texts = variants.where("words is not null").select("key", "words").dropDuplicates(["key"])
    pairs = told.join(texts, "key").join(texts.select(F.col("key").alias("other"), F.col("words").alias("theirs")), "other").select("key", "words", "theirs")

    def verify(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, a, b = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, x, y in zip(keys, a, b, strict=True) if near(np.frombuffer(x, U64), np.frombuffer(y, U64))], pa.int64())})

    gone = shared.table(map_arrow(pairs, verify, "key long").distinct(), "gone-keys")
    for name in ("members", "variants"):
        shared.drop(name)
    checks = lines_.join(gone, "key", "left_semi").select("key", "check")
    save_sorted(checks, ["key", "check"], shared, "gone", shards)
    save_sorted(lines_.where("times > 1").select("key", "check", "at.*"), ["key", "check", "id", "tie", "pos"], shared, "first", shards)
    for name in ("gone-keys", "lines"):
        shared.drop(name)
    return Rules(shared, shards, same_words)


def line_report(docs: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``id_col``, ``n_lines``, ``n_dropped``, ``dropped`` (their places), ``kept_sha256`` and, with ``keep_text``, ``kept``.

    Ids are integers; documents with one id are ordered by text, and rows equal in both are one
    document: each keeps the same lines. A null id comes before all others. A null text is one
    empty line and stays so. Other columns are not read.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(1))
            lines, keep = rules.keep(_ids(batch.column(0)), texts)
            kept, dropped = _apply(lines, keep)
            columns = {id_col: batch.column(0).cast(pa.int64()), "n_lines": pa.array(lines.per), "n_dropped": pa.array([len(d) for d in dropped], pa.int64()), "dropped": pa.array(dropped, pa.list_(pa.int64())), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in kept])}
            if keep_text:
                columns["kept"] = pa.array([t.decode() for t in kept], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return map_arrow(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), run, f"`{id_col}` long, n_lines long, n_dropped long, dropped array<long>, kept_sha256 string" + (", kept string" if keep_text else ""))


def _apply(lines: Lines, keep: np.ndarray) -> tuple[list[bytes], list[list[int]]]:
    kept, dropped, at = [], [], 0
    for text, parts in zip(lines.texts, lines.parts, strict=True):
        mine = keep[at : at + len(parts)]
        at += len(parts)
        if mine.all():
            kept.append(text)
            dropped.append([])
        else:
            kept.append(b"\n".join([p for p, k in zip(parts, mine.tolist(), strict=True) if k]))
            dropped.append(np.flatnonzero(~mine).tolist())
    return kept, dropped


def drop_lines(docs: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The documents with what is left of their texts; those that lose every word go.

    A null text stays null. ``size_col`` is set anew where a text has changed.
    """
    names = docs.columns
    at, key, size = names.index(text_col), names.index(id_col), names.index(size_col) if size_col in names else None

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(at))
            lines, keep = rules.keep(_ids(batch.column(key)), texts)
            kept, dropped = _apply(lines, keep)
            changed = np.array([bool(d) for d in dropped], bool)
            columns = list(batch.columns)
            new = [t.decode() if c else None for t, c in zip(kept, changed, strict=True)]
            columns[at] = pa.array([n if c else old for n, c, old in zip(new, changed, batch.column(at).to_pylist(), strict=True)], pa.string())
            if size is not None:
                columns[size] = pa.array([len(n) if c else old for n, c, old in zip(new, changed, batch.column(size).to_pylist(), strict=True)], columns[size].type)
            left = pa.array([not c or bool(t.strip()) for t, c in zip(kept, changed, strict=True)])
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(left)

    return map_arrow(docs, run, docs.schema)
