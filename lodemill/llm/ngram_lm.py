"""Interpolated modified Kneser-Ney language model over hashed n-grams.

n-grams are counted in Spark, the longest first, in a pass over the texts for each length: a task
folds its texts' n-grams into sorted runs, runs are shuffled by hash range and folded again. The
longest keep their counts. What they say of those one word shorter, as whose ends and contexts
they count once each, however often they occur, comes from the texts too: each text adds one over
the number of texts that hold the longer n-gram, and these shares sum to whole numbers. An n-gram
that is also a context has, beside its count, its total and its numbers of followers seen once,
twice and more often.

Sorted arrays of hashes with these numbers are stored in the folder that all workers share;
workers memory-map them and look up a batch's distinct n-grams in order. A task holds one shard's
n-grams at a time and appends it to its file; the driver sees one row of sums for each file.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import ExitStack
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodemill.llm.common import ROLL, SPACED, U64, Shared, by_key, distinct, find, gather, gathered, hash_words, map_arrow, mix, order_of, pack, shard_of, shards_for, shared_key, tidy, unpack, utf8

#: Hashes of the text's begin and end, which no word has but by chance.
BEGIN, END = U64(0x243F6A8885A308D3), U64(0x13198A2E03707344)
#: Bytes of keys and numbers folded into a run, and of text looked up at once.
RUN_BYTES, SCORE_BYTES = 64 << 20, 4 << 20
#: Input bytes for each shard, files at least before a file holds several shards, shards of a file at most.
SHARD_BYTES, LEAST_FILES, FILE_SHARDS = 8 << 20, 64, 32
#: Shards to which a run is dealt at once: more are reached by a second deal.
FAN = 1024
#: Binary places of a share: run sums are rounded to them.
SHARE_BITS = 26
#: Bits of a number that is packed with the others, and the code of numbers that the file's book of common ones lacks.
PACK_BITS, RARE = 10, 255
#: The bits of a stored key that hold the code.
CODE = U64(255)

def token_hashes(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's begin marks, words and end, and the bounds of the texts in them."""
    h, bounds = hash_words(texts, SPACED)
    n, pad = np.diff(bounds), max(1, order - 1)
    starts = bounds[:-1] + np.arange(len(texts)) * (pad + 1)
    out = np.full(len(h) + len(texts) * (pad + 1), BEGIN, U64)
    doc = np.repeat(np.arange(len(texts)), n)
    out[np.arange(len(h)) + doc * (pad + 1) + pad] = h
    ends = starts + pad + n
    out[ends] = END
    return out, np.append(starts, len(out))


def join_hash(words: list[np.ndarray]) -> np.ndarray:
    """One hash for each row of words; a single word stands for itself."""
    out = words[0].copy()
    for w in words[1:]:
        out = mix(out * ROLL + w + U64(len(words)))
    return out


def ngrams(h: np.ndarray, ends: np.ndarray, n: int) -> list[np.ndarray]:
    """The n words of the n-grams that end at the given places."""
    return [h[ends - k] for k in range(n - 1, -1, -1)]


def token_places(bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens and of the begin mark before each text's first one, and where among these the tokens are."""
    pad = max(1, order - 1)
    used = np.ones(bounds[-1], bool)
    for k in range(pad - 1):
        used[bounds[:-1] + k] = False
    here = np.ones(bounds[-1] - (pad - 1) * (len(bounds) - 1), bool)
    here[bounds[:-1] - (pad - 1) * np.arange(len(bounds) - 1)] = False
    return np.flatnonzero(used), np.flatnonzero(here)


def folded(keys: np.ndarray, fields: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys and the sums of their fields."""
    if not len(keys):
        return keys, fields
    order = order_of(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], [np.add.reduceat(f[order], at) for f in fields]


def grouped(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, the order that sorts all, where in it each begins, and in how many texts each occurs; texts ascend."""
    order = order_of(keys, stable=True)
    k, d = keys[order], doc[order]
    new = np.ones(len(k), bool)
    np.not_equal(k[1:], k[:-1], out=new[1:])
    at = np.flatnonzero(new)
    new[1:] |= d[1:] != d[:-1]
    return k[at], order, at, np.add.reduceat(new, at, dtype=np.int64)


def fields_of(n: int, order: int) -> int:
    """Numbers of an n-gram.

    Of the longest: count, texts. Of others: count by the distinct words before it, total and
    followers seen once, twice, more often as a context, and texts; a word has its plain count
    first and no texts.
    """
    return 2 if n == order else 6


@dataclass(frozen=True)
class Layout:
    """Shards are ranges of hashes, files are runs of shards."""

    shards: int
    files: int

    @classmethod
    def of(cls, docs: DataFrame) -> Layout:
        shards = shards_for(docs, each=SHARD_BYTES)
        return cls(shards, min(shards, max(LEAST_FILES, shards // FILE_SHARDS)))

    def runs(self, keys: np.ndarray, fields: list[np.ndarray], parts: int) -> pa.RecordBatch:
        """A run of sorted keys as one blob for each of so many ranges."""
        edges = np.searchsorted(shard_of(keys, parts), np.arange(parts + 1))
        kept = [s for s in range(parts) if edges[s] < edges[s + 1]]
        cut = [slice(edges[s], edges[s + 1]) for s in kept]
        return _rows([s * self.files // parts for s in kept], [s * (self.shards // parts) for s in kept], [pack(keys[c], *(_narrow(f[c]) for f in fields)) for c in cut])


def _narrow(n: np.ndarray) -> np.ndarray:
    return n.astype(np.uint8) if not len(n) or n.max() < 256 else n.astype(np.uint32) if n.max() < 1 << 32 else n.astype(np.uint64)


def _rows(files: list[int], shards: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"file": pa.array(files, pa.int32()), "shard": pa.array(shards, pa.int32()), "run": pa.array(blobs, pa.binary())})


def _fold_all(parts: list[tuple[np.ndarray, list[np.ndarray]]]) -> tuple[np.ndarray, list[np.ndarray]]:
    return folded(np.concatenate([k for k, _ in parts]), [np.concatenate(x) for x in zip(*(f for _, f in parts), strict=True)])


def _bytes(run: tuple[np.ndarray, list[np.ndarray]]) -> int:
    return run[0].nbytes * (1 + len(run[1]))


def _read(blob: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    keys, *fields = unpack(blob)
    return keys, [f.astype(np.int64) for f in fields]


def _merge(blobs: Iterator[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Fold the runs of a shard as they come."""
    held: list[tuple[np.ndarray, list[np.ndarray]]] = []
    size = 0
    for blob in blobs:
        held.append(_read(blob))
        size += len(held[-1][0])
        if len(held) > 1 and size > max(1 << 19, 2 * len(held[0][0])):
            held = [_fold_all(held)]
            size = len(held[0][0])
    return _fold_all(held)


class _Writer:
    """Writes one file's n-grams, a shard after another: the 56 bits of each key after those that all have, and a code of its numbers.

    After them come the places and numbers of those without a code, and how many there are of each: one file is opened
    for a search, and one number holds all that it reads of an n-gram.
    """

    def __init__(self, shared: Shared, name: str, files: int, fields: int, stack: ExitStack):
        self.out = stack.enter_context(shared.stream(f"{name}.high"))
        self.save_book = lambda book: shared.save(f"{name}.book", book)
        self.bits, self.book, self.at = files.bit_length() - 1, None, 0
        self.rare, self.large = [np.zeros((2, 0), U64)], [np.zeros((fields + 1, 0), U64)]

    def add(self, keys: np.ndarray, fields: list[np.ndarray]) -> None:
        packed, fits = np.zeros(len(keys), U64), np.ones(len(keys), bool)
        for k, f in enumerate(fields):
            fits &= f < 1 << PACK_BITS
            packed |= f.astype(U64) << U64(k * PACK_BITS)
        if self.book is None:  # the most frequent numbers of the first shard
            values, n = np.unique(packed[fits], return_counts=True)
            self.book = np.sort(values[np.argsort(-n, kind="stable")[:RARE]])
        at = np.minimum(np.searchsorted(self.book, packed), max(0, len(self.book) - 1))
        common = fits & (self.book[at] == packed) if len(self.book) else np.zeros(len(keys), bool)
        self.out.write(((keys << U64(self.bits)) & ~CODE | np.where(common, at, RARE).astype(U64)).astype("<u8").tobytes())
        rare, large = np.flatnonzero(fits & ~common), np.flatnonzero(~fits)
        self.rare.append(np.stack([(rare + self.at).astype(U64), packed[rare]]))
        self.large.append(np.stack([(large + self.at).astype(U64), *(f[large].astype(U64) for f in fields)]))
        self.at += len(keys)

    def finish(self) -> None:
        rare, large = np.concatenate(self.rare, axis=1), np.concatenate(self.large, axis=1)
        for rows in (rare, large, np.array([rare.shape[1], large.shape[1]], U64)):
            self.out.write(rows.astype("<u8").tobytes())
        self.save_book(self.book)


def _stored(shared: Shared, name: str, fields: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A file's n-grams with their codes, and the rows of those without a code: packed numbers, and plain ones."""
    every = np.asarray(shared.mapped(f"{name}.high", "u8"))
    rare, large = (int(x) for x in every[-2:])
    last = len(every) - 2 - (fields + 1) * large
    return every[: last - 2 * rare], every[last - 2 * rare : last].reshape(2, rare), every[last:-2].reshape(fields + 1, large)


#: The books of the files of one folder, at most RARE numbers each, in this worker's memory.
_books: dict[tuple[str, str], np.ndarray] = {}


def _book(shared: Shared, name: str) -> np.ndarray:
    key = (shared.uri, name)
    if key not in _books:
        if _books and next(iter(_books))[0] != shared.uri:
            _books.clear()
        _books[key] = np.load(shared.path(f"{name}.book.npy"))
    return _books[key]


@dataclass(frozen=True)
class Tables:
    """The stored n-grams of some lengths."""

    shared: Shared
    files: int
    order: int
    stored: dict[int, tuple[int, ...]]  # the files that there are, by length

    def get(self, n: int, keys: np.ndarray, fields: Sequence[int]) -> np.ndarray:
        """These numbers of each of the sorted distinct n-grams, a row for each number; 0 where it is not stored."""
        out = np.zeros((len(fields), len(keys)), np.int64)
        edges, stored = np.searchsorted(shard_of(keys, self.files), np.arange(self.files + 1)), set(self.stored[n])
        for f in np.flatnonzero(np.diff(edges)):
            if int(f) in stored:
                part = slice(edges[f], edges[f + 1])
                self._look_up(n, f"t{n}-{f}", keys[part], fields, out[:, part])
        return out

    def _look_up(self, n: int, name: str, keys: np.ndarray, fields: Sequence[int], out: np.ndarray) -> None:
        own = keys << U64(self.files.bit_length() - 1)
        grams, rare, large = _stored(self.shared, name, fields_of(n, self.order))
        at = np.searchsorted(grams, own & ~CODE)
        np.minimum(at, len(grams) - 1, out=at)
        found = grams[at]
        code = np.where((found ^ own) <= CODE, found & CODE, CODE + U64(1)).astype(np.int64)
        book, mask = _book(self.shared, name), U64((1 << PACK_BITS) - 1)
        of_code = np.zeros(RARE + 2, np.int64)  # nothing for those without a code and for what is not stored
        for row, k in enumerate(fields):
            of_code[: len(book)] = (book >> U64(k * PACK_BITS)) & mask
            np.take(of_code, code, out=out[row])
        odd = np.flatnonzero(code == RARE)
        if not len(odd):
            return
        k, known = find(rare[0], at[odd].astype(U64))
        packed, some = rare[1][k[known]], odd[known]
        big = odd[~known]
        where = np.searchsorted(large[0], at[big].astype(U64))
        for row, k in enumerate(fields):
            out[row, some] = (packed >> U64(k * PACK_BITS)) & mask
            out[row, big] = large[k + 1][where]


@dataclass(frozen=True)
class Model:
    tables: Tables
    order: int
    tokens: int  # of the training texts
    words: int  # distinct ones
    discounts: tuple[tuple[float, float, float], ...]  # by order, from 1
    first: tuple[float, float, float, float]  # total and followers seen once, twice, more of the empty context

    def score(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """Of each text: tokens, known tokens, the base's and the model's log10 probability."""
        h, bounds = token_hashes(texts, self.order)
        # An n-gram is looked up once, for its count and as the context of what follows it.
        places, here = token_places(bounds, self.order)
        found, back = distinct(h[places])
        raw, continued, *context = self.tables.get(1, found, range(6))
        at, before = back[here], back[here - 1]
        known, base = (raw > 0)[at], np.log10((raw + 1) / (self.tokens + self.words + 1))[at]
        total, *followers = self.first
        d = np.array((0.0, *self.discounts[0]))
        kept = np.maximum(continued - d[np.minimum(continued, 3)], 0) / max(total, 1)
        spread = sum(x * n for x, n in zip(d[1:], followers, strict=True)) / max(total, 1) if total else 1.0
        p = (kept + spread / (self.words + 1))[at]
        for n in range(2, self.order + 1):
            total, one, two, more = context
            d = np.array((0.0, *self.discounts[n - 1]))
            safe = np.maximum(total, 1)
            spread, safe, seen = ((d[1] * one + d[2] * two + d[3] * more) / safe)[before], safe[before], (total > 0)[before]
            if n < self.order:
                found, back = distinct(join_hash(ngrams(h, places, n)))
                count, *context = self.tables.get(n, found, range(5))
                at, before = back[here], back[here - 1]
            else:
                found, at = distinct(join_hash(ngrams(h, places[here], n)))
                (count,) = self.tables.get(n, found, range(1))
            kept = np.maximum(count - d[np.minimum(count, 3)], 0)[at] / safe
            p = np.where(seen, kept + spread * p, p)
        n_tokens = np.diff(bounds) - max(1, self.order - 1)
        starts = np.cumsum(n_tokens) - n_tokens
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0)  # noqa: E731  each text has its end at least
        return {"n_tokens": n_tokens, "n_known": add(known.astype(np.int64)), "base_score": add(base), "score": add(np.log10(p))}


def counted(texts: list[bytes], n: int, tables: Tables) -> tuple[np.ndarray, list[np.ndarray]]:
    """What some texts add to the numbers of n-grams; shares of one are in units of 2 ** -SHARE_BITS."""
    order = tables.order
    h, bounds = token_hashes(texts, order)
    places, here = token_places(bounds, order)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(bounds) - (max(1, order - 1) - 1))
    keys, places_of, at, texts_of = grouped(join_hash(ngrams(h, places[here], min(n + 1, order))), doc[here])
    if n == order:
        return keys, [np.diff(at, append=len(here)), texts_of]
    # A longer n-gram counts once for all of these texts that hold it, wherever one of them has it.
    value, held_by = tables.get(n + 1, keys, (0, fields_of(n + 1, order) - 1))
    share, one = texts_of / np.maximum(held_by, 1), here[places_of[at]]
    known, sorting, at, texts_of = grouped(join_hash(ngrams(h, places, n)), doc)
    back = np.empty(len(places), np.int64)
    back[sorting] = np.repeat(np.arange(len(known)), np.diff(at, append=len(places)))
    as_end, as_context = back[one], back[one - 1]
    sums = [np.bincount(as_end, share, len(known)), np.bincount(as_context, value * share, len(known))]
    sums += [np.bincount(as_context[on], share[on], len(known)) for on in (value == 1, value == 2, value > 2)]
    shares = [np.round(x * (1 << SHARE_BITS)).astype(np.int64) for x in sums]
    whole = np.bincount(back[here], minlength=len(known))
    return known, [whole, *shares] if n == 1 else [*shares, np.where(whole, texts_of, 0)]


def train(docs: DataFrame, shared: Shared, text_col: str = "text", order: int = 2, layout: Layout | None = None) -> Model:
    """Count and store a model of the given order from every text; null is empty."""
    if order < 2:
        raise ValueError("the order must be 2 at least")
    layout = layout or Layout.of(docs)
    wide = layout.shards if layout.shards <= FAN else layout.files
    tables, stats = Tables(shared, layout.files, order, {}), np.zeros((order, 8))

    def count(n: int, tables: Tables):
        def run(batches) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for batch in gathered(batches, SCORE_BYTES):
                held.append(counted(utf8(batch.column(0)), n, tables))
                size += _bytes(held[-1])
                if size >= RUN_BYTES:
                    yield layout.runs(*_fold_all(held), wide)
                    held, size = [], 0
            if size:
                yield layout.runs(*_fold_all(held), wide)

        return run

    def split(batches) -> Iterator[pa.RecordBatch]:
        """Deal the runs of a file to its shards, several runs at once."""
        for _, group in by_key(batches, 1):
            held, size = [], 0
            for row in group:
                held.append(_read(row[2]))
                size += _bytes(held[-1])
                if size >= RUN_BYTES:
                    yield layout.runs(*_fold_all(held), layout.shards)
                    held, size = [], 0
            if held:
                yield layout.runs(*_fold_all(held), layout.shards)

    def store(n: int):
        shares = slice(0, 0) if n == order else slice(1, 6) if n == 1 else slice(0, 5)

        def run(batches) -> Iterator[pa.RecordBatch]:
            for (file,), rows in by_key(batches, 1):
                sums = np.zeros(8)
                with ExitStack() as stack:
                    out = _Writer(shared, f"t{n}-{file}", layout.files, fields_of(n, order), stack)
                    for _, group in groupby(rows, key=lambda r: r[1]):
                        keys, fields = _merge(r[2] for r in group)
                        fields[shares] = [(f + (1 << SHARE_BITS - 1)) >> SHARE_BITS for f in fields[shares]]
                        out.add(keys, fields)
                        value = fields[1 if n == 1 else 0]  # below the highest order, how many distinct words come before
                        sums += [(fields[0] > 0).sum(), fields[0].sum(), value.sum(), *((value == k).sum() for k in (1, 2, 3, 4)), (value > 2).sum()]
                    out.finish()
                yield pa.RecordBatch.from_pydict({"file": pa.array([file], pa.int32()), "sums": pa.array([sums], pa.list_(pa.float64()))})

        return run

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(layout.files, shared_key("file", layout.files)).sortWithinPartitions("file", "shard")

    schema = "file int, shard int, run binary"
    for n in range(order, 0, -1):
        with tidy(docs.sparkSession):
            rows = map_arrow(docs.select(text_col), count(n, tables), schema)
            if wide < layout.shards:
                rows = map_arrow(dealt(rows), split, schema)
            made = gather(map_arrow(dealt(rows), store(n), "file int, sums array<double>"))  # one row for each file
        for r in made:
            stats[n - 1] += r["sums"]
        tables = Tables(shared, layout.files, order, tables.stored | {n: tuple(sorted(r["file"] for r in made))})
    s = stats[0]
    return Model(tables, order, int(s[1]), int(s[0]), tuple(_discounts(*x[3:7]) for x in stats), (s[2], s[3], s[4], s[7]))


def _discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """The three discounts from how many n-grams are counted one to four times."""
    if not (n1 and n2):
        return (0.5, 1.0, 1.5)
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(x, 0.05), k) for k, x in enumerate(d, 1))


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and ``perplexity`` of each whole text.

    A null or empty text has only the end. Untrained models give every token the same share.
    Rows are independent of each other and of other columns.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, SCORE_BYTES):
            got = model.score(utf8(batch.column(1)))
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "n_tokens": pa.array(got["n_tokens"], pa.int64()), "n_known": pa.array(got["n_known"], pa.int64()), "train_tokens": pa.array(np.full(batch.num_rows, model.tokens, np.int64)), "base_score": pa.array(got["base_score"]), "score": pa.array(got["score"]), "perplexity": pa.array(10 ** (-got["score"] / got["n_tokens"]))})

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
