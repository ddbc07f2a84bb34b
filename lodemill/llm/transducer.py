"""Byte-level BPE by a minimal acyclic transducer of frequent words.

A chunk of text, a word with the white space before it, is encoded alone (see ``ByteTable``). Spark
counts the chunks of all texts; those that make up at least a fixed share of all become the
lexicon, which that share bounds. It is compiled into an automaton that reads a chunk's bytes and
puts out its ids: each transition carries the ids that are certain once it is taken, equal states
are one, so words share their ends as well as their beginnings. Its transitions are a hash table
of (state, byte) in arrays that workers memory-map.

A batch's distinct chunks walk the automaton together, a byte of all of them at a time. Chunks
that it does not know are merged exactly, by the library's own merge model. Ids go back to their
places in the texts by position, and to bytes by a table of the tokens' bytes.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemill.llm.common import U64, Shared, gather, gathered, map_arrow, mix
from lodemill.llm.token_files import _CHUNK, _ODD, ByteTable, _byte_chars, byte_table

#: A chunk belongs to the lexicon if it is one of so many or more; the lexicon has at most as many chunks.
SHARE = 1 << 19
#: Bytes of the longest chunk in the lexicon, distinct chunks that a task counts before it hands them on, bytes of text at once.
CHUNK_BYTES, COUNTED, TEXT_BYTES = 48, 1 << 18, 4 << 20
#: Bytes of chunks and their ids that a worker remembers of those it had to merge.
MERGED_BYTES = 48 << 20


class _State:
    __slots__ = ("arcs", "final", "tail")

    def __init__(self):
        self.arcs: list[list] = []  # [byte, state, ids], in the bytes' order
        self.final, self.tail = False, ()


def _shared_start(a: tuple, b: tuple) -> tuple:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return a[:n]


def build(words: Iterable[tuple[bytes, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """The arrays of the minimal transducer of distinct words in ascending order.

    States on the way of the last word are open; when the next word leaves that way, those behind
    the fork are closed, and a closed state equal to a known one becomes that one. Ids stand as near
    to the start as the words that share a transition allow.
    """
    known: dict[tuple, int] = {}
    arcs: list[tuple[int, int, int, tuple]] = []  # state, byte, target, ids
    finals: list[tuple | None] = []

    def close(state: _State) -> int:
        key = (state.tail if state.final else None, tuple((b, t, ids) for b, t, ids in state.arcs))
        number = known.get(key)
        if number is None:
            number = known[key] = len(finals)
            finals.append(key[0])
            arcs.extend((number, *arc) for arc in key[1])
        return number

    way, before = [_State()], b""
    for word, ids in words:
        n = 0
        while n < len(before) and n < len(word) and word[n] == before[n]:
            n += 1
        for k in range(len(before), n, -1):
            way[k - 1].arcs[-1][1] = close(way[k])
        del way[n + 1 :]
        for b in word[n:]:
            way[-1].arcs.append([b, -1, ()])
            way.append(_State())
        way[-1].final = True
        rest = ids
        for k in range(n):  # ids that this word does not share move on
            arc = way[k].arcs[-1]
            same = _shared_start(arc[2], rest)
            moved = arc[2][len(same) :]
            if moved:
                arc[2], after = same, way[k + 1]
                for x in after.arcs:
                    x[2] = moved + x[2]
                if after.final:
                    after.tail = moved + after.tail
            rest = rest[len(same) :]
        if n < len(word):
            way[n].arcs[-1][2] = rest
        else:
            way[-1].tail = rest
        before = word
    for k in range(len(before), 0, -1):
        way[k - 1].arcs[-1][1] = close(way[k])
    start = close(way[0])
    return _arrays(start, arcs, finals)


def _arrays(start: int, arcs: list[tuple[int, int, int, tuple]], finals: list[tuple | None]) -> dict[str, np.ndarray]:
    pool: list[int] = []
    places: dict[tuple, int] = {}

    def place(ids: tuple | None) -> int:
        if ids and ids not in places:
            places[ids] = len(pool)
            pool.extend(ids)
        return places[ids] if ids else 0

    keys = np.array([s << 8 | b for s, b, _, _ in arcs], np.uint32) + np.uint32(1)
    size = 1 << max(1, (2 * len(arcs)).bit_length())
    slots, row = np.zeros(size, np.uint32), np.zeros(size, np.uint32)
    left, at = np.arange(len(arcs)), _slot(keys, size)
    while len(left):  # each key goes to the first free slot from its own on
        free = slots[at[left]] == 0
        first = np.unique(at[left[free]], return_index=True)[1]
        put = left[free][first]
        slots[at[put]], row[at[put]] = keys[put], put
        left = left[slots[at[left]] != keys[left]]
        at[left] = (at[left] + 1) & (size - 1)
    return {
        "slots": slots,
        "row": row,
        "target": np.array([t for _, _, t, _ in arcs], np.uint32),
        "arc_at": np.array([place(ids) for *_, ids in arcs], np.uint32),
        "arc_n": np.array([len(ids) for *_, ids in arcs], np.uint8),
        "end_at": np.array([place(ids) for ids in finals], np.uint32),
        "end_n": np.array([255 if ids is None else len(ids) for ids in finals], np.uint8),
        "pool": np.array(pool or [0], np.uint32),
        "start": np.array([start], np.uint32),
    }


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    return (mix(keys.astype(U64)) & U64(size - 1)).astype(np.int64)


def ragged(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places at[k], at[k] + 1, ... of n[k] each, one after another."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(n) else 0) + np.repeat(at - ends + n, n)


ARRAYS = ("slots", "row", "target", "arc_at", "arc_n", "end_at", "end_n", "pool", "start")


@dataclass(frozen=True)
class Transducer:
    """The stored automaton; ``arrays`` has them in memory, else they are mapped."""

    shared: Shared | None = None
    arrays: tuple[np.ndarray, ...] = ()

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> Transducer:
        return cls(None, tuple(arrays[n] for n in ARRAYS))

    def walk(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word is known, how many ids it has, and the ids of all of them in order."""
        slots, row, target, arc_at, arc_n, end_at, end_n, pool, start = self.arrays or (self.shared.load(f"fst-{n}") for n in ARRAYS)
        text = np.frombuffer(b"".join(words), np.uint8)
        n = np.array([len(w) for w in words], np.int64)
        at, state = np.cumsum(n) - n, np.full(len(words), start[0], np.int64)
        known = n <= CHUNK_BYTES
        of, where, many = [], [], []
        size = len(slots)
        for k in range(int(n[known].max()) if known.any() else 0):
            on = np.flatnonzero(known & (n > k))
            keys = (state[on].astype(np.uint32) << np.uint32(8) | text[at[on] + k]) + np.uint32(1)
            s, found, open_ = _slot(keys, size), np.full(len(on), -1, np.int64), np.arange(len(on))
            while len(open_):
                held = slots[s[open_]]
                hit = held == keys[open_]
                found[open_[hit]] = row[s[open_[hit]]]
                open_ = open_[~hit & (held != 0)]
                s[open_] = (s[open_] + 1) & (size - 1)
            known[on[found < 0]] = False
            on, found = on[found >= 0], found[found >= 0]
            state[on] = target[found]
            out = np.flatnonzero(arc_n[found])
            of.append(on[out])
            where.append(arc_at[found[out]])
            many.append(arc_n[found[out]])
        last = end_n[state]
        known &= last != 255
        tail = np.flatnonzero(known & (last > 0))
        of, where, many = np.concatenate([*of, tail]), np.concatenate([*where, end_at[state[tail]]]), np.concatenate([*many, last[tail]])
        keep = known[of]
        order = np.argsort(of[keep], kind="stable")
        of, where, many = of[keep][order], where[keep][order].astype(np.int64), many[keep][order].astype(np.int64)
        counts = np.zeros(len(words), np.int64)
        np.add.at(counts, of, many)
        return known, counts, pool[ragged(where, many)]


def pieces_of(text: str, table: ByteTable, stops: bool = True) -> list[str] | None:
    """The keys of a text's chunks (see ``raw``); none if it must be encoded whole.

    With ``stops`` a comma or full stop before white space is a chunk of its own, which holds where a letter or
    number stands before it;
    elsewhere it belongs to what stands there.
    """
    if not table.safe or _ODD.search(text) or "\0" in text or any(a in text for a in table.added):
        return None
    if not text:
        return []
    spaced = text.replace("\n", " \n")
    if spaced[0] == " " or spaced[-1] in " \n" or "  " in spaced or "\n " in spaced:
        return ["\0" + c for c in _CHUNK.findall(text)]
    if stops and spaced[0] not in ",.":
        cut = spaced.replace(", ", " \0, ").replace(". ", " \0. ")
        spaced = spaced if "  " in cut else cut  # a stop after white space stays with it
    words = spaced.split(" ")
    words[0] = "\0" + words[0]
    return words


#: The keys of stops that are chunks of their own.
STOPS = ("\0,", "\0.")


def raw(key: str) -> str:
    """The chunk of a key: after a null as it stands, with its line feed, or with a space before it."""
    return key[1:] if key[0] == "\0" else key if key[0] == "\n" else " " + key


def count_chunks(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """How often each chunk occurs in all texts: ``chunk`` and ``n``; chunks that are too long for the lexicon are left out."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        table, held = byte_table(path, True), Counter()

        def out() -> pa.RecordBatch:
            rows = Counter()
            for key, n in held.items():
                rows[raw(key)] += n
            kept = [(c, n) for c, n in rows.items() if len(c.encode()) <= CHUNK_BYTES]
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["chunk", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:  # a misread stop only makes another choice of chunks
                    held.update(pieces_of(text, table) or ())
            if len(held) >= COUNTED:
                yield out()
                held.clear()
        if held:
            yield out()

    return map_arrow(docs.select(text_col), run, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, path: str, shared: Shared, text_col: str = "text", share: int = SHARE) -> Transducer:
    """Count, choose and compile the frequent chunks of all texts; one task builds the automaton, of ``share`` chunks at most."""
    counts = shared.table(count_chunks(docs, path, text_col).where("n > 1"), "chunks")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    chosen = counts.where(F.col("n") * share >= total).select(F.col("chunk").cast("binary").alias("chunk"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        table = byte_table(path, True)
        words = sorted(w for batch in batches for w in batch.column(0).to_pylist())
        ids = ((w, tuple(np.frombuffer(table._chunk(w.decode()), "<u4").tolist())) for w in words)
        for name, array in build(ids).items():
            shared.save(f"fst-{name}", array)
        yield pa.RecordBatch.from_pydict({"words": pa.array([len(words)], pa.int64())})

    gather(map_arrow(chosen.coalesce(1), run, "words long"))  # one row
    return Transducer(shared)


class _Numbers(dict):
    """Numbers of keys, by their first occurrence."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class Encoder:
    """Encodes batches of texts with a stored lexicon, and decodes their ids."""

    def __init__(self, path: str, lexicon: Transducer):
        self.table, self.lexicon = byte_table(path, True), lexicon
        self.merged: dict[str, bytes] = {}
        self.size = 0
        model, back = self.table.model, {c: b for b, c in _byte_chars().items()}
        names = {i: t for t, i in model.get_vocab(with_added_tokens=True).items()}
        said = [names.get(i, "") for i in range(max(names, default=-1) + 1)]
        self.bytes = [bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in said]
        self.byte_n = np.array([len(b) for b in self.bytes], np.int64)
        self.byte_at = np.cumsum(self.byte_n) - self.byte_n
        self.byte_pool = np.frombuffer(b"".join(self.bytes), np.uint8)

    def merge(self, chunk: str) -> bytes:
        """The ids of a chunk by the merge rules themselves."""
        got = self.merged.get(chunk)
        if got is None:
            got = self.table._chunk(chunk)
            if len(chunk) <= CHUNK_BYTES:
                if self.size > MERGED_BYTES:
                    self.merged, self.size = {}, 0
                self.merged[chunk] = got
                self.size += 4 * len(chunk) + len(got) + 150
        return got

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        places = _Numbers()
        flat, chunks, whole = [], np.zeros(len(texts), np.int64), {}
        number = places.__getitem__

        def split(k: int, stops: bool) -> list[int]:
            keys = pieces_of(texts[k], self.table, stops)
            if keys is None:  # a text that the library must see whole is one chunk
                keys = [f"\0{k}\0"]
                whole[keys[0]] = texts[k]
            return [*map(number, keys)]

        for k in range(len(texts)):
            own = split(k, True)
            flat += own
            chunks[k] = len(own)
        of, edges = np.array(flat, np.int64), np.concatenate(([0], np.cumsum(chunks)))
        bare = np.array([not x[-1].isalnum() for x in places], bool)
        stops = [places[x] for x in STOPS if x in places]
        wrong = np.flatnonzero(np.isin(of[1:], stops) & bare[of[:-1]]) + 1 if stops else []
        if len(wrong):  # texts in which a stop stands after another sign are cut at white space alone
            again = {int(k): np.array(split(int(k), False), np.int64) for k in np.unique(np.searchsorted(edges, wrong, "right") - 1)}
            of = np.concatenate([again.get(k, of[edges[k] : edges[k + 1]]) for k in range(len(texts))])
            for k, own in again.items():
                chunks[k] = len(own)
            edges = np.concatenate(([0], np.cumsum(chunks)))
        words = list(places)
        known, n, ids = self.lexicon.walk([b"\xff" * (CHUNK_BYTES + 1) if x in whole else raw(x).encode() for x in words]) if words else (np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.uint32))
        odd = np.flatnonzero(~known)
        more = [self.table._plain([whole[words[k]]])[0] if words[k] in whole else self.merge(raw(words[k])) for k in odd.tolist()]
        at = np.cumsum(n) - n
        n[odd] = [len(x) // 4 for x in more]
        at[odd] = len(ids) + np.cumsum(n[odd]) - n[odd]
        pool = np.frombuffer(b"".join([ids.astype("<u4").tobytes(), *more]), "<u4")
        got = pool[ragged(at[of], n[of])]
        ends = np.concatenate(([0], np.cumsum(n[of])))
        return got, np.diff(ends[edges])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids; bytes that are no UTF-8 become replacement characters, as in the library."""
        n = self.byte_n[ids]
        data = self.byte_pool[ragged(self.byte_at[ids], n)].tobytes()
        ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, lexicon: Transducer) -> Encoder:
    """The encoder of this worker; another lexicon takes its place."""
    key = (path, lexicon.shared.uri)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, lexicon)
    return _encoders[key]


def _runs(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= TEXT_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_decode(docs: DataFrame, path: str, lexicon: Transducer, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Ids of each text and the text decoded from them, as by the tokenizers library without added specials.

    Returns ``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, with ``keep_ids``,
    ``ids`` and ``decoded``. Null and empty texts have no ids and decode to the empty text. Strings
    of the tokenizer's added tokens are found in texts; truncation and padding are off. Rows are
    independent: repeated rows and ids, null ids and other columns change nothing else.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, TEXT_BYTES):
            own, first = encoder(path, lexicon), 0
            for texts in _runs([t or "" for t in batch.column(1).to_pylist()]):
                ids, counts = own.encode(texts)
                edges = np.concatenate(([0], np.cumsum(counts)))
                raw_ids, back = ids.tobytes(), own.decode(ids, counts)
                cut = (4 * edges).tolist()
                columns = {
                    id_col: batch.column(0).slice(first, len(texts)),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(raw_ids[a:b]).hexdigest() for a, b in zip(cut, cut[1:], strict=False)]),
                    "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]),
                }
                if keep_ids:
                    columns |= {"ids": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int64))), "decoded": pa.array(back, pa.string())}
                yield pa.RecordBatch.from_pydict(columns)
                first += len(texts)

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if keep_ids else "")
    return map_arrow(docs.select(id_col, text_col), run, schema)
