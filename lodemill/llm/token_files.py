"""Token ids in files of independent zstandard frames.

A file is a run of frames, each with whole documents, then a skippable frame that lists the
documents, then the seek table of the zstandard seekable format as the last skippable frame.
Each frame carries its own checksum in the seek table (the low 32 bits of the XXH64 of its
content). Ids are little-endian unsigned 32-bit integers. A reader takes the two tables from the
file's end and decompresses only the frames of the documents asked for.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemill.llm.common import Shared, input_bytes, map_arrow

SEEKABLE_MAGIC, SKIPPABLE_MAGIC, INDEX_MAGIC = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
#: Bytes of ids after which a frame is closed, and input bytes for each file.
FRAME_BYTES, FILE_BYTES = 1 << 18, 16 << 20
END_ID = 0


class FrameWriter:
    """Writes one file; documents are added in order, frames go out as they are full."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes, self.out, self.frames, self.docs, self.held = frame_bytes, out, [], [], []
        self.size = 0
        self.zip = zstandard.ZstdCompressor(level=1, write_content_size=True)

    def add(self, key: int | None, ids: bytes) -> None:
        self.docs.append((-1 if key is None else key, key is None, len(self.frames), self.size, len(ids)))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.frame_bytes:
            self._close()

    def _close(self) -> None:
        if self.held:
            raw = b"".join(self.held)
            packed = self.zip.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.held, self.size = [], 0

    def finish(self) -> None:
        self._close()
        index = b"".join(struct.pack("<qBIII", *d) for d in self.docs)
        index = zstandard.ZstdCompressor(level=1).compress(index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE_MAGIC)
        self.out.write(b"".join([struct.pack("<II", INDEX_MAGIC, len(index)), index, struct.pack("<II", SKIPPABLE_MAGIC, len(table)), table]))


@dataclass
class Entry:
    key: int | None
    frame: int
    at: int
    size: int


class FrameReader:
    """Reads single documents of a file; ``read_at(offset, size)`` gives its bytes."""

    def __init__(self, read_at, total: int):
        self.read_at = read_at
        n, flags, magic = struct.unpack("<IBI", read_at(total - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        table_at = total - 9 - 12 * n
        self.frames, at = [], 0
        for packed, raw, check in struct.iter_unpack("<III", read_at(table_at, 12 * n)):
            self.frames.append((at, packed, raw, check))
            at += packed
        magic, size = struct.unpack("<II", read_at(at, 8))
        if magic != INDEX_MAGIC:
            raise ValueError("no list of documents after the frames")
        index = zstandard.ZstdDecompressor().decompress(read_at(at + 8, size), max_output_size=1 << 31)
        self.docs = [Entry(None if null else key, frame, start, length) for key, null, frame, start, length in struct.iter_unpack("<qBIII", index)]
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            at, packed, raw, check = self.frames[k]
            data = zstandard.ZstdDecompressor().decompress(self.read_at(at, packed), max_output_size=raw)
            if len(data) != raw or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} is damaged")
            self.last = (k, data)
        return self.last[1]

    def read(self, entry: Entry) -> bytes:
        return self.frame(entry.frame)[entry.at : entry.at + entry.size]


def open_file(path: str) -> FrameReader:
    f = open(path, "rb")  # noqa: SIM115  closed with the reader
    total = f.seek(0, 2)

    def read_at(offset: int, size: int) -> bytes:
        f.seek(offset)
        return f.read(size)

    return FrameReader(read_at, total)


#: A chunk in the general case: white space and what follows it.
_CHUNK = re.compile(r"\s*\S+|\s+")
#: The tokens that the byte-level pre-tokenizer makes of a chunk.
_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
TABLE_CHUNKS, CHUNK_CHARS = 400_000, 64
#: White space but the space and the line feed, and what only one of Python and the tokenizer calls so.
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others for code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ByteTable(dict):
    """Chunk to little-endian ids for a byte-level tokenizer; bounded: when full it is put aside for the one put aside before.

    Chunks are taken back from there as they are met, so that frequent ones are merged once.

    Its pre-tokenizer looks at nothing before a token, and no token holds white space after
    another character; so a text falls into chunks that are encoded alone, by the library's own
    merge model. In a text with single spaces and line feeds a chunk is a word, stored without
    its space, or with the line feed before it in place of the space. Other texts are cut at all
    white space (keys begin with a null), and those with white space that is not everywhere
    counted as such are encoded whole. ``safe`` checks the settings that all this relies on.
    With ``added_tokens`` the tokenizer's added tokens are found in texts, as by the library's
    default, and texts that hold one are encoded whole; else their strings are ordinary text.
    """

    def __init__(self, path: str, added_tokens: bool = False):
        from tokenizers import Tokenizer

        super().__init__()
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = not added_tokens
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()] if added_tokens else []
        self.model.no_padding()
        self.model.no_truncation()
        self.merge, self.chars = self.model.model.tokenize, _byte_chars()
        self.words: dict[str, bytes] = {}
        self.aside: dict[str, bytes] = {}
        self.met = 0  # chunks that neither table held
        probe = " a  b\n\nc 1's\td !? \n eé  x" + "".join(map(chr, range(32, 1500)))
        self.safe = True
        self.safe = self.model.normalizer is None and self._plain([probe])[0] == b"".join(map(self._chunk, _CHUNK.findall(probe)))
        self.clear()

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, token: str) -> bytes:
        got = self.words.get(token)
        if got is None:
            mapped = token.replace(" ", "Ġ") if token.isascii() and token.isprintable() else token.encode().decode("latin-1").translate(self.chars)
            got = struct.pack(f"<{len(ids := self.merge(mapped))}I", *[t.id for t in ids])
            if len(token) <= 8:
                if len(self.words) >= TABLE_CHUNKS:  # long chunks fill it without a key of their own
                    self.words = {}
                self.words[token] = got
        return got

    def _chunk(self, chunk: str) -> bytes:
        if chunk[0] == " " and chunk[1:].isalpha():
            return self._word(chunk)
        return b"".join(map(self._word, _TOKEN.findall(chunk)))

    def __missing__(self, key: str) -> bytes:
        if (got := self.aside.get(key)) is not None:
            return self._store(key, got)
        self.met += 1
        if key[0] == "\0" or key[0] == "\n":
            got = self._chunk(key.removeprefix("\0"))
        elif key[-1] in ".," and key[:-1].isalpha():
            got = self[key[:-1]] + self._word(key[-1])
        else:
            got = self._chunk(" " + key)
        return self._store(key, got) if len(key) <= CHUNK_CHARS else got

    def _store(self, key: str, got: bytes) -> bytes:
        if len(self) >= TABLE_CHUNKS:
            self.aside = dict(self)
            self.clear()
        self[key] = got
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.safe:
            return self._plain(texts)
        return [self._text(t) for t in texts]

    def _text(self, text: str) -> bytes:
        if not text:
            return b""
        if _ODD.search(text) or "\0" in text or any(a in text for a in self.added):
            return self._plain([text])[0]
        spaced = text.replace("\n", " \n")
        if spaced[0] == " " or spaced[-1] in " \n" or "  " in spaced or "\n " in spaced:
            return b"".join([self["\0" + c] for c in _CHUNK.findall(text)])
        words = spaced.split(" ")
        words[0] = "\0" + words[0]
        return b"".join([*map(self.__getitem__, words)])


_tables: dict[tuple[str, bool], ByteTable] = {}


def byte_table(path: str, added_tokens: bool = False) -> ByteTable:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, added_tokens) not in _tables:
        _tables[path, added_tokens] = ByteTable(path, added_tokens)
    return _tables[path, added_tokens]


def write_files(docs: DataFrame, tokenizer_path: str, shared: Shared, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES, added_tokens: bool = False) -> list[tuple[str, int, int]]:
    """Write the documents' ids in ascending order of ``id_col``; (name, documents, ids) of each file in that order.

    Null ids come first; rows with one id are ordered by their text's hash, equal rows in any
    order. A null text is empty and has only the end id. ``added_tokens``: see ``ByteTable``. The result holds one entry per file.
    """
    n = max(8, -(-input_bytes(docs) // file_bytes))

    def run(batches) -> Iterator[pa.RecordBatch]:
        table, ids, name = byte_table(tokenizer_path, added_tokens), 0, f"part-{TaskContext.get().partitionId():06d}.zst"
        with shared.stream(name) as sink:
            out = FrameWriter(sink)
            for batch in batches:
                for key, tokens in zip(batch.column(0).to_pylist(), table.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                    out.add(key, tokens + struct.pack("<I", END_ID))
                    ids += len(tokens) // 4 + 1
            out.finish()
        if out.docs:
            yield pa.RecordBatch.from_pydict({"name": [name], "docs": pa.array([len(out.docs)], pa.int64()), "ids": pa.array([ids], pa.int64())})

    tie = F.xxhash64(F.col(text_col))
    ordered = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"), tie.alias("x")).repartitionByRange(n, "k", "x").sortWithinPartitions("k", "x")
    done = map_arrow(ordered.select("k", "t"), run, "name string, docs long, ids long").collect()
    return sorted((r["name"], r["docs"], r["ids"]) for r in done)


def read_files(spark, files: list[tuple[str, int, int]], shared: Shared, id_col: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """Rows of the documents in the files: ``id_col``, ``start``, ``n_tokens``, ``ids_crc32`` and, with ``keep_ids``, ``ids``."""
    rows, before = [], 0
    for name, _, ids in files:
        rows.append((name, before))
        before += ids

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = open_file(shared.path(name))
                for first in range(0, len(reader.docs), 1000):
                    part = reader.docs[first : first + 1000]
                    data = [reader.read(e) for e in part]
                    sizes = np.array([len(d) // 4 for d in data], np.int64)
                    starts = start + np.cumsum(sizes) - sizes
                    start += int(sizes.sum())
                    columns = {id_col: pa.array([e.key for e in part], pa.int64()), "start": pa.array(starts), "n_tokens": pa.array(sizes), "ids_crc32": pa.array([zlib.crc32(d) for d in data], pa.int64())}
                    if keep_ids:
                        columns["ids"] = pa.array([np.frombuffer(d, "<u4").astype(np.int64) for d in data], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(columns)

    listed = spark.createDataFrame(rows, "name string, start long").repartition(max(1, len(rows)))
    return map_arrow(listed, run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if keep_ids else ""))
