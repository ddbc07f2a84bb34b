"""SentencePiece encoding and decoding by a table of distinct chunks.

A chunk is a run of white-space markers and the characters up to the next marker. If no piece of
the model holds a marker after another character, no piece crosses from one chunk into the next,
so each distinct chunk is segmented once and its ids are joined back by position. A model with
such pieces is applied to whole texts instead.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodemill.llm.common import map_arrow

MARK = "▁"
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Chunks in a worker's table, and the longest that is kept there.
TABLE_CHUNKS, CHUNK_CHARS = 200_000, 64


def crossing_pieces(processor) -> list[str]:
    """The model's pieces that hold a marker after another character."""
    every = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    return [p for p in every if MARK in p.lstrip(MARK)]


class ChunkTable(dict):
    """Chunk to its ids, as text, for one model; bounded, and filled again when it is full.

    The usual text has single spaces between words; its chunks are stored under the word alone.
    A line feed belongs to no longer piece either, so a word after one is a chunk with no marker,
    stored with the line feed before it. All other texts are cut at the markers, and these keys
    begin with one.
    """

    def __init__(self, model_path: str):
        from sentencepiece import SentencePieceProcessor

        super().__init__()
        self.model = SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        # Chunks stand for themselves only if a text gets one marker in front and keeps all its spaces.
        kept = self.model.normalize("ｆ  ﬁ\t\n") == f"{MARK}ｆ{MARK}{MARK}ﬁ\t\n"
        self.whole = bool(crossing_pieces(self.model)) or not kept
        self.lines = not any("\n" in p and len(p) > 1 for p in pieces)
        self.new: set[str] = set()

    def _chunks(self, text: str) -> list[str]:
        if not text:
            return []
        spaced = text.replace("\n", " \n")
        if self.lines and not (spaced[0] == " " or spaced[-1] == " " or "  " in spaced or MARK in spaced):
            return spaced.split(" ")
        return _CHUNK.findall(MARK + text.replace(" ", MARK))

    def __missing__(self, chunk: str) -> None:
        self.new.add(chunk)

    def _fill(self) -> None:
        # The library puts the first marker in front itself; a lone marker is the last space of a text.
        new = list(self.new)
        found = self.model.encode([c[1:] if c[0] == MARK else c for c in new], num_threads=1)
        lone = self.model.piece_to_id(MARK)
        for chunk, ids in zip(new, found, strict=True):
            if chunk == MARK:
                ids = [lone]
            elif chunk[0] == "\n":  # no marker stands before it
                ids = ids[1:]
            self[chunk] = ",".join(map(str, ids))

    def encode(self, texts: list[str]) -> list[str]:
        """Ids of each text in decimal, joined by commas."""
        if self.whole:
            return [",".join(map(str, x)) for x in self.model.encode(texts, num_threads=1)]
        if len(self) > TABLE_CHUNKS:
            self.clear()
        parts = [self._chunks(t) for t in texts]
        got = [[*map(self.__getitem__, p)] for p in parts]
        self._fill()
        for p, ids in zip(parts, got, strict=True):
            for k, x in enumerate(ids):
                if x is None:
                    ids[k] = self[p[k]]
        for c in self.new:
            if len(c) > CHUNK_CHARS:
                del self[c]
        self.new = set()
        return [*map(",".join, got)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.model.decode(ids, num_threads=1) if ids else []


_tables: dict[str, ChunkTable] = {}


def chunk_table(model_path: str) -> ChunkTable:
    """The table of this worker for a model."""
    if model_path not in _tables:
        _tables[model_path] = ChunkTable(model_path)
    return _tables[model_path]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Ids of each text and the text decoded from them.

    Returns ``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, with ``keep_ids``,
    ``ids`` and ``decoded``. Null and empty texts have no ids and decode to the empty text. Rows
    are independent: repeated rows and ids, null ids and other columns change nothing else.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches) -> Iterator[pa.RecordBatch]:
        table = chunk_table(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            said = table.encode(texts)
            ids = [np.fromstring(x, np.int32, sep=",").tolist() if x else [] for x in said]
            back = table.decode(ids)
            columns = {
                id_col: batch.column(0),
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in said]),
                "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]),
            }
            if keep_ids:
                columns |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(back, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")
    return map_arrow(docs.select(id_col, text_col), run, schema)
