"""Shared pieces of the operators: bounded Arrow batches, word hashing, shared files.

Words are hashed 64 bits wide by a polynomial over table-mixed bytes, computed for a whole block
of text at once in numpy. Arrays that every worker needs are written to the folder that the
cluster names in ``spark.checkpoint.dir`` and memory-mapped from there, so neither the driver nor
a worker holds them.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch; a batch holds one row more than the bytes allow.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Bytes of text that are hashed at once.
BLOCK = 1 << 20
#: Input bytes for each shard of a shuffle between numpy tasks.
SHARD_BYTES = 8 << 20

U64 = np.uint64
_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(0, 1 << 64, 256, dtype=U64)
_BASE = int(_SEED.integers(0, 1 << 64, dtype=U64)) | 1
ROLL = U64(int(_SEED.integers(0, 1 << 64, dtype=U64)) | 1)


def _space_table(is_space) -> bytes:
    """Translation that lower-cases A-Z and turns separators into spaces."""
    low = bytes(range(256)).lower()
    return bytes(32 if is_space(b) else b for b in low)


#: Words of any bytes but 0x20 and 0x09-0x0D.
SPACED = _space_table(lambda b: b == 32 or 9 <= b <= 13)
#: Words of ASCII letters and digits and all other code points.
ALNUM = _space_table(lambda b: b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_UNDO = U64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64)), U64(pow(0x94D049BB133111EB, -1, 1 << 64))


def unmix(x: np.ndarray) -> np.ndarray:
    """The value that ``mix`` has scrambled."""
    x = (x ^ (x >> U64(31)) ^ (x >> U64(62))) * _UNDO[1]
    x = (x ^ (x >> U64(27)) ^ (x >> U64(54))) * _UNDO[0]
    return x ^ (x >> U64(30)) ^ (x >> U64(60))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, U64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


def hash_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of a translated block, and where they start and end."""
    size = 1 << max(20, (len(block) - 1).bit_length())
    up, down = _powers(size)
    raw = np.frombuffer(block, np.uint8)
    word = np.zeros(len(raw) + 2, bool)
    np.not_equal(raw, 32, out=word[1:-1])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    total = np.zeros(len(raw) + 1, U64)
    value = np.take(_BYTE, raw)
    value *= up[: len(raw)]
    np.cumsum(value, out=total[1:])
    value = (total[ends] - total[starts]) * down[starts]
    return mix(value + (ends - starts).astype(U64) * ROLL), starts, ends


def hash_words(texts: list[bytes], table: bytes = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the bounds of each text's words in them."""
    hashes, counts = [], np.zeros(len(texts) + 1, np.int64)
    held: list[bytes] = []
    first = size = 0

    def flush(upto: int) -> None:
        if not held:
            return
        block = b" ".join(held)
        found, starts, _ = hash_block(block)
        limits = np.cumsum([len(x) + 1 for x in held])
        counts[first + 1 : upto + 1] += np.diff(np.searchsorted(starts, limits), prepend=0)
        hashes.append(found)
        held.clear()

    for k, text in enumerate(texts):
        clean = text.translate(table)
        if held and size + len(clean) > BLOCK:
            flush(k)
            size = 0
        if not held:
            first = k
        while len(clean) > BLOCK:  # a long text goes in pieces that end at a space
            cut = clean.rfind(b" ", 1, BLOCK)
            cut = cut if cut > 0 else clean.find(b" ", BLOCK)
            if cut < 0:
                break
            if held:
                flush(k)
                size, first = 0, k
            found, _, _ = hash_block(clean[:cut])
            hashes.append(found)
            counts[k + 1] += len(found)
            clean = clean[cut:]
        held.append(clean)
        size += len(clean) + 1
    flush(len(texts))
    return (np.concatenate(hashes) if hashes else np.zeros(0, U64)), np.cumsum(counts)


def roll(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every run of k neighbours."""
    if len(h) < k:
        return np.zeros(0, U64)
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out *= ROLL
        out += h[j : len(h) - k + 1 + j]
    return mix(out + U64(k))


def fold(h: np.ndarray) -> int:
    """Hash of one whole sequence, equal to roll(h, len(h))[0]."""
    return int(roll(h, len(h))[0])


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def unsigned(x) -> np.ndarray:
    return np.asarray(x, np.int64).view(U64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; a sorted first array becomes small."""
    out = io.BytesIO()
    for k, a in enumerate(arrays):
        if k == 0:
            a = np.diff(a, prepend=a.dtype.type(0))
        planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T)
        out.write(a.dtype.str.encode() + b"\n" + str(len(a)).encode() + b"\n" + planes.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, arrays = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        a = raw.index(b"\n", at)
        b = raw.index(b"\n", a + 1)
        kind, n = np.dtype(raw[at:a].decode()), int(raw[a + 1 : b])
        at = b + 1 + n * kind.itemsize
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, b + 1).reshape(kind.itemsize, n)
        x = np.empty((n, kind.itemsize), np.uint8)
        for k, plane in enumerate(planes):
            x[:, k] = plane
        x = x.reshape(-1).view(kind)
        arrays.append(np.cumsum(x, dtype=kind) if not arrays else x)
    return arrays


def order_of(keys: np.ndarray, stable: bool = False) -> np.ndarray:
    """Places of keys in ascending order, by one plain sort of their leading bits with the places; those of equal keys ascend if ``stable``."""
    bits = U64(max(1, len(keys).bit_length()))
    mask = (U64(1) << bits) - U64(1)
    order = (np.sort((keys & ~mask) | np.arange(len(keys), dtype=U64)) & mask).astype(np.int64)
    found = keys[order]
    return order if (found[1:] >= found[:-1]).all() else np.argsort(keys, kind="stable" if stable else None)  # else some agree in the leading bits alone


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and where each key stands among them."""
    order = order_of(keys)
    found = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = found[1:] != found[:-1]
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return found[new], back


def sum_by_key(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of their values."""
    if not len(keys):
        return (keys, *values)
    order = order_of(keys) if keys.dtype == U64 else np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return (keys[at], *(np.add.reduceat(v[order], at) for v in values))


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key stands in sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


# Arrow batches


def bound_batches(spark: SparkSession) -> None:
    """Keep what Spark hands to a Python worker at once small, and let workers import this package."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):  # a cluster has it installed, or gets it with --py-files
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, paths]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with small batches; a worker gives back at a task's end what the task has freed."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            _give_back()

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim:
        trim(0)


@lru_cache(1)
def _trim():
    import ctypes

    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def spans(texts: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about the given bytes."""
    first = held = 0
    for k, text in enumerate(texts):
        held += len(text) + 64
        if held >= size:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def gathered(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Larger batches of about the given bytes."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else batch
            held, n = [], 0
    held = [b for b in held if b.num_rows]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


# Sizes and shared files


@contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of what runs meanwhile go when it has run, as its results are in files of their own."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def gather(df: DataFrame) -> list[Row]:
    """The rows on the driver, which must be few."""
    with tidy(df.sparkSession):
        return df.select("*").collect()


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files under a DataFrame, or of its strings if it has none."""
    spark, files = df.sparkSession, df.inputFiles()
    if not files:
        texts = [F.octet_length(F.col(f"`{c}`")) for c, kind in df.dtypes if kind in ("string", "binary")]
        return df.agg(F.sum(sum((F.coalesce(x, F.lit(0)).cast("long") for x in texts), F.lit(0)))).first()[0] or 0
    jvm, total = spark._jvm, 0
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {os.path.dirname(x) if x.rpartition("/")[2].startswith("part-") else x for x in files}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        total += path.getFileSystem(conf).getContentSummary(path).getLength()
    return total


def shards_for(df: DataFrame, least: int = 32, each: int = SHARD_BYTES) -> int:
    """A power of two that grows with the input."""
    return max(least, 1 << max(0, (input_bytes(df) // each - 1).bit_length()))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard by the leading bits of a key: shards hold ranges of keys."""
    return (keys >> U64(64 - (shards.bit_length() - 1))).astype(np.int32) if shards > 1 else np.zeros(len(keys), np.int32)


def by_key(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """The rows of batches that are sorted by their first columns, by these."""

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    return groupby(rows(), key=lambda r: r[:keys])


@lru_cache(8)
def _placed_keys(n: int) -> list[int]:
    """For each of n partitions an int whose hash, as Spark's repartition takes it, leads there."""
    k = np.arange(n * (16 + n.bit_length()), dtype=np.uint32)
    turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    h = np.uint32(42) ^ (turn(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593))
    h = (turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)) ^ np.uint32(4)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    found, first = np.unique(h.view(np.int32).astype(np.int64) % n, return_index=True)
    out = np.arange(n) + n * 64  # one that no int was found for shares a partition
    out[found] = k[first]
    return out.tolist()


def shared_key(column: str | Column, n: int) -> Column:
    """A key by which ``repartition(n, key)`` gives each number below n a partition of its own."""
    number = F.col(column) if isinstance(column, str) else column
    return F.element_at(F.array(*map(F.lit, _placed_keys(n))), number.cast("int") + 1) if n <= 1024 else number


#: Folders of sessions that name none.
_own: dict[str, str] = {}


@dataclass(frozen=True)
class Shared:
    """A folder that the driver and all executors see."""

    uri: str

    @classmethod
    def create(cls, spark: SparkSession, name: str) -> Shared:
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top and not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        if not top:  # a session of its own on one machine, as in tests
            top = _own.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='lodemill-')}")
        if "://" not in top and not top.startswith("file:"):
            top = f"file://{top}"
        made = cls(f"{top.rstrip('/')}/lodemill-{name}-{uuid.uuid4().hex}")
        made._fs()[0].create_dir(made._fs()[1], recursive=True)
        return made

    def _fs(self):
        from pyarrow.fs import FileSystem

        uri = self.uri if not self.uri.startswith("file:/") or self.uri.startswith("file://") else "file://" + self.uri[5:]
        return FileSystem.from_uri(uri)

    def write(self, name: str, data: bytes | memoryview) -> str:
        """A whole file or none: a second attempt of a task replaces the first one's."""
        fs, top = self._fs()
        part = f"{top}/.{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as out:
            out.write(data)
        fs.move(part, f"{top}/{name}")
        return name

    @contextmanager
    def stream(self, name: str):
        """A file to append to, there as a whole when all is written."""
        fs, top = self._fs()
        part = f"{top}/.{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as out:
            yield out
        fs.move(part, f"{top}/{name}")

    def save(self, name: str, array: np.ndarray) -> None:
        out = io.BytesIO()
        np.save(out, array)
        self.write(f"{name}.npy", out.getbuffer())

    def path(self, name: str) -> str:
        """A local path of the file; from a remote store a worker fetches it while it uses the folder."""
        fs, top = self._fs()
        if fs.type_name == "local":
            return f"{top}/{name}"
        return _fetched(self.uri, name)

    def load(self, name: str) -> np.ndarray:
        """A memory-mapped array."""
        return _mapped(self.uri, name)

    def mapped(self, name: str, kind: str) -> np.ndarray:
        """A memory-mapped file of little-endian numbers."""
        return _raw(self.uri, name, kind)

    def read(self, name: str) -> bytes:
        with open(self.path(name), "rb") as f:
            return f.read()

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """The rows of a DataFrame, written and read again: later work starts from the files."""
        with tidy(df.sparkSession):
            df.write.mode("overwrite").parquet(f"{self.uri}/{name}")
        return df.sparkSession.read.parquet(f"{self.uri}/{name}")

    def drop(self, name: str) -> None:
        fs, top = self._fs()
        fs.delete_dir(f"{top}/{name}")


#: Files that a worker keeps open at most.
OPEN_FILES = 96
#: What this worker has open of one folder, by name, the least recently used first; another folder's first file closes it all.
_open: OrderedDict[tuple[str, str], np.ndarray | str] = OrderedDict()


def _close(entry: tuple[str, str]) -> None:
    held = _open.pop(entry)  # an array's file and map go with its last user
    if entry[1].startswith("copy of "):
        os.remove(held)


def _held(uri: str, name: str, make):
    if _open and next(iter(_open))[0] != uri:
        for entry in list(_open):
            _close(entry)
    entry = (uri, name)
    if entry not in _open:
        _open[entry] = made = make()
        while len(_open) > OPEN_FILES:
            _close(next(iter(_open)))
        return made
    _open.move_to_end(entry)
    return _open[entry]


def _mapped(uri: str, name: str) -> np.ndarray:
    return _held(uri, name, lambda: np.load(Shared(uri).path(f"{name}.npy"), mmap_mode="r"))


def _raw(uri: str, name: str, kind: str) -> np.ndarray:
    return _held(uri, name, lambda: np.memmap(Shared(uri).path(name), np.dtype(f"<{kind}"), "r"))


def _fetched(uri: str, name: str) -> str:
    def fetch() -> str:
        fs, top = Shared(uri)._fs()
        f = tempfile.NamedTemporaryFile(prefix="lodemill-", delete=False)
        with fs.open_input_stream(f"{top}/{name}") as source, f:
            while chunk := source.read(1 << 20):
                f.write(chunk)
        return f.name

    return _held(uri, f"copy of {name}", fetch)
