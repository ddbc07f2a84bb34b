"""GIF columns: LZW code streams, palettes, disposal and transparency, timed frames, histograms.

``decode`` reads any GIF87a or GIF89a stream: global and local palettes, interlaced images,
transparent indexes, the four disposal methods and frame delays; each frame comes as the whole
canvas (RGBA) with its time. ``encode`` stores bytes losslessly as the grey levels of frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodemill.llm.common import map_arrow

#: Pixels of a canvas or an image at most; beyond them a GIF counts as unreadable.
MOST_PIXELS = 1 << 25
#: Bytes in a unit of the payload, and the frame that holds sixteen of them.
UNIT, WIDTH, HEIGHT = 576, 96, 96
PAD = b"\xff"
#: Hundredths of a second that an encoded frame is shown.
DELAY = 4
#: Bins of each channel's histogram.
BINS = 8
MAX_CODES = 4096


@dataclass
class Frame:
    canvas: np.ndarray  # height, width, 4
    place: tuple[int, int, int, int]  # left, top, width and height of what was drawn
    start_ms: int
    duration_ms: int
    disposal: int


# LZW


def _offsets(codes: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit offset and width of each code after a clear code, as the table grows by one a code."""
    first = (1 << bits) + 2
    size = np.minimum(first + np.maximum(np.arange(codes) - 1, -1), MAX_CODES - 1)
    # A code is as wide as the largest code that the decoder has when it reads it.
    width = np.maximum(bits + 1, np.floor(np.log2(np.maximum(size, 1))).astype(np.int64) + 1)
    return np.concatenate(([0], np.cumsum(width)[:-1])), width


_layouts: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _layout(bits: int) -> tuple[np.ndarray, np.ndarray]:
    if bits not in _layouts:
        _layouts[bits] = _offsets(MAX_CODES - (1 << bits), bits)
    return _layouts[bits]


def lzw_decode(data: bytes, bits: int, wanted: int) -> bytes:
    """The indexes of a code stream whose smallest code size is ``bits``; at most ``wanted``."""
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint32)
    windows = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16  # three bytes from each byte on
    total, at = 8 * len(data), 0
    roots = [bytes([k]) for k in range(clear)] + [b"", b""]
    offsets, widths = _layout(bits)
    out: list[bytes] = []
    pieces: list[bytes] = []
    done = 0
    table, previous = list(roots), None
    while at + bits + 1 <= total and done < wanted:
        if previous is None:  # after a clear code the widths of the next codes are known
            places, width = at + offsets, widths
        else:  # the table is full: codes keep their width until it is cleared
            places, width = at + 12 * np.arange(4096), np.full(4096, 12)
        places = places[places + width[: len(places)] <= total]
        width = width[: len(places)]
        if not len(places):
            break
        codes = windows[places >> 3] >> (places & 7).astype(np.uint32) & ((1 << width) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stop[0]) if len(stop) else len(codes)
        values = iter(codes[:n].tolist())
        if previous is None and n:
            previous = table[next(values)]
            out.append(previous)
        room = MAX_CODES - len(table)
        for code in islice(values, room):  # each code adds an entry
            try:
                entry = table[code]
                table.append(previous + entry[:1])
            except IndexError:
                if code > len(table):
                    raise ValueError("code beyond the table") from None
                entry = previous + previous[:1]
                table.append(entry)
            out.append(entry)
            previous = entry
        for code in values:  # the table is full
            previous = table[code]
            out.append(previous)
        pieces.append(b"".join(out))
        done += len(pieces[-1])
        out.clear()
        if n == len(codes):
            at = int(places[-1] + width[-1])
            if len(table) < MAX_CODES:  # the stream ends within a run
                break
            continue
        at = int(places[n] + width[n])
        if codes[n] == end:
            break
        table, previous = list(roots), None
    return b"".join(pieces)[:wanted]


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """Code stream of indexes, which start and restart with a clear code and end with an end code."""
    clear, end = 1 << bits, (1 << bits) + 1
    offsets, widths = _layout(bits)
    limit = MAX_CODES - 1
    places, codes, kinds = [np.array([0])], [np.array([clear], np.uint32)], [np.array([bits + 1])]
    at = bits + 1
    rest = iter(data)
    code = next(rest, None)
    while True:
        run: list[int] = []
        table: dict[int, int] = {}
        add, known, fresh = run.append, table.get, end + 1
        last = end
        for b in rest if code is not None else ():
            pair = code << 8 | b
            longer = known(pair)
            if longer is None:
                add(code)
                table[pair] = fresh
                fresh += 1
                code = b
                if fresh == limit:  # start a new table before this one is full
                    last = clear
                    break
            else:
                code = longer
        if last == end and code is not None:
            add(code)
        add(last)
        k = len(run)
        codes.append(np.array(run, np.uint32))
        places.append(at + offsets[:k])
        kinds.append(widths[:k])
        at = int(at + offsets[k - 1] + widths[k - 1])
        if last == end:
            break
    where, value = np.concatenate(places), np.concatenate(codes)
    shifted = value << (where & 7).astype(np.uint32)
    first = where >> 3
    size = (at + 7) // 8 + 2
    packed = sum(np.bincount(first + k, shifted >> np.uint32(8 * k) & np.uint32(255), size) for k in range(3))  # bits do not overlap
    return packed.astype(np.uint8)[: size - 2].tobytes()


# Containers


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(p)]) + p for p in (data[k : k + 255] for k in range(0, len(data), 255))) + b"\0"


def encode(payload: bytes) -> bytes:
    """A GIF whose frames hold the payload's bytes as grey levels, row by row; its length is a multiple of 576."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of 576 bytes")
    each = WIDTH * HEIGHT
    height = min(HEIGHT, len(payload) // WIDTH)
    grey = bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, height, 0xF7, 0, 0), grey]
    for first in range(0, len(payload), each):
        part = payload[first : first + each]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, DELAY, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08")
        out.append(_blocks(lzw_encode(part)))
    return b"".join(out) + b"\x3b"


def _interlaced(rows: np.ndarray) -> np.ndarray:
    order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, len(rows), step)]
    out = np.empty_like(rows)
    out[order] = rows
    return out


def _bounded(width: int, height: int) -> None:
    """Refuse a size that only claims pixels: a few bytes may say 65,535 by 65,535."""
    if width * height > MOST_PIXELS:
        raise ValueError(f"{width} x {height} pixels are more than {MOST_PIXELS}")


def images(data: bytes) -> Iterator[tuple[tuple[int, int, int, int], np.ndarray, np.ndarray, int | None, int, int]]:
    """The single images: place, indexes, palette, transparent index, disposal, delay in hundredths."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    _bounded(*struct.unpack_from("<HH", data, 6))
    flags, at = data[10], 13
    common = None
    if flags & 0x80:
        n = 3 << (flags & 7) + 1
        common, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
    transparent, disposal, delay = None, 0, 0

    def body(at: int) -> tuple[bytes, int]:
        parts = []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            control, at = body(at + 2)
            if label == 0xF9 and len(control) >= 4:
                disposal, delay = control[0] >> 2 & 7, control[1] | control[2] << 8
                transparent = control[3] if control[0] & 1 else None
        elif data[at] == 0x2C:
            left, top, width, height, flags = struct.unpack_from("<HHHHB", data, at + 1)
            _bounded(width, height)
            at, palette = at + 10, common
            if flags & 0x80:
                n = 3 << (flags & 7) + 1
                palette, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
            if palette is None:
                raise ValueError("an image without a palette")
            bits = data[at]
            codes, at = body(at + 1)
            found = lzw_decode(codes, bits, width * height)
            rows = np.frombuffer(found.ljust(width * height, b"\0"), np.uint8).reshape(height, width)
            yield (left, top, width, height), _interlaced(rows) if flags & 0x40 else rows, palette, transparent, disposal, delay
            transparent, disposal, delay = None, 0, 0
        else:
            raise ValueError(f"unknown block {data[at]:#x}")


def decode(data: bytes) -> Iterator[Frame]:
    """The timed frames, each as the whole canvas after it is drawn."""
    width, height = struct.unpack_from("<HH", data, 6)
    _bounded(width, height)
    canvas = np.zeros((height, width, 4), np.uint8)
    time = 0
    for (left, top, w, h), rows, palette, transparent, disposal, delay in images(data):
        before = canvas.copy() if disposal == 3 else None
        colours = np.zeros((256, 4), np.uint8)
        colours[: len(palette), :3] = palette
        colours[:, 3] = 255
        area = canvas[top : top + h, left : left + w]
        drawn = colours[rows[: area.shape[0], : area.shape[1]]]
        if transparent is None:
            area[:] = drawn
        else:
            shown = rows[: area.shape[0], : area.shape[1]] != transparent
            area[shown] = drawn[shown]
        yield Frame(canvas.copy(), (left, top, w, h), time, 10 * delay, disposal)
        time += 10 * delay
        if disposal == 2:
            area[:] = 0
        elif disposal == 3:
            canvas = before


def histogram(frame: Frame) -> list[int]:
    """Counts of the visible pixels in each channel's bins: red, green, blue."""
    seen = frame.canvas[frame.canvas[..., 3] > 0]
    return [int(n) for c in range(3) for n in np.bincount(seen[:, c] >> 5, minlength=BINS)]


def payload_of(data: bytes) -> tuple[bytes, list[tuple[int, int, list[int]]]]:
    """The stored bytes, read back from the frames, and each frame's start, duration and histogram."""
    parts, timed = [], []
    for frame in decode(data):
        left, top, w, h = frame.place
        parts.append(frame.canvas[top : top + h, left : left + w, 0].tobytes())
        timed.append((frame.start_ms, frame.duration_ms, histogram(frame)))
    return b"".join(parts), timed


def frames_column(media: DataFrame, id_col: str, gif_col: str) -> DataFrame:
    """Timed frames of a column of GIFs: one row a frame with its times, size, disposal, pixels and colour histogram.

    A null or unreadable GIF gives one row with a null frame number and, for the latter, the error.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[dict] = []
                try:
                    for k, f in enumerate(decode(data) if data is not None else ()):
                        h, w, _ = f.canvas.shape
                        rows.append({"frame": k, "start_ms": f.start_ms, "duration_ms": f.duration_ms, "width": w, "height": h, "disposal": f.disposal, "rgba": f.canvas.tobytes(), "histogram": histogram(f), "error": None})
                except (ValueError, IndexError, struct.error) as e:
                    rows = [{"error": str(e)}]
                yield pa.RecordBatch.from_pylist([{id_col: key, **r} for r in rows or [{}]], schema=shape)

    kind = media.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    shape = pa.schema([(id_col, to_arrow_type(kind)), ("frame", pa.int32()), ("start_ms", pa.int64()), ("duration_ms", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("disposal", pa.int32()), ("rgba", pa.binary()), ("histogram", pa.list_(pa.int64())), ("error", pa.string())])
    return map_arrow(media.select(id_col, gif_col), run, f"`{id_col}` {kind.simpleString()}, frame int, start_ms long, duration_ms long, width int, height int, disposal int, rgba binary, histogram array<long>, error string")


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_gif: bool = True) -> DataFrame:
    """Store each whole text as a GIF and read it back.

    Returns ``id_col``, ``n_bytes``, ``payload_bytes``, ``payload_sha256`` and ``tail_crc32`` (read
    back from the GIF), ``media_bytes``, ``media_sha256``, ``feature`` (frames, milliseconds and the
    grey histogram over all frames) and, with ``keep_gif``, ``gif``. A null text is empty; its
    payload is one unit of padding. Equal texts give equal values.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def one(text: bytes) -> tuple:
        gif = encode(text + PAD * (-len(text) % UNIT if text else UNIT))
        back, timed = payload_of(gif)
        grey = [sum(t[2][k] for t in timed) for k in range(BINS)]
        feature = f"frames={len(timed)};ms={sum(t[1] for t in timed)};grey={','.join(map(str, grey))}"
        return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(gif), hashlib.sha256(gif).hexdigest(), feature, gif

    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "gif")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            for first in range(0, len(texts), 200):
                found = [one(t) for t in texts[first : first + 200]]
                columns = {id_col: batch.column(0).slice(first, len(found))}
                for k, (name, t) in enumerate(zip(names, kinds, strict=True)):
                    if name != "gif" or keep_gif:
                        columns[name] = pa.array([f[k] for f in found], t)
                yield pa.RecordBatch.from_pydict(columns)

    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + (", gif binary" if keep_gif else ""))
