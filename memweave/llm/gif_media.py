"""GIF media columns: LZW code streams, palettes, disposal, transparency, timed frames.

``encode_gif`` stores 8-bit samples without loss; ``decode_gif`` reads any GIF87a or
GIF89a stream. ``media_features`` makes the digest columns of a text column,
``frame_table`` the timed frames with colour histograms.

Defined results: a null text or payload is empty and is stored as 64 zero samples;
equal payloads give equal files; a file that is no GIF, is cut off, has no frame or declares
a canvas or frame of more than ``MOST_PIXELS`` pixels raises ``ValueError`` in ``decode_gif``
(but for the lack of frames) and gives an ``error`` row in ``frame_table``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64
#: Rows of one frame at most: a frame and its canvas stay below 1 MB.
FRAME_ROWS = 1024
DELAY_CS = 10
HIST_BITS = 2
#: More than there are codes between two clear codes of the encoder.
MOST_CODES = 4096
#: Pixels of a canvas, and of a frame, at most; a file that declares more is an error.
MOST_PIXELS = 1 << 24


def palette_332() -> np.ndarray:
    """256 colours: 3 bits of red, 3 of green, 2 of blue."""
    i = np.arange(256)
    return np.stack([(i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 255 // 3], 1).astype(np.uint8)


def lzw_codes(pixels: bytes, min_size: int = 8) -> list[np.ndarray]:
    """The codes of each run between two clear codes; a run ends where the table is full."""
    if not pixels:
        return []
    # codes are held with a free byte below, where the next sample goes
    least, most = (1 << min_size) + 2 << 8, 4096 << 8
    runs, codes, table, free = [], [], {}, least
    get, put = table.get, codes.append
    before = pixels[0] << 8
    for sample in memoryview(pixels)[1:]:
        known = get(before | sample)
        if known is not None:
            before = known
            continue
        put(before)
        if free < most:
            table[before | sample] = free
            free += 256
        else:
            runs.append(codes)
            codes, free = [], least
            put = codes.append
            table.clear()
        before = sample << 8
    put(before)
    return [np.array(x) >> 8 for x in [*runs, codes]]


def lzw_encode(pixels: bytes, min_size: int = 8) -> bytes:
    """Samples as an LZW stream with growing codes: clear code, run, clear code, run, ..., end code."""
    clear = 1 << min_size
    runs = lzw_codes(pixels, min_size)
    codes = [np.array([clear])]
    widths = [np.array([min_size + 1])]
    for k, run in enumerate(runs or [np.zeros(0, np.int64)]):
        codes += [run, np.array([clear if k + 1 < len(runs) else clear + 1])]
        widths.append(_offsets(min_size, MOST_CODES)[1][: len(run) + 1])
    return packed(np.concatenate(codes), np.concatenate(widths))


def packed(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of up to 12 bits one behind the other, lowest bits first."""
    ends = np.cumsum(widths)
    starts = ends - widths
    shifted = codes.astype(np.int64) << (starts & 7)
    size = -(-int(ends[-1]) // 8)
    # the bits of neighbours never meet, so sums are unions
    parts = [np.bincount((starts >> 3) + k, shifted >> 8 * k & 255, size + 3) for k in range(3)]
    return sum(parts).astype(np.uint8).tobytes()[:size]


def sub_blocks(data: bytes) -> bytes:
    full = len(data) // 255
    blocks = np.empty((full, 256), np.uint8)
    blocks[:, 0] = 255
    blocks[:, 1:] = np.frombuffer(data, np.uint8, full * 255).reshape(full, 255)
    rest = data[full * 255 :]
    return blocks.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode_gif(payload: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """A payload of a positive multiple of ``width`` bytes as timed frames of palette indices.

    Every second frame has a palette of its own, disposals take turns, and a sample that the
    payload lacks is the transparent one.
    """
    if not payload or len(payload) % width:
        raise ValueError(f"payload of {len(payload)} bytes is no positive multiple of {width}")
    rows = len(payload) // width
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    unused = np.flatnonzero(counts == 0)[:1].tolist()  # a sample that may stand for nothing
    colours = palette_332()
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, frame_rows), 0xF7, 0, 0), colours.tobytes()]
    for k, top in enumerate(range(0, rows, frame_rows)):
        part = payload[top * width : (top + frame_rows) * width]
        own = colours[::-1].tobytes() if k % 2 else b""
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", (1 + k % 3) << 2 | len(unused), delay_cs, *(unused or [0]), 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0x87 if own else 0) + own + b"\x08" + sub_blocks(lzw_encode(part)))
    return b"".join(out) + b"\x3b"


def code_offsets(min_size: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit offset and width of each code after a clear code: both follow from its number alone."""
    entries = np.minimum((1 << min_size) + 2 + np.maximum(np.arange(count) - 1, 0), 4096)
    widths = np.minimum(np.floor(np.log2(entries)).astype(np.int64) + 1, 12)
    return np.concatenate([[0], np.cumsum(widths)]), widths


_OFFSETS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _offsets(min_size: int, count: int):
    key = (min_size, count)
    if key not in _OFFSETS:
        _OFFSETS[key] = code_offsets(min_size, count)
    return _OFFSETS[key]


def lzw_decode(data: bytes, min_size: int, limit: int) -> np.ndarray:
    """At most ``limit`` samples of an LZW code stream.

    Codes are cut out for a whole run between two clear codes at once, and for many
    runs where the next ones have the length of the last; runs of literals alone are
    their own output, other runs copy from what they have put out.
    """
    clear, end = 1 << min_size, (1 << min_size) + 1
    if not 2 <= min_size <= 8:
        raise ValueError(f"LZW code size {min_size}")
    bits = len(data) * 8
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out: list[np.ndarray] = []
    have, at = 0, 0

    def cut(where: np.ndarray, widths: np.ndarray) -> np.ndarray:
        b = where >> 3
        return ((raw[b].astype(np.int64) | raw[b + 1].astype(np.int64) << 8 | raw[b + 2].astype(np.int64) << 16) >> (where & 7)) & ((1 << widths) - 1)

    span = 512
    while have < limit and at < bits:
        offsets, widths = _offsets(min_size, span)
        fits = int(np.searchsorted(offsets[1:], bits - at, side="right"))
        if not fits:
            break
        codes = cut(at + offsets[:fits], widths[:fits])
        stops = np.flatnonzero((codes == clear) | (codes == end))
        if not len(stops) and fits == span:
            span *= 4
            continue
        stop = int(stops[0]) if len(stops) else fits
        if stop:
            run = _expand(codes[:stop], clear, limit - have)
            out.append(run)
            have += len(run)
        if stop == fits or codes[stop] == end:
            break
        at += int(offsets[stop]) + int(widths[stop])
        period = int(offsets[stop]) + int(widths[stop])
        more = min((bits - at) // period, 4096, (limit - have) // max(stop, 1))
        if stop and more > 1:  # runs of the same length, as far as they are such
            grid = cut(at + period * np.arange(more)[:, None] + offsets[None, : stop + 1], widths[None, : stop + 1])
            same = (grid[:, stop] == clear) & (grid[:, :stop] < clear).all(1)
            good = int(np.argmin(same)) if not same.all() else more
            if good:
                out.append(grid[:good, :stop].astype(np.uint8).ravel())
                have += good * stop
                at += period * good
    return np.concatenate(out)[:limit] if out else np.zeros(0, np.uint8)


def _expand(codes: np.ndarray, clear: int, limit: int) -> np.ndarray:
    """What the codes of one run stand for.

    Entry e is what the e-th code puts out and the first sample of the next one. So a code's
    samples are found from the last to the first, for all codes at once.
    """
    if (codes < clear).all():
        return codes.astype(np.uint8)
    first = clear + 2
    if ((codes >= first) & (codes - first >= np.arange(len(codes)))).any():
        raise ValueError("LZW code beyond the table")
    # lengths and first samples
    root, size = codes.copy(), np.ones(len(codes), np.int64)
    left = np.flatnonzero(root >= first)
    while len(left):
        size[left] += 1
        root[left] = codes[root[left] - first]
        left = left[root[left] >= first]
    ends = np.cumsum(size)
    n = int(np.searchsorted(ends, limit)) + 1  # later codes are not wanted
    codes, at = codes[:n].copy(), ends[:n] - 1
    out = np.empty(int(at[-1]) + 1, np.uint8)
    whole = codes.copy()
    left = np.flatnonzero(codes >= first)
    while len(left):
        entry = codes[left] - first
        out[at[left]] = root[entry + 1]
        at[left] -= 1
        codes[left] = whole[entry]
        left = left[codes[left] >= first]
    out[at] = codes
    return out


@dataclass
class Frame:
    indices: np.ndarray  # rows x columns, as stored
    delay_cs: int
    disposal: int
    transparent: int | None
    left: int
    top: int
    palette: np.ndarray
    canvas: np.ndarray | None = None  # rows x columns x RGBA, as shown


def decode_gif(data: bytes) -> tuple[int, int, list[Frame]]:
    """Width, height and frames, each as drawn on the canvas."""
    frames = list(iter_frames(data))
    width, height = struct.unpack("<HH", data[6:10])
    return width, height, frames


def iter_frames(data: bytes) -> Iterator[Frame]:
    """Frames one by one, each drawn on the canvas by its transparency and the disposal of the one before.

    One canvas is held at a time, two where a frame is to be taken back.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, packed_, _, _ = struct.unpack("<HHBBB", data[6:13])
    if width * height > MOST_PIXELS:
        raise ValueError(f"a canvas of {width} x {height}")
    at, common = 13, np.zeros((0, 3), np.uint8)

    def colours(flags: int, at: int) -> tuple[np.ndarray, int]:
        n = 2 << (flags & 7)
        if at + 3 * n > len(data):
            raise IndexError
        return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        return b"".join(parts), at + 1

    canvas = np.zeros((height, width), np.uint32)  # four bytes of colour a pixel
    delay, disposal, transparent = 0, 0, None
    try:
        if packed_ & 0x80:
            common, at = colours(packed_, at)
        while data[at] != 0x3B:
            if data[at] == 0x21:
                label = data[at + 1]
                body, at = blocks(at + 2)
                if label == 0xF9:
                    flags, delay, index = struct.unpack("<BHB", body[:4])
                    disposal, transparent = flags >> 2 & 7, index if flags & 1 else None
            elif data[at] == 0x2C:
                left, top, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
                if w * h > MOST_PIXELS:
                    raise ValueError(f"a frame of {w} x {h}")
                at += 10
                own, at = colours(flags, at) if flags & 0x80 else (common, at)
                min_size = data[at]
                body, at = blocks(at + 1)
                flat = lzw_decode(body, min_size, w * h)
                pixels = np.zeros(w * h, np.uint8)
                pixels[: len(flat)] = flat
                pixels = pixels.reshape(h, w)
                if flags & 0x40:
                    order = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
                    pixels, stored = np.empty_like(pixels), pixels
                    pixels[order] = stored
                frame = Frame(pixels, delay, disposal, transparent, left, top, own)
                canvas = _draw(frame, canvas)
                yield frame
                delay, disposal, transparent = 0, 0, None
            else:
                raise ValueError(f"unknown block {data[at]:#x}")
    except (IndexError, struct.error) as e:
        raise ValueError("truncated GIF") from e


def _draw(f: Frame, canvas: np.ndarray) -> np.ndarray:
    """Set what the frame shows, and return the canvas that it leaves."""
    before = canvas.copy() if f.disposal == 3 else None
    h, w = min(f.indices.shape[0], canvas.shape[0] - f.top), min(f.indices.shape[1], canvas.shape[1] - f.left)
    if h > 0 and w > 0:
        part = f.indices[:h, :w]
        table = np.zeros((256, 4), np.uint8)
        table[: len(f.palette), :3] = f.palette
        table[:, 3] = 255
        drawn = table.view(np.uint32)[:, 0][part]
        spot = canvas[f.top : f.top + h, f.left : f.left + w]
        if f.transparent is None:
            spot[:] = drawn
        else:
            np.copyto(spot, drawn, where=part != f.transparent)
    f.canvas = canvas.copy().view(np.uint8).reshape(*canvas.shape, 4)
    if f.disposal == 2 and h > 0 and w > 0:
        canvas[f.top : f.top + h, f.left : f.left + w] = 0
    return canvas if before is None else before


def colour_histogram(canvas: np.ndarray, bits: int = HIST_BITS) -> np.ndarray:
    """Opaque pixels by the ``bits`` high bits of red, green and blue."""
    c = canvas.reshape(-1, 4)
    cell = np.zeros(len(c), np.int64)
    for k in range(3):
        cell = cell << bits | c[:, k] >> (8 - bits)
    solid = c[:, 3] > 0
    return np.bincount(cell if solid.all() else cell[solid], minlength=1 << 3 * bits)


def pad(raw: bytes, unit: int = WIDTH) -> bytes:
    return raw + b"\0" * (-len(raw) % unit or (0 if raw else unit))


def timed_frames(media: bytes) -> Iterator[tuple[int, int, Frame, np.ndarray]]:
    """Start and duration in milliseconds, frame and colour histogram of each frame."""
    start = 0
    for f in iter_frames(media):
        yield start, f.delay_cs * 10, f, colour_histogram(f.canvas)
        start += f.delay_cs * 10


def media_row(text: str | None) -> tuple:
    raw = (text or "").encode()
    media = encode_gif(pad(raw))
    digest, tail, size, duration = hashlib.sha256(), b"", 0, 0
    frames, total = [], np.zeros(1 << 3 * HIST_BITS, np.int64)
    for start, lasts, f, histogram in timed_frames(media):
        back = f.indices.tobytes()
        digest.update(back)
        tail, size, duration = back[-64:], size + len(back), start + lasts
        total += histogram
        frames.append({"start_ms": start, "duration_ms": lasts, "histogram": histogram})
    feature = f"frames={len(frames)};ms={duration};hist={','.join(map(str, total.tolist()))}"
    return len(raw), size, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature, frames


FRAME = pa.struct([("start_ms", pa.int64()), ("duration_ms", pa.int64()), ("histogram", pa.list_(pa.int64()))])
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames array<struct<start_ms:long,duration_ms:long,histogram:array<long>>>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("frames", pa.list_(FRAME))])


def media_features(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text as a GIF, read it back, and return digests, features and the timed frames' histograms. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), 500):
                part = b.slice(k, 500)
                rows = zip(*(media_row(t.as_py()) for t in part.column(1)), strict=True)
                yield pa.record_batch([part.column(0), *(pa.array(c, t.type) for c, t in zip(rows, list(_ARROW)[1:], strict=True))], schema=_ARROW)

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, FEATURES)


def encode_column(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, media)``: each text as GIF bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), 256):
                part = b.slice(k, 256)
                yield pa.record_batch([part.column(0), pa.array([encode_gif(pad((t or "").encode())) for t in part.column(1).to_pylist()], pa.binary())], names=["doc_id", "media"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")


FRAMES = "doc_id long, frame int, start_ms long, duration_ms long, width int, height int, disposal int, rgba binary, histogram array<long>, error string"


def frame_table(df: DataFrame, doc_id: str = "doc_id", media: str = "media") -> DataFrame:
    """Timed frames as shown, with colour histograms; an ``error`` row for what can't be read, after the frames before it."""
    names = [x.split()[0] for x in FRAMES.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string()]

    def error(key, said: str) -> tuple:
        return key, *[None] * 8, said

    def frames(key, data: bytes) -> Iterator[tuple]:
        n = 0
        try:
            for start, lasts, f, histogram in timed_frames(data):
                yield key, n, start, lasts, f.canvas.shape[1], f.canvas.shape[0], f.disposal, f.canvas.tobytes(), histogram.tolist(), None
                n += 1
        except ValueError as e:
            yield error(key, str(e))
            return
        if not n:
            yield error(key, "no frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for row in frames(key, data.as_py() or b""):
                    yield pa.record_batch([pa.array([c], t) for c, t in zip(row, types, strict=True)], names=names)

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(media).cast("binary").alias("media")).mapInArrow(run, FRAMES)
