import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from memweave.llm import gif_media as g


def compress(pixels, min_size=8):
    """A plain LZW encoder, growing codes up to 12 bits."""
    clear, codes, out = 1 << min_size, {}, []
    table, nxt, width = {bytes([i]): i for i in range(clear)}, clear + 2, min_size + 1
    put = lambda c: out.append((c, width))
    put(clear)
    cur = b""
    for p in bytes(pixels):
        if cur + bytes([p]) in table:
            cur += bytes([p])
            continue
        put(table[cur])
        if nxt == 4096:
            put(clear)
            table, nxt, width = {bytes([i]): i for i in range(clear)}, clear + 2, min_size + 1
        else:
            table[cur + bytes([p])] = nxt
            nxt += 1
            if nxt > 1 << width and width < 12:
                width += 1
        cur = bytes([p])
    if cur:
        put(table[cur])
        nxt += 1
        if nxt > 1 << width and width < 12:
            width += 1
    put(clear + 1)
    value, size = 0, 0
    for c, w in out:
        value |= c << size
        size += w
    return value.to_bytes(-(-size // 8), "little")


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 8), st.data())
def test_lzw_of_a_plain_encoder(bits, data):
    n = data.draw(st.integers(0, 3000))
    seed = data.draw(st.integers(0, 99))
    some = data.draw(st.integers(1, 1 << bits))
    pixels = np.random.default_rng(seed).integers(0, some, n).astype(np.uint8)
    assert g.lzw_decode(compress(pixels, bits), bits, n).tolist() == pixels.tolist()


def test_long_runs_and_a_full_table():
    rng = np.random.default_rng(1)
    for pixels in (np.zeros(200_000, np.uint8), rng.integers(0, 256, 60_000).astype(np.uint8)):
        assert (g.lzw_decode(compress(pixels), 8, len(pixels)) == pixels).all()


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=5000), st.integers(1, 9))
def test_round_trip(raw, rows):
    payload = g.pad(raw)
    _, _, frames = g.decode_gif(g.encode_gif(payload, frame_rows=rows))
    assert b"".join(f.indices.tobytes() for f in frames) == payload
    assert len(frames) == -(-len(payload) // 64 // rows)


def gif(frames, size=(4, 2), palette=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255))):
    out = b"GIF89a" + struct.pack("<HHBBB", *size, 0x81, 0, 0) + bytes(np.array(palette, np.uint8).ravel())
    for left, top, w, h, pixels, delay, disposal, clear, flags in frames:
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), delay, clear or 0) + b"\0"
        out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + b"\x02" + g.sub_blocks(compress(pixels, 2))
    return out + b"\x21\xfe\x02hi\0\x3b"


def shown(frame):
    names = {(0, 0, 0, 0): ".", (0, 0, 0, 255): "k", (255, 0, 0, 255): "r", (0, 255, 0, 255): "g", (0, 0, 255, 255): "b"}
    return "/".join("".join(names[tuple(p)] for p in row) for row in frame.canvas.tolist())


def test_disposal_and_transparency():
    data = gif([
        (0, 0, 4, 2, [1] * 8, 5, 1, None, 0),
        (1, 0, 2, 1, [2, 3], 7, 2, 2, 0),  # colour 2 is clear; then cleared to nothing
        (0, 1, 2, 1, [3, 3], 7, 3, None, 0),  # then what was there before comes back
        (3, 1, 1, 1, [2], 0, 0, None, 0),
    ])
    _, _, frames = g.decode_gif(data)
    assert [shown(f) for f in frames] == ["rrrr/rrrr", "rrbr/rrrr", "r..r/bbrr", "r..r/rrrg"]
    assert [f.delay_cs for f in frames] == [5, 7, 7, 0]


def test_interlaced_rows():
    rows = list(range(10))
    stored = [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]
    data = gif([(0, 0, 1, 10, [r % 4 for r in stored], 0, 0, None, 0x40)], size=(1, 10))
    assert g.decode_gif(data)[2][0].indices[:, 0].tolist() == [r % 4 for r in rows]


def test_what_is_no_gif():
    for bad in (b"", b"GIF89a", b"\x89PNG" * 9, g.encode_gif(b"x" * 64)[:800]):
        with pytest.raises(ValueError):
            g.decode_gif(bad)


TEXTS = [(1, "abc", "q"), (2, None, "q"), (3, "", "q"), (4, "é" * 40_000, "q"), (5, "abc", None), (None, "x" * 64, "q")]


def brute_histograms(payload, rows=1024, width=64):
    """Pixel by pixel: frames fill the canvas from its top; what stays is by turns kept, cleared or taken back."""
    colours = [(i // 32 * 255 // 7, i // 4 % 8 * 255 // 7, i % 4 * 255 // 3) for i in range(256)]
    height = min(len(payload) // width, rows)
    canvas, out = [None] * (height * width), []
    for k in range(0, -(-len(payload) // width // rows)):
        part = payload[k * rows * width : (k + 1) * rows * width]
        before = list(canvas)
        for p, x in enumerate(part):
            canvas[p] = colours[255 - x] if k % 2 else colours[x]
        counts = [0] * 64
        for c in canvas:
            if c is not None:
                counts[c[0] // 64 * 16 + c[1] // 64 * 4 + c[2] // 64] += 1
        out.append(counts)
        if k % 3 == 1:
            canvas[: len(part)] = [None] * len(part)
        elif k % 3 == 2:
            canvas = before
    return out


def test_histograms_of_many_frames():
    payload = g.pad(np.random.default_rng(2).integers(0, 250, 64 * 31).astype(np.uint8).tobytes())
    got = [h.tolist() for _, _, _, h in g.timed_frames(g.encode_gif(payload, frame_rows=4))]
    assert got == brute_histograms(payload, 4) and len(got) == 8


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 8), st.data())
def test_encoder_equals_a_plain_one(bits, data):
    n = data.draw(st.integers(0, 9000))
    some = data.draw(st.integers(1, 1 << bits))
    pixels = np.random.default_rng(data.draw(st.integers(0, 99))).integers(0, some, n).astype(np.uint8)
    stream = g.lzw_encode(pixels.tobytes(), bits)
    assert g.lzw_decode(stream, bits, n).tolist() == pixels.tolist()
    assert len(stream) <= len(compress(pixels, bits)) + 2


def test_text_is_compressed():
    payload = g.pad(b"the same words again and again " * 3000)
    assert len(g.encode_gif(payload)) < len(payload) // 4


def test_features(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, feature string")
    got = {r.doc_id: r for r in g.media_features(df).collect()}
    for i, t, _ in TEXTS:
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        want = brute_histograms(payload)
        assert [f.histogram for f in r.frames] == want and [(f.start_ms, f.duration_ms) for f in r.frames] == [(100 * k, 100) for k in range(len(want))]
        assert r.feature == f"frames={len(want)};ms={100 * len(want)};hist=" + ",".join(str(sum(x)) for x in zip(*want))
    assert got[1].media_sha256 == got[5].media_sha256 and got[2].media_sha256 == got[3].media_sha256
    assert len(got[4].frames) == 2
    assert g.media_features(df.limit(0)).count() == 0


def test_frame_table(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, media string")
    frames = g.frame_table(g.encode_column(df)).collect()
    assert len(frames) == 7 and all(r.error is None and len(r.rgba) == 4 * r.width * r.height for r in frames)
    assert sorted((r.frame, r.start_ms) for r in frames if r.doc_id == 4) == [(0, 0), (1, 100)]
    bad = g.frame_table(spark.createDataFrame([(1, b"no"), (2, None)], "doc_id long, media binary")).collect()
    assert [(r.doc_id, r.frame) for r in bad] == [(1, None), (2, None)] and all(r.error for r in bad)
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + b"\x02\x01\x04\0\x3b"
    part = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0, 0, 0) + huge[13:]
    empty = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0, 0, 0) + b"\x3b"
    cut = g.encode_gif(b"x" * 64 * 3, frame_rows=1)[:-10]
    odd = g.frame_table(spark.createDataFrame([(1, huge), (2, part), (3, empty), (4, cut)], "doc_id long, media binary")).collect()
    assert [r.error for r in odd if r.doc_id < 4] == ["a canvas of 65535 x 65535", "a frame of 65535 x 65535", "no frame"]
    assert [(r.frame, r.error) for r in odd if r.doc_id == 4] == [(0, None), (1, None), (None, "truncated GIF")]
