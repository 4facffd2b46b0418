"""Perceptual hashes of pictures that the tests encode themselves."""

import struct
import zlib

import numpy as np
import pytest

from siftline.functions import likeness
from siftline.functions.parsing import image_facts
from siftline.plans import messages as M
from siftline.sources import mail


def scene(seed, h=96, w=128):
    """Smooth blobs of colour, the same picture at any size."""
    r = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    out = np.zeros((h, w, 3))
    for _ in range(12):
        cy, cx, s = r.uniform(0, 1), r.uniform(0, 1), r.uniform(0.05, 0.3)
        out += np.exp(-(((y + 0.5) / h - cy) ** 2 + ((x + 0.5) / w - cx) ** 2) / s**2)[..., None] * r.uniform(-120, 160, 3)
    return np.clip(out + 90, 0, 255).astype(np.uint8)


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(rows, unit, kinds):
    """Plain PNG filters, byte by byte."""
    out, above = b"", bytes(len(rows[0]))
    for row, kind in zip(rows, kinds):
        line = bytearray([kind])
        for i, v in enumerate(row):
            a, b, c = (row[i - unit] if i >= unit else 0), above[i], (above[i - unit] if i >= unit else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((v - [0, a, b, (a + b) // 2, near][kind]) & 255)
        out, above = out + bytes(line), row
    return out


def png(samples, colour, depth=8, palette=None, interlaced=False, kind=lambda y: y % 5):
    h, w, n = samples.shape
    steps = [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)] if interlaced else [(0, 0, 1, 1)]
    raw = b""
    for y, x, dy, dx in steps:
        part = samples[y::dy, x::dx]
        if part.size:
            bits = ((part.reshape(len(part), -1, 1).astype(int) * (257 if depth == 16 else 1)) >> np.arange(depth)[::-1]) & 1
            rows = [bytes(np.packbits(r.reshape(-1).astype(np.uint8))) for r in bits]
            raw += filtered(rows, max(1, n * depth // 8), [kind(i) for i in range(len(rows))])
    head = struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, int(interlaced))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(raw)[:40]) + chunk(b"IDAT", zlib.compress(raw)[40:]) + chunk(b"IEND", b"")


def bmp(a, depth=24, up=True, colours=b""):
    h, w = a.shape[:2]
    rows = [bytes(r[..., ::-1].reshape(-1)) if depth == 24 else bytes(r) for r in a]
    rows = [r + bytes(-len(r) % 4) for r in rows]
    body = b"".join(rows[::-1] if up else rows)
    begin = 54 + len(colours)
    return b"BM" + struct.pack("<IHHI", begin + len(body), 0, 0, begin) + struct.pack("<IiiHHIIiiII", 40, w, h if up else -h, 1, depth, 0, 0, 0, 0, 0, 0) + colours + body


def gif(points, palette, interlaced=False):
    """LZW with a growing table, so that codes get longer and the table is cleared."""
    h, w = points.shape
    if interlaced:
        points = points[[y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]]
    bits, have, out, width, table, word = 0, 0, bytearray(), 9, {bytes([i]): i for i in range(256)}, b""

    def put(code):
        nonlocal bits, have
        bits |= code << have
        have += width
        while have >= 8:
            out.append(bits & 255)
            bits >>= 8
            have -= 8

    put(256)
    for v in points.reshape(-1):
        if word + bytes([v]) in table:
            word += bytes([v])
            continue
        put(table[word])
        code = len(table) + 2
        if code < 4096:
            table[word + bytes([v])] = code
            width += code == 1 << width
        else:
            put(256)
            width, table = 9, {bytes([i]): i for i in range(256)}
        word = bytes([v])
    put(table[word])
    put(257)
    out.append(bits & 255)
    blocks = b"".join(bytes([len(out[i : i + 255])]) + out[i : i + 255] for i in range(0, len(out), 255))
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0xF7, 0, 0) + palette + b"\x21\xf9\x04\0\0\0\0\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 64 * interlaced) + b"\x08" + blocks + b"\0;"


def bits(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


GREYS = bytes(v for i in range(256) for v in (i, i, i))


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize("h,w", [(1, 1), (3, 5), (19, 33)])
def test_png_round_trip(h, w, interlaced):
    r = np.random.default_rng(h)
    rgba = r.integers(0, 256, (h, w, 4))
    want = rgba[..., :3] @ [0.299, 0.587, 0.114]
    close = lambda data, grey: np.abs(likeness.decoded(data) - grey).max() < 0.01
    assert close(png(rgba, 6, interlaced=interlaced), want) and close(png(rgba[..., :3], 2, 16, interlaced=interlaced), want)
    assert all(close(png(rgba[..., :3], 2, interlaced=interlaced, kind=lambda y, k=k: k), want) for k in range(5))
    assert close(png(rgba[..., :1], 0, interlaced=interlaced), rgba[..., 0]) and close(png(rgba[..., :2], 4, interlaced=interlaced), rgba[..., 0])
    for depth in (1, 2, 4):
        low = r.integers(0, 1 << depth, (h, w, 1))
        assert close(png(low, 0, depth, interlaced=interlaced), low[..., 0] * 255 / ((1 << depth) - 1))
        assert close(png(low, 3, depth, GREYS, interlaced), low[..., 0])


def test_bmp_and_gif_round_trip():
    a = scene(1, 41, 67)
    want = a @ [0.299, 0.587, 0.114]
    assert np.abs(likeness.decoded(bmp(a)) - want).max() < 0.01 and np.abs(likeness.decoded(bmp(a, up=False)) - want).max() < 0.01
    noise = np.random.default_rng(0).integers(0, 256, (90, 101), dtype=np.uint8)
    colours = b"".join(bytes((i, i, i, 0)) for i in range(256))
    assert np.abs(likeness.decoded(bmp(noise, 8, colours=colours)) - noise).max() < 0.01
    for points in (noise, noise // 64, np.zeros((64, 64), np.uint8)):
        assert all(np.abs(likeness.decoded(gif(points, GREYS, i)) - points).max() < 0.01 for i in (False, True))


def test_copies_are_near_and_others_are_far():
    own = [likeness.phash(png(scene(s), 2)) for s in range(12)]
    assert all(len(x) == 16 for x in own)
    for s in range(12):
        small, large = scene(s, 60, 80), scene(s, 151, 203)
        grey = np.rint(scene(s) @ [0.299, 0.587, 0.114]).astype(np.uint8)
        assert max(bits(own[s], likeness.phash(x)) for x in (bmp(small), png(large, 2), gif(grey, GREYS))) <= 8
    assert min(bits(a, b) for i, a in enumerate(own) for b in own[:i]) > 8 and np.median([bits(a, b) for i, a in enumerate(own) for b in own[:i]]) > 20


def test_what_is_no_picture():
    good = png(scene(0, 20, 20), 2)
    huge = good[:16] + struct.pack(">II", 1 << 20, 1 << 20) + good[24:]
    short = gif(np.zeros((9, 9), np.uint8), GREYS)
    for data in (b"", b"not really a picture", b"BM", b"GIF89a", good[:60], huge, short[:-12], b"\xff\xd8\xff\xe0 jpeg", bmp(scene(0, 9, 9))[:-30]):
        assert likeness.phash(data) == ""
    assert likeness.phash(png(np.full((5, 5, 1), 200), 0)) == likeness.phash(png(np.full((70, 9, 1), 200), 0))


def test_mail(spark, tmp_path):
    import base64

    assert image_facts(png(scene(3), 2))[0] == likeness.phash(png(scene(3), 2))
    part = lambda name, data: f'--B\nContent-Type: image/png; name="{name}"\nContent-Transfer-Encoding: base64\n\n{base64.encodebytes(data).decode()}'
    body = part("a.png", png(scene(3), 2)) + part("b.bmp", bmp(scene(3, 60, 80))) + part("c.png", b"no picture") + "--B--\n"
    (tmp_path / "a.eml").write_text('From: a@x.example\nContent-Type: multipart/mixed; boundary="B"\n\n' + body)
    r = M.from_signals(mail.signals(mail.read_mail(spark, str(tmp_path)))).first()
    assert len(r.image_hashes) == 3 and len(r.image_phashes) == 2 and bits(*r.image_phashes) <= 8
