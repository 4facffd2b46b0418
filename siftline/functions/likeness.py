"""Perceptual hashes of images in mail, with numpy alone: for workers that lack the optional image libraries.

PNG (all colour types and depths, interlaced too), BMP (uncompressed) and the
first frame of GIF are read.  The picture in grey is averaged to 32 by 32, and
the hash says which of its 64 lowest frequencies lie over their median, so that
a copy in another size or format has nearly the same.

Defined results: other formats, broken files and pictures of more than 16.7
million points (``MAX_POINTS``, which bounds a worker's memory) have no hash;
transparency is ignored.  The libraries average by another filter, so their hashes can differ in a few bits.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAX_POINTS = 1 << 24
SIDE, LOW = 32, 8


def phash(data: bytes) -> str:
    """64 bits as 16 hexadecimal digits; empty if the picture can't be read."""
    try:
        grey = decoded(data)
    except (ValueError, IndexError, struct.error, zlib.error):
        return ""
    small = _shrunk(_shrunk(grey.astype(np.float32)).T).T.astype(np.float64)
    k, n = np.arange(SIDE)[:, None], np.arange(SIDE)[None]
    cosines = np.cos(np.pi * k * (2 * n + 1) / (2 * SIDE))
    low = (cosines @ small @ cosines.T)[:LOW, :LOW]
    low[np.abs(low) < 1e-6 * max(1.0, abs(low[0, 0]))] = 0  # what is only rounding is nothing
    return f"{int(''.join('01'[int(x)] for x in (low > np.median(low)).flat), 2):016x}"


def decoded(data: bytes) -> np.ndarray:
    """The picture in grey, rows by columns, from 0 to 255; a ``ValueError`` or the like if it can't be read."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    if data[:2] == b"BM":
        return _bmp(data)
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return _gif(data)
    raise ValueError("not a known format")


def _checked(width: int, height: int) -> None:
    if not (0 < width and 0 < height and width * height <= MAX_POINTS):
        raise ValueError("no points, or too many")


def _shrunk(a: np.ndarray) -> np.ndarray:
    """Rows averaged to ``SIDE``, each by the share of it that falls into a new row."""
    n = len(a)
    edges = np.arange(SIDE + 1) * n / SIDE
    at = np.arange(n)
    share = np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, None)
    return (share * SIDE / n).astype(np.float32) @ a


def _grey(rgb: np.ndarray) -> np.ndarray:
    return rgb[..., :3].astype(np.float32) @ np.array([0.299, 0.587, 0.114], np.float32)


def _samples(rows: np.ndarray, depth: int, count: int) -> np.ndarray:
    """The first ``count`` samples of ``depth`` bits of each row of bytes."""
    if depth == 16:
        return rows[:, 0::2][:, :count]  # the upper byte
    if depth == 8:
        return rows[:, :count]
    bits = np.unpackbits(rows, axis=1)
    bits = bits[:, : bits.shape[1] // depth * depth].reshape(len(rows), -1, depth)
    return (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[:, :count]


# PNG


def _png(data: bytes) -> np.ndarray:
    at, packed, palette, head = 8, [], b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = body
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None:
        raise ValueError("no header")
    width, height, depth, colour, _, _, interlaced = head
    _checked(width, height)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour, 0)
    if not channels or depth not in (1, 2, 4, 8, 16):
        raise ValueError("not a known colour")
    steps = [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)] if interlaced else [(0, 0, 1, 1)]
    parts = [(y, x, dy, dx, -(-(height - y) // dy), -(-(width - x) // dx)) for y, x, dy, dx in steps]
    parts = [p for p in parts if p[4] > 0 and p[5] > 0]
    line = lambda w: 1 + (w * channels * depth + 7) // 8
    total = sum(h * line(w) for *_, h, w in parts)
    raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(packed), total), np.uint8)
    if len(raw) < total:
        raise ValueError("cut off")
    out, begin = np.zeros((height, width, channels), np.uint8), 0
    for y, x, dy, dx, h, w in parts:
        rows = raw[begin : begin + h * line(w)].reshape(h, line(w))
        begin += h * line(w)
        plain = _unfiltered(rows, max(1, channels * depth // 8))
        out[y::dy, x::dx] = _samples(plain, depth, w * channels).reshape(h, w, channels)
    if colour == 3:
        colours = np.frombuffer(palette[: len(palette) // 3 * 3], np.uint8).reshape(-1, 3)
        return _grey(colours[out[..., 0]])
    if colour in (0, 4):
        return out[..., 0].astype(np.float32) * (255 / ((1 << min(depth, 8)) - 1))
    return _grey(out)


def _unfiltered(rows: np.ndarray, unit: int) -> np.ndarray:
    """Rows without their first byte, which names the filter.

    A point needs those to its left, above and above left, so all points on one
    diagonal are worked out at once.
    """
    kinds, body = rows[:, 0].astype(int), rows[:, 1:]
    if (kinds > 4).any():
        raise ValueError("not a known filter")
    if not kinds.any():
        return body
    h, width = body.shape
    w = -(-width // unit)
    given = np.zeros((h, w * unit), np.uint8)
    given[:, :width] = body
    given = given.reshape(h, w, unit).astype(np.int16)
    out = np.zeros((h + 1, w + 1, unit), np.int16)
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        by_left, by_up, by_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((by_left <= by_up) & (by_left <= by_corner), left, np.where(by_up <= by_corner, up, corner))
        guess = np.choose(kinds[y][:, None], [np.zeros_like(left), left, up, (left + up) >> 1, nearest])
        out[y + 1, x + 1] = (given[y, x] + guess) & 255
    return out[1:, 1:].reshape(h, -1)[:, :width].astype(np.uint8)


# BMP


def _bmp(data: bytes) -> np.ndarray:
    begin, size, width, height, _, depth, packed = struct.unpack("<10xIIiiHHI", data[:34])
    _checked(width, abs(height))
    if size < 40 or packed not in (0, 3) or depth not in (1, 4, 8, 24, 32):
        raise ValueError("not a known form")
    stride, h = (width * depth + 31) // 32 * 4, abs(height)
    if len(data) < begin + stride * h:
        raise ValueError("cut off")
    rows = np.frombuffer(data, np.uint8, stride * h, begin).reshape(h, stride)
    rows = rows if height < 0 else rows[::-1]
    if depth >= 24:
        return _grey(rows[:, : width * depth // 8].reshape(h, width, depth // 8)[..., 2::-1])
    colours = np.frombuffer(data[14 + size : begin], np.uint8)
    colours = colours[: len(colours) // 4 * 4].reshape(-1, 4)[:, 2::-1]
    return _grey(colours[_samples(rows, depth, width)])


# GIF


def _gif(data: bytes) -> np.ndarray:
    flags, at, colours = data[10], 13, b""
    if flags & 128:
        colours, at = data[at : at + (6 << (flags & 7))], at + (6 << (flags & 7))
    while data[at] == 0x21:  # extensions, in blocks
        at += 2
        while data[at]:
            at += 1 + data[at]
        at += 1
    if data[at] != 0x2C:
        raise ValueError("no frame")
    width, height, flags = struct.unpack("<4xHHB", data[at + 1 : at + 10])
    _checked(width, height)
    at += 10
    if flags & 128:
        colours, at = data[at : at + (6 << (flags & 7))], at + (6 << (flags & 7))
    start, at, blocks = data[at], at + 1, []
    while data[at]:
        blocks.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    points = np.frombuffer(_unpacked(b"".join(blocks), start, width * height), np.uint8).reshape(height, width)
    if flags & 64:  # rows come in four passes
        order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, height, step)]
        points = points[np.argsort(order)]
    return _grey(np.frombuffer(colours, np.uint8).reshape(-1, 3)[points])


def _unpacked(data: bytes, start: int, most: int) -> bytes:
    """The first ``most`` bytes of a stream of LZW codes of ``start + 1`` to 12 bits."""
    if not 1 <= start <= 8:
        raise ValueError("not a known width")
    clear, end = 1 << start, (1 << start) + 1
    known = [bytes([i]) for i in range(clear)] + [b"", b""]
    out, bits, have, width, last = bytearray(), 0, 0, start + 1, None
    for byte in data:
        bits |= byte << have
        have += 8
        while have >= width:
            code = bits & ((1 << width) - 1)
            bits >>= width
            have -= width
            if code == clear:
                del known[end + 1 :]
                width, last = start + 1, None
                continue
            if code == end or len(out) >= most:
                break
            if last is None:
                found = known[code]
            else:
                found = known[code] if code < len(known) else last + last[:1]
                if len(known) < 4096:
                    known.append(last + found[:1])
                    if len(known) == 1 << width and width < 12:
                        width += 1
            out += found
            last = found
    if len(out) < most:
        raise ValueError("cut off")
    return bytes(out[:most])
