"""Winnowed anchors of symbol sequences, and a bounded filter of repeated ones.

Of every stretch of ``length`` symbols the ``gram``-symbol piece with the
smallest upper half of its hash (the leftmost of equals) is the stretch's anchor.  The choice
depends on the stretch alone, so equal stretches, wherever they are, have equal
anchors at the same place in them.  A stretch can only occur twice if its
anchor does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64

BASE = np.uint64(0x9E3779B97F4A7C15)


def rolled(h: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of every run of ``length`` symbols with hashes ``h``."""
    if len(h) < length:
        return np.zeros(0, np.uint64)
    acc, acc_len, p, p_len, c = None, 0, h, 1, BASE
    while True:
        if length & p_len:
            if acc is None:
                acc = p
            else:
                n = min(len(acc), len(p) - acc_len)
                acc = acc[:n] * c + p[acc_len : acc_len + n]
            acc_len += p_len
        if acc_len == length:
            return mix64(acc[: len(h) - length + 1])
        p = p[:-p_len] * c + p[p_len:]
        p_len *= 2
        c = np.uint64(int(c) * int(c) % (1 << 64))


def stretches(ends: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Starts of all runs of ``length`` symbols that lie inside one document; documents lie end to end."""
    n = np.maximum(sizes - length + 1, 0)
    return np.repeat(ends - sizes, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def anchors(grams: np.ndarray, starts: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Position of the anchor of each stretch: pieces compare by the upper half of their hash, then by place."""
    low = np.uint64(0xFFFFFFFF)
    if len(grams) > int(low):
        raise ValueError("positions need more than 32 bits")
    span, width = length - gram + 1, 1
    value = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    while width < span:
        step = min(width, span - width)
        value = np.minimum(value[:-step], value[step:])
        width += step
    return (value[starts] & low).astype(np.int64)


def repeated_filter(anchor_counts: DataFrame, max_bits: int = 26, over: tuple[int, ...] = (1,)) -> list[np.ndarray]:
    """For each number in ``over``, a bitmap of the anchors in ``anchor_counts(anchor, n)`` that occur more often.

    ``anchor_counts`` may hold an anchor several times.  A bitmap has
    ``2 ** max_bits`` bits (8 MB), which bounds what is gathered and broadcast.
    As its anchors approach that number it lets more of the others pass;
    nothing that is repeated is ever lost, and what passes is judged exactly later.
    """
    counts = anchor_counts.groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > min(over))
    b = F.col("anchor").bitwiseAND((1 << max_bits) - 1)
    places = counts.select(F.shiftright(b, 6).alias("w"), F.expr("shiftleft(1L, cast(anchor & 63 as int))").alias("v"), "n")
    rows = places.groupBy("w").agg(*[F.coalesce(F.bit_or(F.when(F.col("n") > k, F.col("v"))), F.lit(0)).alias(f"v{i}") for i, k in enumerate(over)]).toArrow()
    out = []
    for i in range(len(over)):
        bitmap = np.zeros(1 << (max_bits - 6), np.int64)
        bitmap[rows.column("w").to_numpy()] = rows.column(f"v{i}").to_numpy()
        out.append(bitmap.view(np.uint8))
    return out


PLACES = pa.schema([("part", pa.int32()), ("places", pa.binary())])


def dealt_places(anchor: np.ndarray) -> pa.RecordBatch:
    """40 bits of each anchor, dealt by the lowest 8 into ``(part, places)``: the other 32, sorted, each twice at most."""
    key = np.sort((anchor & np.uint64(0xFF)) << np.uint64(32) | (anchor >> np.uint64(8)) & np.uint64(0xFFFFFFFF))
    key = key[np.r_[np.ones(min(2, len(key)), bool), key[2:] != key[:-2]]]
    ends = 4 * np.searchsorted(key, np.arange(257, dtype=np.uint64) << np.uint64(32))
    places = pa.Array.from_buffers(pa.binary(), 256, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(key.astype(np.uint32))])
    return pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), places], schema=PLACES)


def repeated_bitmap(dealt: DataFrame, min_bits: int = 26, max_bits: int = 29, room: int = 8) -> np.ndarray:
    """A bitmap of the anchors that occur twice or more in rows of :func:`dealt_places`.

    Its size follows what repeats, ``room`` bits for each, from ``2 ** min_bits``
    (8 MB) to ``2 ** max_bits`` bits (64 MB), so that others pass as rarely on
    large inputs.  Four bytes an anchor are moved, and a task holds one part.
    """

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        last = None

        def flush() -> pa.RecordBatch:
            f = np.sort(np.frombuffer(b"".join(held), np.uint32))
            held.clear()
            f = np.unique(f[1:][f[1:] == f[:-1]])
            bits = min(max(min_bits, 8 + (room * len(f)).bit_length()), max_bits)
            on = np.zeros(1 << (bits - 8), bool)
            on[f & np.uint32(len(on) - 1)] = True
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())], schema=PLACES)

        for b in batches:
            for part, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if held and part != last:
                    yield flush()
                last = part
                held.append(places)
        if held:
            yield flush()

    found = dealt.repartition("part").sortWithinPartitions("part").mapInArrow(repeats, "part int, places binary").toArrow().to_pydict()
    size = max([len(x) for x in found["places"]], default=1 << (min_bits - 11))
    out = np.zeros((8 * size, 32), np.uint8)
    for part, bits in zip(found["part"], found["places"]):
        on = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
        out[:, part >> 3] |= np.tile(on, 8 * size // len(on)) << np.uint8(part & 7)
    return out.reshape(-1)


def passes(bitmap: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    at = anchor & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
