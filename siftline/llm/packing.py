"""Mixture-controlled packing of tokenised documents into fixed windows.

Each source is a queue of tokens.  Windows are filled by deficit round robin:
the next ``quantum`` tokens come from the queue that lags most behind its
target share, ties to the earlier queue.  Targets are ``weights`` by source, or
the sources' shares of all tokens, so that all queues end together; with
weights, a queue that is used up leaves its share to the others.  The quantum
that begins with the k-th token of a queue of weight w is due at
(k + quantum / 2) / w.  The place of any token in that order has a closed form,
so deficits carry over windows and partitions without any task waiting for
another: a task needs only the sizes of the queues and where its own documents
start in them.

A quantum of one token holds the shares in every window to a token, and cuts
documents into as many pieces as windows; a larger one cuts them into few
pieces, and holds the shares of any run of windows to two quanta a queue.
Inside a window, the tokens of one queue stand together.

Every source, null last, is a queue, at any number of sources; the sizes of all
queues are given to every task.

Ids of the word tokeniser are remembered by word only if a check shows that the
tokenizer allows it, else whole texts are encoded.

Defined results: a null or empty text is the end token alone; repeated rows are
documents of their own; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, sliced

#: Ids are remembered for so many distinct words in each worker process, about 200 MB, unless told otherwise.
CACHE = 1_000_000
#: Words that are encoded at once; an encoding takes about a kilobyte until its ids are read.
ENCODED = 2_000
#: Rows of the (partition, queue) offsets up to which they are broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 200_000


#: What a tokenizer must treat alike whole and in parts: cases, punctuation, marks, digits, accents and other scripts.
PROBES = [
    "Plain words, in a row. And MORE of Them!", "it's well-known: 3.14 and 1,000 or $5 (five) [x] {y} a/b a_b a@b.co #tag", "Größe straße ÑANDÚ déjà vu\nnext line\n\nlast", "a  b   c . , ! ? ... end.,!?",
    "日本語 テキスト и русский текст العربية", "naïve cafe\u0301 \u00a0x\u2003y \u200bz", "UPPER lower MiXed I\u0307stanbul \u0130x", "tabs\tand\rreturns \x0b\x0c",
]


class WordTokeniser:
    """Ids of texts, as little-endian numbers of ``width`` bytes.

    Where the tokenizer gives a text the ids of its parts, cut at spaces and line
    feeds, the ids of each part are remembered; and where ASCII letters and
    punctuation after them never join, a part is the ids of its letters, then of
    the punctuation.  Both are tested on ``PROBES`` at the start, and else texts
    are encoded whole.
    """

    shared: dict[str, WordTokeniser] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size(True) <= 1 << 16 else "I"
        self.width = array(self.code).itemsize
        self.cache: dict[str, bytes] = {"": b""}
        self.most = CACHE
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content for t in added]
        self.by_word = not any(t.lstrip or t.rstrip or t.content.split() != [t.content] for t in added)
        if self.by_word:
            self.by_word = self.ids(PROBES) == self._whole(PROBES)

    @classmethod
    def at(cls, path: str) -> WordTokeniser:
        """The one of this process."""
        if path not in cls.shared:
            cls.shared[path] = cls(path)
        return cls.shared[path]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]

    def ids(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._whole(texts)
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        unseen = set().union(*parts).difference(self.cache)
        new = self._encode(unseen) if unseen else {}
        full = len(self.cache) >= self.most
        self.cache.update(new)
        out = [b"".join(map(self.cache.__getitem__, p)) for p in parts]
        if full:
            for x in new:
                del self.cache[x]
        return out

    def _encode(self, unseen: set[str]) -> dict[str, bytes]:
        joined, split, special = {}, {}, [x.lower() for x in self.special]
        begin = os.path.commonprefix(special) if special else "\0"
        need = set()
        for p in unseen:
            low = p.lower() if p.isascii() else p
            if begin in low and any(x in low for x in special):  # added tokens are found before cases are folded
                need.add(p)
                continue
            stem = low.rstrip(".,!?")
            if stem != low and stem.isascii() and stem[-1:].isalpha():
                split[p] = end = low[len(stem) :]
                need.add(end)
            else:
                stem = low
            need.add(stem)
            joined[p] = stem
        new = {}
        need = list(need.difference(self.cache))
        for i in range(0, len(need), ENCODED):
            some = need[i : i + ENCODED]
            new.update(zip(some, self._each(some)))
        find = lambda x: new[x] if x in new else self.cache[x]
        new.update([(p, find(x) + find(split[p]) if p in split else find(x)) for p, x in joined.items()])
        return new

    def _each(self, words: list[str]) -> list[bytes]:
        """Ids of each word, encoded as the parts of one list: an encoding of its own costs more than most words' ids."""
        e = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        ids = array(self.code, e.ids).tobytes()
        at = (np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(words) + 1)) * self.width).tolist()
        return [ids[a:b] for a, b in zip(at, at[1:])]


class Queues:
    """Sizes and target rates of the queues, and the quantum that is served at once."""

    def __init__(self, n: np.ndarray, rate: np.ndarray | None = None, quantum: int = 1):
        self.n = np.asarray(n, float)
        self.rate = self.n if rate is None else np.asarray(rate, float)
        self.q = quantum
        self.blocks = np.ceil(self.n / quantum)
        self.pace = self.rate / quantum  # blocks a unit of time
        with np.errstate(divide="ignore"):
            self.over = np.where(self.n > 0, self.n / self.rate, 0.0)  # when a queue is used up
        order = np.argsort(self.over, kind="stable")
        ends = self.over[order]
        left = np.cumsum(self.rate[order][::-1])[::-1]  # rate of the queues that last to each end
        self.times = np.r_[0.0, ends]
        self.upto = np.r_[0.0, np.cumsum(np.diff(self.times) * left)]

    def tokens(self, c: np.ndarray) -> np.ndarray:
        """Tokens in the first ``c`` blocks of each queue."""
        return np.minimum(c * self.q, self.n)


def _queues(n: np.ndarray | Queues) -> Queues:
    return n if isinstance(n, Queues) else Queues(n)


def first_tokens(upto: np.ndarray, n: np.ndarray | Queues) -> np.ndarray:
    """For each prefix length in ``upto``, how many tokens of each queue lie in that prefix of the order."""
    z = _queues(n)
    at = np.interp(upto, z.upto, z.times)
    c = np.floor(z.pace[None, :] * at[:, None] + 0.5).clip(0, z.blocks[None, :])
    q, rows = len(z.n), np.arange(len(upto))

    def last():
        k = np.where(c > 0, (c - 0.5) / z.pace, -np.inf)
        j = q - 1 - np.argmax(k[:, ::-1], axis=1)
        return j, k[rows, j]

    def following():
        k = np.where(c < z.blocks, (c + 0.5) / z.pace, np.inf)
        j = np.argmin(k, axis=1)
        return j, k[rows, j]

    while len(upto):
        gap = upto - z.tokens(c).sum(axis=1)  # tokens still to come
        (jl, kl), (jn, kn) = last(), following()
        wrong = (kl > kn) | ((kl == kn) & (jl > jn))
        size = np.minimum((c[rows, jn] + 1) * z.q, z.n[jn]) - np.minimum(c[rows, jn] * z.q, z.n[jn])
        down, up = (gap < 0) | wrong, ((gap >= size) & (gap > 0) & (kn < np.inf)) | (wrong & (gap >= 0))
        if not (down.any() or up.any()):
            break
        c[rows[down], jl[down]] -= 1
        c[rows[up], jn[up]] += 1
    out = z.tokens(c)
    if len(upto):  # the rest of a prefix is the begin of the block after it
        j, _ = following()
        out[rows, j] += np.maximum(upto - out.sum(axis=1), 0)
    return out.astype(np.int64)


def places(queue: np.ndarray, k: np.ndarray, n: np.ndarray | Queues) -> np.ndarray:
    """Place in the order of the k-th tokens (from 0) of their queues."""
    z = _queues(n)
    out = np.empty(len(k), np.int64)
    step = max(1, 2_000_000 // len(z.n))
    col = np.arange(len(z.n))[None, :]
    for a in range(0, len(k), step):
        s, token = queue[a : a + step, None], k[a : a + step, None]
        x = token // z.q
        key = (x + 0.5) / z.pace[s]
        c = np.ceil(z.pace[None, :] * key - 0.5).clip(0, z.blocks[None, :])
        while True:
            back = (c - 0.5) / z.pace
            over = (c > 0) & ((back > key) | ((back == key) & (col >= s)))
            ahead = (c + 0.5) / z.pace
            under = (c < z.blocks) & ((ahead < key) | ((ahead == key) & (col < s)))
            if not (over.any() or under.any()):
                break
            c += under.astype(float) - over
        c[np.arange(len(s)), s[:, 0]] = x[:, 0]
        out[a : a + step] = z.tokens(c).sum(axis=1).astype(np.int64) + (token - x * z.q)[:, 0]
    return out


def cut(queue: np.ndarray, start: np.ndarray, length: np.ndarray, n: Queues, window: int) -> tuple[np.ndarray, ...]:
    """Pieces of documents: their row, start in the document, length, window and offset in it."""
    first = places(queue, start, n) // window
    final = places(queue, start + length - 1, n) // window
    dense = final - first <= length
    reps = np.where(dense, final - first + 1, length)
    row = np.repeat(np.arange(len(queue)), reps)
    step = np.arange(len(row)) - np.repeat(np.cumsum(reps) - reps, reps)
    w = first[row] + step
    thin = ~dense[row]
    if thin.any():
        w[thin] = places(queue[row[thin]], start[row[thin]] + step[thin], n) // window
    row, w = np.unique(np.stack([row, w]), axis=1)
    seen, at = np.unique(np.concatenate([w, w + 1]), return_inverse=True)
    total = int(n.n.sum())
    low, high = at[: len(w)], at[len(w) :]
    q = queue[row]
    a, b, off = (np.empty(len(w), np.int64) for _ in range(3))
    step = max(1, 1_000_000 // len(n.n))
    order = np.argsort(low, kind="stable")
    for i in range(0, len(order), step):
        o = order[i : i + step]
        need, inv = np.unique(np.concatenate([low[o], high[o]]), return_inverse=True)
        c = first_tokens(np.minimum(seen[need] * window, total), n)
        c0, c1 = c[inv[: len(o)]], c[inv[len(o) :]]
        mine = np.arange(len(o))
        before = np.cumsum(c1 - c0, axis=1) - (c1 - c0)
        a[o], b[o], off[o] = c0[mine, q[o]], c1[mine, q[o]], before[mine, q[o]]
    lo, hi = np.maximum(a, start[row]), np.minimum(b, start[row] + length[row])
    keep = hi > lo
    row, w, lo, hi, a, off = (x[keep] for x in (row, w, lo, hi, a, off))
    return row, lo - start[row], hi - lo, w, off + lo - a


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int = 1, cache_words: int = CACHE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slice_bytes: int = 1 << 20) -> DataFrame:
    """``(doc_id, source, part, at, n, width, ids)``: ids as little-endian numbers of ``width`` bytes, ``at`` counts the tokens of the source before in the partition."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("part", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("width", pa.int32()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = WordTokeniser.at(tokenizer_path)
        t.most = cache_words
        part, upto, end = TaskContext.get().partitionId(), {}, array(t.code, [end_id]).tobytes()
        for b in sliced(batches, max_bytes=slice_bytes):
            at, n = [], []
            ids = [x + end for x in t.ids([x or "" for x in b.column("text").to_pylist()])]
            for s, x in zip(b.column("source").to_pylist(), ids):
                at.append(upto.get(s, 0))
                n.append(len(x) // t.width)
                upto[s] = at[-1] + n[-1]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pc.cast(b.column("source"), pa.string()), pa.array([part] * len(n), pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array([t.width] * len(n), pa.int32()), pa.array(ids, pa.binary())], schema=schema)

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, "doc_id long, source string, part long, at long, n long, width int, ids binary")


def pack(
    docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, with_ids: bool = True, cache_words: int = CACHE, quantum: int = 1, slice_bytes: int = 1 << 20,
    weights: dict[str | None, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])`` that fill windows of ``window`` tokens.

    Only the last window can be short.  ``ids`` are little-endian 32-bit numbers.
    Tasks read texts and ids by ``slice_bytes``.
    ``weights``: positive target weights by source; a source that is not named is an error.
    """
    spark = docs.sparkSession
    tokens = materialise(tokenise(docs, tokenizer_path, end_id, cache_words, id_col, text_col, source_col, slice_bytes), "tokens")
    sums = materialise(tokens.groupBy(F.col("source").alias("queue"), "source", "part").agg(F.sum("n").alias("n")), "queues")
    sizes = sums.groupBy("queue").agg(F.sum("n").alias("n")).orderBy(F.col("queue").asc_nulls_last()).collect()  # one row a queue
    if not sizes:
        return spark.createDataFrame([], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else ""))
    index = {r["queue"]: i for i, r in enumerate(sizes)}
    sizes_of = np.array([float(r["n"]) for r in sizes])
    if weights is not None and any(weights.get(q, 0) <= 0 for q in index):
        raise ValueError(f"no positive weight for {[q for q in index if weights.get(q, 0) <= 0]}")
    n = Queues(sizes_of, None if weights is None else np.array([float(weights[q]) for q in index]), quantum)
    ahead = F.coalesce(F.sum("n").over(W.partitionBy("queue").orderBy("part", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = materialise(sums.select(F.col("source").alias("_s"), F.col("part").alias("_p"), "queue", ahead.alias("ahead")), "starts")
    if starts.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    placed = tokens.join(starts, tokens["source"].eqNullSafe(starts["_s"]) & (tokens["part"] == starts["_p"])).select("doc_id", "queue", (F.col("ahead") + F.col("at")).alias("first"), "n", "width", "ids")
    schema = pa.schema([(x, pa.int64()) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "ids", slice_bytes):
            queue = np.array([index[x] for x in b.column("queue").to_pylist()], np.int64)
            length = b.column("n").to_numpy()
            row, start, size, w, off = cut(queue, b.column("first").to_numpy(), length, n, window)
            texts = [np.frombuffer(x, f"<u{k}").astype("<u4").tobytes() for x, k in zip(b.column("ids").to_pylist(), b.column("width").to_pylist())]
            ids = [texts[r][4 * s : 4 * (s + z)] for r, s, z in zip(row.tolist(), start.tolist(), size.tolist())]
            out = [pc.take(b.column("doc_id"), pa.array(row)), pa.array(start), pa.array(size), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(length[row]), pa.array(w), pa.array(off)]
            yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.binary())] * with_ids, schema=schema)

    return placed.mapInArrow(run, ", ".join(f"{f.name} {'binary' if f.name == 'ids' else 'long'}" for f in schema))
