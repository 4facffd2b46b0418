"""Substring deduplication over words by seed and extend.

Seeds are winnowed anchors of ``gram`` words, chosen so that every window of
``window`` words holds one, at a place that its words alone decide.  The
windows that share an occurrence of a seed make a stretch of text around it.
Documents meet on seeds that occur twice or more:

* Equal stretches are combined first, by seed and a 128-bit hash of their
  words, with a minimum over documents; so of copies, however many they are,
  one is left, and all others are repeats as a whole.
* Different stretches of one seed are joined on it, and each is extended from
  the seed to the left and to the right, word by word, along every earlier one.
  An extension of ``window`` words or more is a maximal repeat, and the windows
  in it occur earlier.
* A seed with more than ``hot`` different stretches, such as that of a passage
  in ever new surroundings, is not joined in pairs: its windows are dealt by a
  128-bit hash of their words, with a minimum over documents that is combined
  before the shuffle.

Each document then learns which stretches it has first, and removes the words
of all other windows whose seed is repeated.

Defined results: a null text has no words; documents are ordered by id, null
first, and rows with one id by a hash of the text; a row that repeats id and
text is the same document, and gets the same result, not a copy; texts of any
length are read whole; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, mix64, raw_texts, sliced, with_rid
from .winnow import BASE, anchors, passes, repeated_filter, rolled, stretches

#: Bytes of stretches that a task extends at once.
BLOCK = 1 << 20


def same(*columns: np.ndarray) -> np.ndarray:
    """Numbers from 0 that rows share if they agree on all columns."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def ranges(size: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n in ``size``, one after the other."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


class _Seeds:
    """The stretches of a batch: runs of windows that share an occurrence of a seed."""

    def __init__(self, batch: pa.RecordBatch, window: int, gram: int):
        self.window = window
        self.words = [t.split() for t in raw_texts(batch)]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(self.sizes)
        flat = [w for ws in self.words for w in ws]
        h = xxhash.xxh64_intdigest
        hashes = np.fromiter(map(h, flat), np.uint64, len(flat))
        starts = stretches(self.ends, self.sizes, window)
        self.seed = np.zeros(0, np.uint64)
        self.first = self.n = self.left = np.zeros(0, np.int64)
        self._flat, self._text, self._at = flat, b"", np.zeros(1, np.int64)
        if len(starts):
            grams = rolled(hashes, gram)
            at = anchors(grams, starts, window, gram)
            turn = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (np.diff(starts) > 1)])
            self.first, self.n = starts[turn], np.diff(np.r_[turn, len(at)])  # first windows, and their numbers
            self.seed, self.left = grams[at[turn]], at[turn] - starts[turn]  # hash of the seed, and how many words stand before it

    def document(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, word, side="right")

    def texts(self, first: np.ndarray, windows: np.ndarray) -> list[bytes]:
        """The words of each stretch of so many windows, joined by a space."""
        if not self._text:
            self._text = b" ".join(self._flat)
            self._at = np.r_[0, np.cumsum(np.fromiter(map(len, self._flat), np.int64, len(self._flat)) + 1)]
        a, z = self._at[first], self._at[first + windows + (self.window - 1)] - 1
        return [self._text[x:y] for x, y in zip(a.tolist(), z.tolist())]

    def digests(self, first: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each stretch."""
        raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.texts(first, windows))), np.int64).reshape(-1, 2)
        return np.ascontiguousarray(raw[:, 0]), np.ascontiguousarray(raw[:, 1])

    def spread(self, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of the runs, and the run of each."""
        n = self.n[run]
        return np.repeat(self.first[run], n) + ranges(n), np.repeat(run, n)


def extended(rows: list[tuple], window: int, gram: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Windows that occur earlier in a different stretch of the same seed: ``(rid, d1, d2, first, number)`` of runs of them.

    ``rows``: ``(seed, rid, place of the seed, words before it, d1, d2, words)``, whole seeds.
    """
    rows.sort(key=lambda r: r[:3])
    number: dict[bytes, int] = {}
    reach = window - gram
    split = [r[6].split(b" ") for r in rows]
    ids = np.fromiter((number.setdefault(w, len(number)) for ws in split for w in ws), np.int64)
    size = np.array([len(ws) for ws in split], np.int64)
    before = np.array([r[3] for r in rows], np.int64)
    pad = -1 - np.arange(len(rows))[:, None]  # agrees with no other row's
    side = np.broadcast_to(pad, (len(rows), window + reach)).copy()  # a window's words and what can stand before: the seed begins at ``reach``
    side[np.repeat(np.arange(len(rows)), size), ranges(size) + np.repeat(reach - before, size)] = ids
    seed = np.array([r[0] for r in rows], np.int64)
    edge = np.zeros((len(rows), reach + 2), np.int32)
    for d in range(1, len(rows)):
        at = np.flatnonzero(seed[d:] == seed[:-d]) + d
        if not len(at):
            break
        equal = side[at] == side[at - d]
        left = np.cumprod(equal[:, :reach][:, ::-1], axis=1).sum(axis=1)
        right = np.cumprod(equal[:, reach:], axis=1).sum(axis=1)
        first, last = before[at] - left, before[at] + right - window
        ok = (right >= gram) & (last >= first)
        np.add.at(edge, (at[ok], first[ok]), 1)
        np.add.at(edge, (at[ok], last[ok] + 1), -1)
    earlier = np.cumsum(edge, axis=1) > 0
    turn = np.diff(np.pad(earlier.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    for i in np.flatnonzero(earlier.any(axis=1)).tolist():
        for a, z in zip(np.flatnonzero(turn[i] == 1).tolist(), np.flatnonzero(turn[i] == -1).tolist()):
            yield rows[i][1], rows[i][4], rows[i][5], a, z - a


class _Plan:
    """What every task is given: which seeds are repeated, shared by different stretches, and hot; 8 MB each."""

    def __init__(self, repeated: np.ndarray, shared: np.ndarray, hot: np.ndarray):
        self.repeated, self.shared, self.hot = repeated, shared, hot


def _bit(seed: np.ndarray, d1: np.ndarray, rid: np.ndarray) -> np.ndarray:
    return mix64(d1.view(np.uint64) ^ mix64(seed + rid.view(np.uint64) * BASE))


def _least(rid: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Of rows that agree on the keys, the one with the smallest ``rid``, the first of equal ones."""
    group = same(*keys)
    order = np.lexsort((rid, group))
    return order[np.r_[True, group[order[1:]] != group[order[:-1]]]] if len(order) else order


def known_windows(d: DataFrame, window: int, gram: int, hot: int) -> tuple[DataFrame, object]:
    """``(rid, known)``: what each document of ``d(rid, text)`` has to know; and the plan, as a broadcast.

    ``known`` are structs ``(d1, d2, first, n)``: a stretch that the document has
    first (``n`` 0), windows of such a stretch that occur earlier all the same
    (``n`` of them from ``first``), and a window of a hot seed that it has first
    (``first`` -1).
    """
    spark = d.sparkSession
    pair = pa.schema([("anchor", pa.int64()), ("n", pa.int64())])
    entry = pa.schema([("anchor", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("rid", pa.int64())])

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            a, n = np.unique(_Seeds(b, window, gram).seed, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n)], schema=pair)

    repeated = repeated_filter(d.select("text").mapInArrow(seeds, "anchor long, n long"))[0]
    repeated_b = spark.sparkContext.broadcast(repeated)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            s = _Seeds(b, window, gram)
            run = np.flatnonzero(passes(repeated_b.value, s.seed))
            d1, d2 = s.digests(s.first[run], s.n[run])
            rid = b.column("rid").to_numpy()[s.document(s.first[run])]
            keep = _least(rid, s.seed[run], d1, d2)
            yield pa.RecordBatch.from_arrays([pa.array(s.seed[run][keep].view(np.int64)), pa.array(d1[keep]), pa.array(d2[keep]), pa.array(rid[keep])], schema=entry)

    firsts = d.select("rid", "text").mapInArrow(entries, "anchor long, d1 long, d2 long, rid long").groupBy("anchor", "d1", "d2").agg(F.min("rid").alias("rid"))
    firsts = materialise(firsts, "stretches")
    plan = _Plan(repeated, *repeated_filter(firsts.select("anchor", F.lit(1).alias("n")), over=(1, hot)))
    plan_b = spark.sparkContext.broadcast(plan)
    repeated_b.destroy()

    def to_extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seed, d1, rid = b.column("anchor").to_numpy().view(np.uint64), b.column("d1").to_numpy(), b.column("rid").to_numpy()
            some = passes(plan_b.value.shared, seed) & ~passes(plan_b.value.hot, seed)
            got = _bit(seed[some], d1[some], rid[some])
            yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(np.full(len(got), 2))], schema=pair)

    sender = spark.sparkContext.broadcast(repeated_filter(firsts.mapInArrow(to_extend, "anchor long, n long"))[0])
    sent = pa.schema([("seed", pa.int64()), ("rid", pa.int64()), ("place", pa.int64()), ("before", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("words", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            s = _Seeds(b, window, gram)
            p = plan_b.value
            run = np.flatnonzero(passes(p.shared, s.seed) & passes(p.repeated, s.seed) & ~passes(p.hot, s.seed))
            d1, d2 = s.digests(s.first[run], s.n[run])
            doc = s.document(s.first[run])
            rid = b.column("rid").to_numpy()[doc]
            mine = np.flatnonzero(passes(sender.value, _bit(s.seed[run], d1, rid)))
            mine = mine[_least(s.first[run][mine], rid[mine], d1[mine], d2[mine])]  # where the stretch comes first in the document
            run, d1, d2, doc, rid = run[mine], d1[mine], d2[mine], doc[mine], rid[mine]
            place = s.first[run] + s.left[run] - (s.ends - s.sizes)[doc]
            columns = [pa.array(x) for x in (s.seed[run].view(np.int64), rid, place, s.left[run], d1, d2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(s.texts(s.first[run], s.n[run]), pa.binary())], schema=sent)

    kinds = "rid long, d1 long, d2 long, first int, n int"
    out = pa.schema([("rid", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("first", pa.int32()), ("n", pa.int32())])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, last = 0, None

        def flush() -> pa.RecordBatch:
            got = list(extended(rows, window, gram))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], f.type) for i, f in enumerate(out)], schema=out)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held > BLOCK and row[0] != last:
                    yield flush()
                    held = 0
                rows.append(row)
                held, last = held + len(row[6]), row[0]
        if rows:
            yield flush()

    met = d.select("rid", "text").mapInArrow(send, "seed long, rid long, place long, before long, d1 long, d2 long, words binary")
    met = met.repartition("seed").sortWithinPartitions("seed").mapInArrow(extend, kinds)

    def hot_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            s = _Seeds(b, window, gram)
            first, run = s.spread(np.flatnonzero(passes(plan_b.value.hot, s.seed) & passes(plan_b.value.repeated, s.seed)))
            d1, d2 = s.digests(first, np.ones(len(first), np.int64))
            rid = b.column("rid").to_numpy()[s.document(first)]
            keep = _least(rid, d1, d2)
            yield pa.RecordBatch.from_arrays([pa.array(d1[keep]), pa.array(d2[keep]), pa.array(rid[keep])], schema=pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("rid", pa.int64())]))

    known = firsts.select("rid", "d1", "d2", F.lit(0).alias("first"), F.lit(0).alias("n")).unionByName(met)
    if plan.hot.any():
        of_hot = d.select("rid", "text").mapInArrow(hot_windows, "d1 long, d2 long, rid long").groupBy("d1", "d2").agg(F.min("rid").alias("rid"))
        known = known.unionByName(of_hot.select("rid", "d1", "d2", F.lit(-1).alias("first"), F.lit(0).alias("n")))
    return known.groupBy("rid").agg(F.collect_list(F.struct("d1", "d2", "first", "n")).alias("known")), plan_b


def _earlier(s: _Seeds, plan: _Plan, known: pa.Array) -> np.ndarray:
    """For each word of a batch, by how much the number of windows to remove that cover it differs from the word before."""
    edge = np.zeros(len(s._flat) + s.window + 1, np.int32)
    run = np.flatnonzero(passes(plan.repeated, s.seed))
    is_hot = passes(plan.hot, s.seed[run])
    cold = run[~is_hot]
    h_first, h_run = s.spread(run[is_hot])
    first, n = np.r_[s.first[cold], h_first], np.r_[s.n[cold], np.ones(len(h_first), np.int64)]
    d1, d2 = s.digests(first, n)
    tag = np.r_[np.zeros(len(cold), np.int64), np.full(len(h_first), -1)]
    flat, size = known.flatten(), pc.fill_null(pc.list_value_length(known), 0).to_numpy(zero_copy_only=False)
    k1, k2, kf, kn = (flat.field(i).to_numpy() for i in range(4))
    of = np.repeat(np.arange(len(known)), size)
    group = same(np.r_[d1, k1], np.r_[d2, k2], np.r_[tag, np.minimum(kf, 0)], np.r_[s.document(first), of])
    mine, told = group[: len(first)], group[len(first) :]
    count = int(group.max(initial=-1)) + 1
    own = np.zeros(count, bool)
    own[told[kn == 0]] = True
    at = np.full(count, -1)
    order = np.argsort(first, kind="stable")[::-1]
    at[mine[order]] = order  # the first of a document's equal ones
    gone = np.ones(len(first), bool)
    gone[at[own & (at >= 0)]] = False
    width = n[gone] + (s.window - 1)
    np.add.at(edge, first[gone], 1)
    np.add.at(edge, first[gone] + width, -1)
    part = np.flatnonzero(kn > 0)
    part = part[at[told[part]] >= 0]
    a = first[at[told[part]]] + kf[part]
    np.add.at(edge, a, 1)
    np.add.at(edge, a + kn[part] + (s.window - 1), -1)
    return edge[: len(s._flat)]


def deduplicate(docs: DataFrame, window: int = 20, gram: int = 8, hot: int = 64, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, carry: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, spans[, kept][, row])``; ``row``: all columns but the text.

    ``spans``: runs ``(start, end)`` of removed words; ``kept``: the other words
    joined by one space, ``kept_sha256`` its hash.
    """
    d = with_rid(docs, id_col, text_col, carry)
    known, plan = known_windows(d, window, gram, hot)
    joined = d.join(known.withColumnRenamed("rid", "_rid"), F.col("rid") == F.col("_rid"), "left").select("doc_id", "text", "known", *(["row"] if carry else []))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"] + ["kept"] * with_text + ["row"] * carry

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            s = _Seeds(b, window, gram)
            covered = np.cumsum(_earlier(s, plan.value, b.column("known"))) > 0
            removed, spans, kept, sha = [], [], [], []
            for words, a, z in zip(s.words, (s.ends - s.sizes).tolist(), s.ends.tolist()):
                turn = np.diff(np.r_[0, covered[a:z].astype(np.int8), 0])
                runs = [{"start": x, "end": y} for x, y in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist())]
                rest, at = [], 0
                for r in runs:
                    rest += words[at : r["start"]]
                    at = r["end"]
                out = b" ".join(rest + words[at:] if runs else words)
                removed.append(sum(r["end"] - r["start"] for r in runs))
                spans.append(runs)
                sha.append(hashlib.sha256(out).hexdigest())
                if with_text:
                    kept.append(out.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s.sizes), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, kind)] + [pa.array(kept, pa.string())] * with_text + ([b.column("row")] if carry else []), names=names)

    out = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: long, end: long>>" + ", kept string" * with_text)
    return joined.mapInArrow(remove, out.add(joined.schema["row"]) if carry else out)


def clean(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the text replaced by the words kept, where some are removed; rows of which nothing is left are dropped."""
    got = deduplicate(docs, text_col=text_col, carry=True, **options)
    whole = (F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))
    return got.where(whole).select(*[(F.col("kept") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


#: The same removal in DuckDB SQL, with every window compared.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1)::BIGINT)) AS s FROM d),
h AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 19], ' ')) AS h FROM p),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM h),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM r WHERE k > 1),
g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
x AS (SELECT d.doc_id, w, unnest(range(1, len(w)::BIGINT + 1)) AS i FROM d),
k AS (SELECT x.doc_id, string_agg(x.w[x.i], ' ' ORDER BY x.i) AS kept FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.i = c.i WHERE c.i IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(len(g.gone), 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""
