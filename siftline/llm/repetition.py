"""Repetition rules from each text's suffix array over words.

Suffixes of all documents of a batch are sorted at once by prefix doubling,
with the document as the first key, so no match crosses documents; after each
round only suffixes that still tie are sorted again.  Lengths of common
prefixes of neighbours follow from the ranks of the rounds.  An interval of the
LCP array is a maximal repeated substring; the longest one that a suffix
belongs to has the larger of its two neighbouring LCP values, so the union of
the spans of all maximal repeats of at least ``min_words`` words is the union
of those prefixes.

Defined results: a null text has no words; empty texts count zero everywhere;
a text of any length is one suffix array; repeated rows are judged alike; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_texts, sliced

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


def suffix_ranks(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rank of every suffix, and the ranks by the first 1, 2, 4, ... symbols, as far as suffixes tie."""
    n = len(ids)

    def regroup(where: np.ndarray, key: np.ndarray, base: np.ndarray) -> None:
        """Ranks of ``where`` from the order of ``key``; ``base``: the rank of each one's old group, the key's major part."""
        o = np.argsort(key, kind="stable")
        k, b = key[o], base[o]
        at = np.arange(len(o))
        old = np.maximum.accumulate(np.where(np.r_[True, b[1:] != b[:-1]], at, 0))
        new = np.maximum.accumulate(np.where(np.r_[True, k[1:] != k[:-1]], at, 0))
        rank[where[o]] = b + new - old

    rank = np.zeros(n, np.int64)
    regroup(np.arange(n), doc * (ids.max(initial=0) + 1) + ids, rank.copy())
    levels, h = [rank.copy()], 1
    active = np.arange(n)
    while True:
        size = np.bincount(rank[active], minlength=n)
        active = active[size[rank[active]] > 1]
        if not len(active):
            return rank, levels
        nxt = active + h
        inside = nxt < n
        second = np.zeros(len(active), np.int64)
        ok = np.flatnonzero(inside)
        ok = ok[doc[nxt[ok]] == doc[active[ok]]]
        second[ok] = rank[nxt[ok]] + 1
        base = rank[active]
        regroup(active, base * (n + 1) + second, base)
        h *= 2
        levels.append(rank.copy())


def longest_repeats(ids: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """For each position, the length of the longest prefix of its suffix that occurs at another place of its document; 0 if under ``least``."""
    out = np.zeros(len(ids), np.int64)
    if not len(ids):
        return out
    rank, levels = suffix_ranks(ids, doc)
    sa = np.empty(len(ids), np.int64)
    sa[rank] = np.arange(len(ids))
    a, b = sa[:-1], sa[1:]
    floor = max(k for k in range(len(levels)) if 1 << k <= least) if levels else 0
    tie = np.flatnonzero(levels[floor][a] == levels[floor][b])
    a, b = a[tie], b[tie]
    lcp = np.zeros(len(a), np.int64)
    padded = len(ids)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        ok = np.flatnonzero((x < padded) & (y < padded))
        same = ok[(levels[k][x[ok]] == levels[k][y[ok]]) & (doc[x[ok]] == doc[a[ok]]) & (doc[y[ok]] == doc[a[ok]])]
        lcp[same] += 1 << k
    lcp[lcp < least] = 0
    np.maximum.at(out, a, lcp)
    np.maximum.at(out, b, lcp)
    return out


def repetition(docs: DataFrame, min_words: int = 5, max_fraction: float = 0.2, max_longest: int = 100, min_total: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict of each document.

    ``n_repeat_words``: words inside repeats of ``min_words`` or more, first
    occurrences included; ``longest_repeat``: words of the longest repeat;
    ``spans``: merged runs ``(start, end)`` of repeated words.  ``base_failed``:
    fewer than ``min_total`` words, or more than ``max_fraction`` of them repeated.
    ``kept``: not failed and no repeat longer than ``max_longest`` words.
    """
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in longs], ("spans", span)])

    def counts(raw: bytes, text: str) -> tuple[int, int, int]:
        chars = len(text) - sum(text.count(c) for c in SPACES)
        symbols = sum(raw.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
        lines = text.split("\n")
        with_word = [x for x in lines if x.strip(SPACES)]
        return chars, symbols, len(with_word) - len(set(with_word))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            raws, seen, ticket = raw_texts(b), {}, count()
            texts = [x or "" for x in b.column("text").to_pylist()]
            words = [t.split() for t in raws]
            n = np.array([len(w) for w in words], np.int64)
            ids = np.fromiter((seen.setdefault(w, next(ticket)) for ws in words for w in ws), np.int64, int(n.sum()))
            del words
            doc, ends = np.repeat(np.arange(len(n)), n), np.cumsum(n)
            most = longest_repeats(ids, doc, min_words)
            edge = np.zeros(len(ids) + 1, np.int64)
            at = np.flatnonzero(most)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + most[at], -1)
            covered = np.r_[0, np.cumsum(np.cumsum(edge[:-1]) > 0)]
            inside = np.r_[0, (np.cumsum(edge[:-1]) > 0).astype(np.int8)]
            repeat = covered[ends] - covered[ends - n]
            longest = np.zeros(len(n), np.int64)
            np.maximum.at(longest, doc, most)
            starts = np.flatnonzero((inside[1:] == 1) & ((inside[:-1] == 0) | np.r_[True, doc[1:] != doc[:-1]][: len(ids)]))
            stops = np.flatnonzero((inside[1:] == 1) & (np.r_[inside[2:], 0][: len(ids)] == 0 if len(ids) else False) | ((inside[1:] == 1) & np.r_[doc[1:] != doc[:-1], True][: len(ids)])) + 1
            spans: list[list[dict]] = [[] for _ in n]
            for s, e in zip(starts.tolist(), stops.tolist()):
                base = int(ends[doc[s]] - n[doc[s]])
                spans[doc[s]].append({"start": s - base, "end": e - base})
            other = np.array([counts(r, t) for r, t in zip(raws, texts)], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(x) for x in (n, other[:, 0], other[:, 1], other[:, 2], repeat, longest)], pa.array(spans, span)], schema=schema)

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    r = d.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in longs) + ", spans array<struct<start: long, end: long>>")
    failed = (F.col("n_words") < min_total) | (100 * F.col("n_repeat_words") > round(100 * max_fraction) * F.col("n_words"))
    return r.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("longest_repeat") <= max_longest))


#: The same counts and verdict in DuckDB SQL, with every window of five words, and of 101, compared inside its document.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1)::BIGINT)) AS s FROM d),
f AS (SELECT doc_id, w, s, count(*) OVER (PARTITION BY doc_id, array_to_string(w[s : s + 4], ' ')) AS k FROM p),
c AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(s, s + 5)) AS i FROM f WHERE k > 1) GROUP BY doc_id),
l AS (SELECT doc_id, md5(array_to_string(w[s : s + 100], ' ')) AS h FROM f WHERE k > 1 AND s + 100 <= len(w)),
g AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, h FROM l GROUP BY doc_id, h HAVING count(*) > 1)),
n AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
b AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, g.doc_id IS NOT NULL AS long_repeat
  FROM d JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN g ON d.doc_id = g.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT long_repeat AS kept FROM b
"""
