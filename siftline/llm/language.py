"""Multilingual mixture inference: which languages a text is written in, and in what proportions.

Each language has smoothed likelihoods of hashed letter n-grams, learned from
labelled texts.  A text is cut into segments of a few words; a segment's
log-likelihood under a language is the sum over its n-grams, divided by the
n-gram length as they overlap.  Expectation maximisation estimates the
language proportions of the text from its segments.  Languages are ranked by
their proportions under all of them, and the set grows by the next of that
order, up to all learned languages, as long as the likelihood less
log(segments + 1) / 2 + 1 for each free proportion rises.

The likelihoods, 256 KB a language, are all that the driver gathers and sends
to the tasks.

Defined results: null texts and texts with no letter are ``und`` with score 0;
with no labelled text at all every text is ``und``; texts of any length are
read whole; repeated rows are judged alike; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced

BUCKETS = 1 << 16
GRAM = 3
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams over all texts, the number of the word each one ends in, and the words' texts.

    A word is a run of letters, or rather of bytes that are a-z or not ASCII; each is read with one space before and after.
    """
    parts = [(" " + t.lower() + " ").encode("utf-8", "surrogatepass") for t in texts]
    b = _FOLD[np.frombuffer(b"".join(parts), np.uint8)]
    text = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    keep = np.flatnonzero((b != 32) | (np.r_[0, b[:-1]] != 32))
    b, text = b[keep], text[keep]
    starts = (b[1:] != 32) & (b[:-1] == 32)
    word = np.cumsum(np.r_[False, starts]) - 1
    of_word = text[1:][starts]
    x = b.astype(np.uint32)
    code = x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]
    h = (code * np.uint32(2654435761)) >> np.uint32(16)
    fits = (b[1:-1] != 32) & (word[1:-1] >= 0)  # a trigram belongs to the word of its middle letter
    return h[fits].astype(np.int64), word[1:-1][fits], of_word


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train: Column, max_train: int) -> tuple[list[str], np.ndarray]:
    """Languages and a table [bucket, language] of log-likelihoods, from at most ``max_train`` labelled texts.

    The sample is the labelled rows with the smallest hash of their id; ids that share the last hash all count.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    hashed = F.xxhash64("doc_id")
    edge = d.select(hashed.alias("h")).orderBy("h").limit(max_train).agg(F.max("h")).first()[0]
    if edge is None:
        return [], np.zeros((BUCKETS, 0), np.float32)
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in sliced(batches):
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            for lang in set(langs):
                h, _, _ = grams([t for t, x in zip(texts, langs) if x == lang])
                sums[lang] = sums.get(lang, 0) + np.bincount(h, minlength=BUCKETS)
        for lang, c in sums.items():
            g = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(c[g])], schema=schema)

    rows = d.where(hashed <= F.lit(edge)).select("text", "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows a language
    langs = sorted(rows["lang"].unique().tolist())
    c = np.zeros((BUCKETS, len(langs)))
    c[rows["gram"].to_numpy(), rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()] = rows["n"].to_numpy()
    c += 0.5
    return langs, (np.log(c / c.sum(axis=0)) / GRAM).astype(np.float32)


def proportions(like: np.ndarray, ptr: np.ndarray, mask: np.ndarray, rounds: int = 12, still: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Proportions [document, language] by expectation maximisation over the languages of ``mask``, and each document's log-likelihood.

    ``like``: likelihoods [segment, language], ``ptr``: first segment of each
    document.  Rounds end early when no proportion moves by ``still``.
    """
    size = np.diff(np.r_[ptr, len(like)])
    doc = np.repeat(np.arange(len(ptr)), size)
    pi = mask / mask.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        r = like * pi[doc]
        r /= np.maximum(r.sum(axis=1), 1e-30)[:, None]
        new = np.add.reduceat(r, ptr, axis=0) / size[:, None]
        moved = np.abs(new - pi).max(initial=0)
        pi = new
        if moved < still:
            break
    fit = np.log(np.maximum((like * pi[doc]).sum(axis=1), 1e-30))
    return pi, np.add.reduceat(fit, ptr)


def infer(ll: np.ndarray, ptr: np.ndarray, languages: int, rounds: int = 12, most: int | None = None) -> np.ndarray:
    """Proportions [document, language] of the chosen sets; ``ll``: log-likelihoods [segment, language], ``ptr``: first segment of each document, all of which have some.

    ``most``: languages of a set, all of them if none is given.
    """
    size = np.diff(np.r_[ptr, len(ll)])
    like = np.exp(ll - ll.max(axis=1)[:, None])
    pi, _ = proportions(like, ptr, np.ones((len(ptr), languages), np.float32), rounds)
    place = np.argsort(np.argsort(-pi, axis=1, kind="stable"), axis=1)
    best, score = proportions(like, ptr, (place < 1).astype(np.float32), 1)
    active = np.arange(len(ptr))
    for k in range(2, min(most or languages, languages) + 1):
        part = np.repeat(ptr[active], size[active]) + np.arange(int(size[active].sum())) - np.repeat(np.cumsum(size[active]) - size[active], size[active])
        p, fit = proportions(like[part], np.cumsum(size[active]) - size[active], (place[active] < k).astype(np.float32), rounds)
        fit = fit - (0.5 * np.log(size[active] + 1) + 1) * (k - 1)
        up = fit > score[active]
        active = active[up]
        best[active], score[active] = p[up], fit[up]
        if not len(active):
            break
    return best


def identify(docs: DataFrame, train: Column, segment_words: int = 4, max_train: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, lang_pred, score, languages)``: the language of the largest proportion, that proportion, and all chosen languages with theirs.

    Learned from rows for which ``train`` holds over the columns ``doc_id``, ``text`` and ``lang``.
    """
    langs, likelihoods = fit(docs, id_col, text_col, lang_col, train, max_train)
    table = docs.sparkSession.sparkContext.broadcast(likelihoods)  # BUCKETS numbers a language
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = [x or "" for x in b.column("text").to_pylist()]
            pred, score, mix = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            h, word, of_word = grams(texts) if langs else (np.zeros(0, int),) * 3
            if len(h):
                first = np.flatnonzero(np.r_[True, of_word[1:] != of_word[:-1]])
                nth = np.arange(len(of_word)) - np.repeat(first, np.diff(np.r_[first, len(of_word)]))
                segment = np.cumsum((nth % segment_words == 0).astype(np.int64)) - 1
                of_gram = segment[word]
                ll = np.add.reduceat(table.value[h], np.flatnonzero(np.r_[True, of_gram[1:] != of_gram[:-1]]), axis=0)
                of_segment = of_word[np.flatnonzero(nth % segment_words == 0)]
                ptr = np.flatnonzero(np.r_[True, of_segment[1:] != of_segment[:-1]])
                pi = infer(ll, ptr, len(langs))
                for i, p in zip(of_segment[ptr].tolist(), pi):
                    t = texts[i]
                    if t.isascii() or any(c.isalpha() for c in t):
                        o = np.argsort(-p, kind="stable")
                        pred[i], score[i] = langs[o[0]], min(1.0, float(p[o[0]]))
                        mix[i] = [{"lang": langs[j], "share": float(p[j])} for j in o if p[j] > 0]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), pa.array(mix, kind)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<struct<lang: string, share: double>>")
