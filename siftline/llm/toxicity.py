"""Toxicity by multiple-instance learning.

A text is a bag of sentences.  A sentence's score is a logistic function of its
words; the text's score is the noisy-or of its sentences, 1 - prod(1 - p).
Only labels of whole texts are given, and the likelihood of the noisy-or is
maximised over them, so the model learns which sentences offend and can point
to them.  Features are words and, as offensive stems come with many endings,
word beginnings of four to eight letters; those are kept whose document
frequencies differ most between the two labels.

Defined results: a null or empty text has one empty sentence; with no labelled
text the score is 0; texts of any length are read whole; a label row that comes
twice counts twice; repeated rows are scored alike; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from math import exp, expm1, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, sliced

SENTENCE = re.compile(r"[.!?\n]+")
WORDS = re.compile(r"[^\W\d_]+")


STEMS = range(4, 9)


def features(words: set[str]) -> set[str]:
    """Words, and their beginnings marked by a caret."""
    return words | {w[:k] + "^" for w in words for k in STEMS if len(w) > k}


#: Words of which a worker remembers the features; then it begins anew.
REMEMBERED = 200_000


class Model:
    """Weights of features, and the bias of a sentence."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: float):
        self.weights, self.bias = dict(zip(names, weights.tolist())), float(bias)
        self.known: dict[str, tuple[str, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def of(self, words: list[str]) -> set[str]:
        """Features of the words that have a weight."""
        known, found = self.known, []
        for w in words:
            f = known.get(w)
            if f is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                f = known[w] = tuple(features({w}) & self.weights.keys())
            if f:
                found += f
        return set(found)

    def score(self, text: str, threshold: float) -> tuple[float, list[dict]]:
        """The text's score and its sentences of at least ``threshold``, as runs of characters of ``text.lower()``."""
        low, weights = text.lower(), self.weights
        n, at, logs, bad = 0, 0, 0.0, []
        plain = float(np.log1p(np.exp(self.bias)))
        for m in chain(SENTENCE.finditer(low), (None,)):
            end = m.start() if m else len(low)
            s = low[at:end]
            if s.strip():
                n += 1
                hits = self.of(WORDS.findall(s))
                if not hits:
                    logs += plain
                else:
                    z = self.bias + sum(weights[w] for w in sorted(hits))
                    logs += max(z, 0.0) + log1p(exp(-abs(z)))
                    p = 1 / (1 + exp(-z)) if z > -700 else 0.0
                    if p >= threshold:
                        bad.append({"start": at, "end": end, "score": p})
            at = m.end() if m else end
        return -expm1(-(logs if n else plain)), bad


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, max_features: int = 2_048, min_docs: int = 5, steps: int = 400, l2: float = 1e-4, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Fit on at most ``max_train`` labelled texts: those of ``labels(doc_id, label)`` with the smallest hash of their id.

    The driver gathers the features of these texts by sentence, and only of sentences that have one.
    """
    sample = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL").join(F.broadcast(sample), "doc_id").select(F.col("label").cast("int").alias("label"), "text")  # max_train rows at most
    d = materialise(d, "labelled")
    sums = {r["label"]: r["n"] for r in d.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = sums.get(1, 0), sums.get(0, 0)
    if not pos or not neg:
        return None
    word_schema = pa.schema([("word", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for b in sliced(batches):
            for label, text in zip(b.column("label").to_pylist(), b.column("text").to_pylist()):
                counts[1 - label].update(features(set(WORDS.findall(text.lower()))))
        words = list(counts[0].keys() | counts[1].keys())
        for i in range(0, len(words), 10_000):
            w = words[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array([counts[0][x] for x in w], pa.int64()), pa.array([counts[1][x] for x in w], pa.int64())], schema=word_schema)

    w = d.where("label IN (0, 1)").mapInArrow(frequencies, "word string, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") + F.col("neg") >= min_docs)
    share = (F.col("pos") + F.col("neg")) / (pos + neg)
    z = (F.col("pos") - pos * share) / F.sqrt(pos * share * (1 - share) * neg / (pos + neg) + 1e-9)
    chosen = [r["word"] for r in w.select("word", F.abs(z).alias("z")).orderBy(F.desc("z"), "word").limit(max_features).collect()]
    index = {x: i for i, x in enumerate(chosen)}
    bag_schema = pa.schema([("label", pa.int64()), ("plain", pa.int64()), ("bags", pa.list_(pa.list_(pa.int64())))])

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            plain, out = [], []
            for text in b.column("text").to_pylist():
                seen, n = Counter(), 0
                for s in SENTENCE.split(text.lower()):
                    if s.strip():
                        f = tuple(sorted(index[x] for x in features(set(WORDS.findall(s))) if x in index))
                        n += not f
                        if f:
                            seen[f] += 1
                plain.append(n or (0 if seen else 1))
                out.append([[k, *f] for f, k in seen.items()])
            yield pa.RecordBatch.from_arrays([b.column("label").cast(pa.int64()), pa.array(plain, pa.int64()), pa.array(out, pa.list_(pa.list_(pa.int64())))], schema=bag_schema)

    got = d.where("label IN (0, 1)").mapInArrow(bags, "label long, plain long, bags array<array<long>>").toArrow()
    return _train(chosen, got, steps, l2)


def _train(words: list[str], got: pa.Table, steps: int, l2: float) -> Model:
    """Maximise the noisy-or likelihood by Adam on the whole sample."""
    y = got.column("label").to_numpy().astype(float)
    plain = got.column("plain").to_numpy().astype(float)
    outer = got.column("bags").combine_chunks()
    inner = outer.values
    values, offsets = inner.values.to_numpy(), inner.offsets.to_numpy()
    doc = np.repeat(np.arange(len(y)), np.diff(outer.offsets.to_numpy()))
    first = offsets[:-1]
    times = values[first].astype(float)
    row = np.repeat(np.arange(len(first)), np.diff(offsets))
    is_feature = np.ones(len(values), bool)
    is_feature[first] = False
    row, feature = row[is_feature], values[is_feature]
    rate = min(max(y.mean(), 1e-3), 0.5)
    w, b = np.zeros(len(words)), np.log(rate / max(1.0, plain.mean()))
    m, v = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(row, w[feature], minlength=len(first))
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-b))
        a = plain * np.log1p(np.exp(b)) + np.bincount(doc, times * np.logaddexp(0, z), minlength=len(y))
        score = np.clip(-np.expm1(-a), 1e-9, 1)
        da = np.where(y == 1, -(1 - score) / score, 1.0)  # of the negative log likelihood by a = -log(1 - score)
        dz = da[doc] * times * p
        g = np.r_[np.bincount(feature, dz[row], minlength=len(words)) / len(y) + l2 * w, (dz.sum() + (da * plain * p0).sum()) / len(y)]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(words, w, b)


def score(docs: DataFrame, model: Model | None, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, predicted, sentences)``: ``sentences`` are the character spans and scores of those of at least ``threshold``."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("sentences", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            got = [model.score(t or "", threshold) if model else (0.0, []) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x[0] for x in got], pa.float64()), pa.array([x[1] for x in got], kind)], schema=schema)

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, sentences array<struct<start: long, end: long, score: double>>")
    return d.withColumn("predicted", (F.col("score") >= threshold).cast("int")).select("doc_id", "score", "predicted", "sentences")


def keep_clean(docs: DataFrame, model: Model | None, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores under ``threshold``, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, text_col):
            yield b.filter(pa.array([not model or model.score(t or "", threshold)[0] < threshold for t in b.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
