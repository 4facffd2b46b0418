"""Quality classifier with hierarchical empirical Bayes over sites.

A document classifier, logistic over binned shape figures of the text, gives
each document a probability of being good.  Over a host, and over a path of a
host, the mean of its documents' labels, or probabilities where there is none,
is shrunk: the host's toward the global mean, the path's toward its host's
posterior.  Strengths of shrinking are fitted by moments: the documents' own
variance inside a path, over the variance of paths inside their hosts that is
left when chance is taken off, and the same for hosts.  A document's score adds the log-odds by which its path departs
from the global mean to the log-odds of its own evidence.

Sums over hosts and paths are grouped aggregates with partial sums, so a host
with a third of all documents is no single task.

Defined results: null and empty texts are scored by their figures of zero; null
hosts and paths are values of their own; with no labels every probability is
one half; a document with several labels has their mean; repeated rows are
scored alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, raw_texts, sliced

BINS = 10
FIGURES = 10


def figures(raw: bytes) -> list[float]:
    """Shape figures of a UTF-8 text: shares of kinds of characters, of repeated words and lines, and sizes."""
    n = max(1, len(raw))
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    w = max(1, len(words))
    letters = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>{}[]^~_=+\\/@"))
    marks = raw.count(b"!") + raw.count(b"?")
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    return [np.log1p(len(words)), n / w, letters / n, symbols / w, marks / w, digits / n, len(set(words)) / w, 1 - len(set(lines)) / max(1, len(lines)), (raw.count(b".") + raw.count(b",")) / w, w / max(1, len(lines)) / (1 + w)]


class Evidence:
    """Logistic model over the figures' quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        z = self.bins(x)
        w = np.zeros(z.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-z @ w))
            g = z.T @ (p - y) + ridge * w
            w -= np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(len(w)), g)
        self.w = w

    def bins(self, x: np.ndarray) -> np.ndarray:
        parts = [np.ones((len(x), 1))]
        for c, column in zip(self.cuts, x.T):
            parts.append(np.eye(len(c) + 1)[np.searchsorted(c, column, side="right")])
        return np.hstack(parts)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bins(x) @ self.w, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 20_000) -> Evidence | None:
    """From at most ``max_train`` labelled texts: those of ``labels(doc_id, label)`` with the smallest hash of their id."""
    sample = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    schema = pa.schema([("label", pa.float64()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([figures(t) for t in raw_texts(b)], pa.list_(pa.float64()))], schema=schema)

    got = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.col("label").cast("double").alias("label"), "text").mapInArrow(run, "label double, x array<double>").toArrow()  # max_train rows at most
    y = got.column("label").to_numpy()
    if not len(y) or y.min() == y.max():
        return None
    return Evidence(got.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1), y)


def strength(between: float, groups: float, spread: float, within: float, most: float = 1e6) -> float:
    """How many documents a prior is worth: the variance of documents over that of group means, one-way analysis with unequal groups.

    ``between``: the sum over groups of n (mean - mean of all)**2, which is
    expected to be ``groups`` times the variance of documents, plus ``spread``
    times that of the means; ``groups``: groups less those they are compared
    within; ``spread``: the sum of n - n**2 / (n of all); ``within``: the variance of documents.
    """
    if groups < 1 or spread <= 0:
        return 10.0  # nothing to compare
    means = (between - groups * within) / spread
    return float(min(most, max(1.0, within / means))) if means > 1e-12 else most


def strengths(paths: DataFrame) -> tuple[float, float, float]:
    """Global mean, and the strengths of hosts and of paths, from ``paths(host, path, good, square, n)``: sums by path."""
    n, mean = F.col("n"), F.col("good") / F.col("n")
    host = paths.groupBy("host").agg(
        F.sum("good").alias("g"), F.sum("n").alias("m"), F.sum("square").alias("sq"), F.sum(F.col("good") * mean).alias("gg"), F.sum(n * n).alias("nn"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("square") - F.col("good") * mean).alias("ss"),
    )
    hm = F.col("g") / F.col("m")
    r = host.agg(
        F.sum("g").alias("g"), F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("g") * hm).alias("gh"), F.count(F.lit(1)).alias("hosts"), F.sum("k").alias("paths"),
        F.sum(F.col("gg") - F.col("g") * hm).alias("q_path"), F.sum(F.col("m") - F.col("nn") / F.col("m")).alias("s_path"), F.sum("ss").alias("in_path"), F.sum(F.col("sq") - F.col("g") * hm).alias("in_host"),
    ).first()
    if not r["m"]:
        return 0.5, 10.0, 10.0
    mean_all = r["g"] / r["m"]
    var_path, var_host = (max(0.0, r[x]) / max(1, r["m"] - r[k]) for x, k in (("in_path", "paths"), ("in_host", "hosts")))
    s_path = strength(r["q_path"], r["paths"] - r["hosts"], r["s_path"], var_path)
    s_host = strength(r["gh"] - r["g"] * mean_all, r["hosts"] - 1, r["m"] - r["mm"] / r["m"], var_host)
    return min(max(mean_all, 1e-6), 1 - 1e-6), s_host, s_path


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = 0.5, max_train: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, host, path, evidence, host_posterior, path_posterior, score, kept)``.

    ``host`` and ``path`` are expressions over the columns of ``docs``; ``labels(doc_id, label)``, label 1 for good.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), host.cast("string").alias("host"), path.cast("string").alias("path"))
    model = fit(d, labels, max_train)
    schema = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("evidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            p = model(np.array([figures(t) for t in raw_texts(b)])) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("host").cast(pa.string()), b.column("path").cast(pa.string()), pa.array(p)], schema=schema)

    e = materialise(d.mapInArrow(run, "doc_id long, host string, path string, evidence double"), "evidence")
    given = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy(F.col("doc_id").alias("_i")).agg(F.avg(F.col("label").cast("double")).alias("label"))
    known = e.join(given, F.col("doc_id") == F.col("_i"), "left").select("host", "path", F.coalesce("label", "evidence").alias("good"))
    paths = materialise(known.groupBy("host", "path").agg(F.sum("good").alias("good"), F.sum(F.col("good") * F.col("good")).alias("square"), F.count(F.lit(1)).alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    m, s_host, s_path = strengths(paths)
    hosts = hosts.select(F.col("host").alias("_h"), ((F.col("good") + s_host * m) / (F.col("n") + s_host)).alias("host_posterior"))
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("_h")))
    sites = sites.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "host_posterior", ((F.col("good") + s_path * F.col("host_posterior")) / (F.col("n") + s_path)).alias("path_posterior"))
    logit = lambda p: F.ln(F.greatest(p, F.lit(1e-9)) / F.greatest(1 - p, F.lit(1e-9)))
    z = logit(F.col("evidence")) + logit(F.col("path_posterior")) - F.lit(float(np.log(m / (1 - m))))
    out = e.join(sites, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")))
    return out.withColumn("score", 1 / (1 + F.exp(-z))).select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= threshold).alias("kept"))
