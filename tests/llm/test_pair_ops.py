"""Operators 4, 6, 7, 9 and the pipeline against brute force, and their edge cases."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_resemblance import brute as brute_similar

import corpus_pipeline
from siftline.llm import multiindex, queries, simhash, site_bayes, substring, suffixes, toxicity
from siftline.llm.common import connected_components


def documents(rows):
    """One document for each id and text, in order."""
    out = {}
    for r in rows:
        out[r["doc_id"]] = r["text"] or ""
    return sorted(out.items())


def brute_words(docs, window):
    first, out = set(), {}
    for i, t in docs:
        w = t.encode().split()
        gone = set()
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in first:
                gone.update(range(s, s + window))
            first.add(k)
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out


def brute_bytes(docs, length):
    owner, out = {}, {}
    for i, t in docs:
        b = t.encode()
        for s in range(len(b) - length + 1):
            owner.setdefault(b[s : s + length], i)
    for i, t in docs:
        b = t.encode()
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if owner[b[s : s + length]] != i:
                gone[s : s + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def test_substring(docs, messy, none, rows):
    want = brute_words(documents(rows), 20)
    got = substring.deduplicate(docs).collect()
    assert len(got) == len(rows)
    for g in got:
        assert (g.n_words, g.n_removed, g.kept_sha256) == want[g.doc_id], g.doc_id
        assert sum(s.end - s.start for s in g.spans) == g.n_removed and hashlib.sha256(g.kept.encode()).hexdigest() == g.kept_sha256
    assert substring.deduplicate(messy).count() == messy.count() and substring.deduplicate(none).count() == 0
    cleaned = substring.clean(messy)
    assert cleaned.columns == messy.columns and cleaned.where("doc_id = 9008").first().text == "x y z"


def test_suffixes(docs, messy, none, rows):
    want = brute_bytes(documents(rows), 50)
    for hot in (64, 2):
        got = suffixes.deduplicate(docs, hot=hot).collect()
        assert len(got) == len(rows)
        for g in got:
            assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == want[g.doc_id], g.doc_id
    assert suffixes.deduplicate(messy).count() == messy.count() and suffixes.deduplicate(none).count() == 0


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(200):
        top = rng.choice([2, 3, 9])
        s = np.array([rng.randrange(1, top) if rng.random() < 0.99 else 1 << 30 for _ in range(rng.randrange(50))], np.int64)
        assert suffixes.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_small_alphabet(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(60)))) for i in range(30)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.deduplicate(d, window=6, gram=3).collect()} == {i: x[1] for i, x in brute_words(texts, 6).items()}
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in suffixes.deduplicate(d, length=9, gram=4, hot=5).collect()} == {i: x[1:3] for i, x in brute_bytes(texts, 9).items()}


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(45)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.u: r.label for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert all(got[x] == root(x) for x in got) and len(got) == len({x for a, b in pairs if a != b for x in (a, b)})


@pytest.mark.parametrize("repeat", [1, 300])
def test_multi_index(spark, repeat):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 16)).round(3)
    x[::3] += 4
    x[50:50 + repeat] = x[50]
    rows = [(i, v.tolist(), "s") for i, v in enumerate(x)] + [(1000, None, ""), (1020, [0.0] * 16, ""), (1040, [float("nan")] * 16, ""), (1060, [1.0], ""), (1080, [None] * 16, ""), (3, x[3].tolist(), "again")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = defaultdict(list)
    for r in multiindex.search(d, F.pmod("vec_id", F.lit(20)) == 0, centroids=8, probe=30, block_rows=64, query_rows=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert sorted(got) == list(range(0, 600, 20))
    for q in got:
        s = x @ x[q]
        want = sorted((i for i in range(600) if i != q), key=lambda i: (-round(s[i], 9), i))[:20]
        assert [i for i, _ in got[q]] == want and np.allclose([v for _, v in got[q]], s[want])


def test_multi_index_few(spark):
    d = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 1.0]), (20, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert {(r.query_id, r.vec_id) for r in multiindex.search(d, F.col("vec_id") % 20 == 0).collect()} == {(0, 1), (0, 20), (20, 0), (20, 1)}
    assert multiindex.search(d.where("vec_id < 0"), F.lit(True)).count() == 0


def test_site_quality(spark, messy, none):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op7_site_quality(spark, sf).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 5 = 0").select("kept", "quality").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert good.kept.mean() > 0.97 and bad.kept.mean() < 0.3
    given = spark.createDataFrame([(9005, 0), (9007, 1), (9007, 0), (None, 1), (9008, 1)], "doc_id long, label int")
    for lab in (given, given.where("doc_id < 0")):
        out = site_bayes.classify(messy, lab, F.col("source"), F.concat_ws("/", "source", "lang"))
        assert out.count() == messy.count() and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert site_bayes.classify(none, given, F.col("source"), F.col("lang")).count() == 0


def test_site_shrinking(spark):
    """A path with one bad document moves less than one with many."""
    rows = [(i, "same text", "h", "big" if i < 200 else "small") for i in range(201)] + [(1000 + i, "same text", f"g{i % 20}", "x") for i in range(400)]
    labels = spark.createDataFrame([(i, 0) for i in range(201)] + [(1000 + i, int(i % 20 > 4)) for i in range(400)], "doc_id long, label int")
    out = site_bayes.classify(spark.createDataFrame(rows, "doc_id long, text string, host string, path string"), labels, F.col("host"), F.col("path"))
    p = {(r.host, r.path): r.path_posterior for r in out.select("host", "path", "path_posterior").distinct().collect()}
    assert p["h", "big"] < p["h", "small"] < 0.5 < p["g9", "x"]


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, sf).cache()
    model_kept = {r.doc_id for r in clean.collect()}
    assert clean.columns == docs.columns and 0.7 * docs.count() < len(model_kept) < docs.count()
    one = stages["simhash near-dedup"](spark, clean, sf).cache()
    assert sorted(r.doc_id for r in one.collect()) == brute_similar([(r.doc_id, r.text or "") for r in clean.collect()])[0]
    sub = stages["substring dedup"](spark, one, sf).cache()
    want = brute_words(documents([r.asDict() for r in one.collect()]), 20)
    assert sub.columns == docs.columns and all(hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][2] and r.n_chars == len(r.text) for r in sub.collect())
    mixed = stages["mixing"](spark, sub, sf).cache()
    assert mixed.columns == docs.columns
    packed = stages["packing"](spark, mixed, sf)
    assert packed.agg(F.sum("length")).first()[0] == packed.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    assert corpus_pipeline.run(spark, sf).count() == packed.count()


def test_pipeline_stages_take_awkward_rows(spark, messy, none):
    sf = "/root/testdata/sf0.001"
    for d in (messy, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, d, sf)
            assert out.columns == d.columns and out.count() <= 2 * d.count()
        assert corpus_pipeline.STAGES[-1][1](spark, d, sf).count() >= 0
    assert toxicity.keep_clean(messy, None).count() == messy.count()
