"""The methods of operators 1, 4, 5, 6, 7, 8, 9 and 10 against plain computations, and the pipeline's later stages."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftline.llm import distributed_suffixes, language, mixing, multiindex, packing, resemblance, site_bayes, substring, toxicity
from test_pair_ops import brute_bytes, brute_words
from test_resemblance import brute as brute_similar


def plain_em(like, languages, rounds):
    pi = {j: 1 / len(languages) for j in languages}
    for _ in range(rounds):
        total = dict.fromkeys(languages, 0.0)
        for row in like:
            w = {j: row[j] * pi[j] for j in languages}
            z = max(sum(w.values()), 1e-30)
            for j in languages:
                total[j] += w[j] / z
        pi = {j: total[j] / len(like) for j in languages}
    return pi, sum(math.log(max(sum(row[j] * pi[j] for j in languages), 1e-30)) for row in like)


def test_language_sets_against_plain_em():
    rng = np.random.default_rng(3)
    sizes, k = [1, 2, 7, 30, 60], 6
    docs = [rng.normal(size=(n, k)) * 3 - (np.arange(k)[None, :] != rng.integers(0, 1 + d, size=n)[:, None]) * 4 for d, n in enumerate(sizes)]
    ll = np.concatenate(docs)
    ptr = np.cumsum([0, *sizes[:-1]])
    like = np.exp(ll - ll.max(axis=1)[:, None])
    for row, d in zip(language.proportions(like, ptr, np.ones((len(sizes), k)), 12, still=0)[0], docs):
        want = plain_em(np.exp(d - d.max(axis=1)[:, None]), range(k), 12)[0]
        assert np.allclose(row, [want[j] for j in range(k)], atol=1e-9)
    got = language.infer(ll, ptr, k, rounds=12)
    for row, d in zip(got, docs):
        x = np.exp(d - d.max(axis=1)[:, None])
        order = sorted(range(k), key=lambda j: -plain_em(x, range(k), 12)[0][j])
        best, score = None, -math.inf
        for n in range(1, k + 1):
            pi, fit = plain_em(x, order[:n], 12)
            fit -= (0.5 * math.log(len(d) + 1) + 1) * (n - 1)
            if fit <= score:
                break
            best, score = pi, fit
        assert np.allclose(row, [best.get(j, 0) for j in range(k)], atol=2e-3)


def test_more_than_four_languages():
    ll = np.full((600, 6), -40.0, np.float32)
    ll[np.arange(600), np.arange(600) % 6] = 0
    got = language.infer(ll, np.array([0]), 6)
    assert np.allclose(got, 1 / 6, atol=1e-3) and (language.infer(ll, np.array([0]), 6, most=2) > 0).sum() == 2


def test_toxicity_likelihood_and_score():
    """The fitted weights are where the plain noisy-or likelihood is flat, and scores are plain noisy-or."""
    import pyarrow as pa

    rng = random.Random(4)
    words, docs = ["w0", "w1", "w2"], []
    for _ in range(400):
        sentences = [[j for j in range(3) if rng.random() < 0.25] for _ in range(rng.randrange(1, 5))]
        risk = 1 - math.prod(1 - 1 / (1 + math.exp(3 - sum((3, -1, 0)[j] for j in s))) for s in sentences)
        docs.append((sentences, int(rng.random() < risk)))

    def loss(w, b, l2):
        total = 0.0
        for sentences, y in docs:
            a = sum(math.log1p(math.exp(b + sum(w[j] for j in s))) for s in sentences)
            total += a if not y else -math.log(-math.expm1(-a))
        return total / len(docs) + l2 / 2 * sum(x * x for x in w)

    bags = [[[k, *f] for f, k in Counter(tuple(s) for s in sentences if s).items()] for sentences, _ in docs]
    plain = [sum(not s for s in sentences) for sentences, _ in docs]
    t = pa.table({"label": pa.array([y for _, y in docs], pa.int64()), "plain": pa.array(plain, pa.int64()), "bags": pa.array(bags, pa.list_(pa.list_(pa.int64())))})
    m = toxicity._train(words, t, steps=3000, l2=1e-3)
    w, b = [m.weights[x] for x in words], m.bias
    here = loss(w, b, 1e-3)
    for k in range(4):
        for step in (0.05, -0.05):
            v, c = list(w), b
            if k < 3:
                v[k] += step
            else:
                c += step
            assert loss(v, c, 1e-3) > here - 1e-6
    m = toxicity.Model(["idiot", "dumm^"], np.array([2.0, 1.5]), -3.0)
    p = lambda z: 1 / (1 + math.exp(-z))
    assert m.score("You IDIOT. fine\nDummer idiot! ok?", 0.3)[0] == pytest.approx(1 - (1 - p(-1.0)) * (1 - p(-3.0)) * (1 - p(0.5)) * (1 - p(-3.0)))
    assert m.score("", 0.3)[0] == m.score(" . ! ", 0.3)[0] == pytest.approx(p(-3.0))


def test_site_posteriors_against_plain_computation(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for h in range(12):
        base = rng.random()
        for p in range(rng.randrange(1, 6)):
            rate = min(1.0, max(0.0, base + rng.uniform(-0.3, 0.3)))
            for _ in range(rng.randrange(1, 40)):
                rows.append((len(rows), "same text", f"h{h}", f"p{p}"))
                labels.append((len(labels), int(rng.random() < rate)))
    d = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    got = {(r.host, r.path): (r.host_posterior, r.path_posterior) for r in site_bayes.classify(d, spark.createDataFrame(labels, "doc_id long, label int"), F.col("host"), F.col("path")).collect()}
    y = dict(labels)
    by_host, by_path = defaultdict(list), defaultdict(list)
    for i, _, h, p in rows:
        by_host[h].append(y[i])
        by_path[h, p].append(y[i])
    n, mean = len(rows), sum(y.values()) / len(rows)
    ss = lambda xs: sum((x - sum(xs) / len(xs)) ** 2 for xs in [xs] for x in xs)
    within_path, within_host = sum(map(ss, by_path.values())) / (n - len(by_path)), sum(map(ss, by_host.values())) / (n - len(by_host))
    m = lambda xs: sum(xs) / len(xs)
    q_path = sum(len(v) * (m(v) - m(by_host[h])) ** 2 for (h, _), v in by_path.items())
    s_path = sum(len(v) - sum(len(w) ** 2 for (g, _), w in by_path.items() if g == h) / len(v) for h, v in by_host.items())
    var_path = (q_path - (len(by_path) - len(by_host)) * within_path) / s_path
    q_host = sum(len(v) * (m(v) - mean) ** 2 for v in by_host.values())
    var_host = (q_host - (len(by_host) - 1) * within_host) / (n - sum(len(v) ** 2 for v in by_host.values()) / n)
    a, b = (max(1.0, w / v) if v > 0 else 1e6 for w, v in ((within_host, var_host), (within_path, var_path)))
    for (h, p), v in by_path.items():
        host = (sum(by_host[h]) + a * mean) / (len(by_host[h]) + a)
        assert got[h, p] == pytest.approx((host, (sum(v) + b * host) / (len(v) + b)), abs=1e-9)


def test_hosts_that_differ_do_not_make_paths_differ(spark):
    """Paths of one host that are alike are shrunk together, however much hosts differ."""
    rows = [(h, p, float(h % 2), float(h % 2), 50) for h in range(10) for p in range(4)]
    _, s_host, s_path = site_bayes.strengths(spark.createDataFrame([(f"h{h}", f"p{p}", 25.0 + 15 * h_, 25.0 + 15 * h_, n) for h, p, h_, _, n in rows], "host string, path string, good double, square double, n long"))
    assert s_path == 1e6 and s_host < 10


@pytest.mark.parametrize("hot", [64, 2, 1])
def test_seeds_in_ever_new_surroundings(spark, hot):
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(60)]
    word = lambda c: f"{c}{rng.randrange(50)}"
    texts = [(i, " ".join([word("x") for _ in range(rng.randrange(40))] + passage[rng.randrange(20) : rng.randrange(30, 61)] + [word("y") for _ in range(rng.randrange(40))])) for i in range(60)]
    texts += [(100 + i, texts[i][1]) for i in range(10)] + [(200, " ".join(passage * 3)), (201, None), (202, "")]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.deduplicate(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), hot=hot).collect()}
    assert got == brute_words([(i, t or "") for i, t in texts], 20)


def test_queue_order_with_quanta_and_weights():
    rng = random.Random(1)
    for _ in range(60):
        quantum, m = rng.choice([1, 2, 3, 7, 20]), rng.randrange(1, 6)
        n = np.array([float(rng.randrange(1, 60)) for _ in range(m)])
        z = packing.Queues(n, None if rng.random() < 0.5 else np.array([rng.choice([1.0, 2.0, 5.0, 0.5]) for _ in range(m)]), quantum)
        blocks = sorted(((b + 0.5) / z.pace[s], s, b) for s in range(m) for b in range(int(z.blocks[s])))
        order = [(s, k) for _, s, b in blocks for k in range(b * quantum, min((b + 1) * quantum, int(n[s])))]
        assert [packing.places(np.array([s]), np.array([k]), z)[0] for s, k in order] == list(range(len(order)))
        got = packing.first_tokens(np.arange(len(order) + 1), z)
        assert all(got[u].tolist() == [sum(x[0] == s for x in order[:u]) for s in range(m)] for u in range(len(order) + 1))


def windows_of(pieces):
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append(p)
    for ps in by.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        yield at, ps


def test_packing_to_weights(spark, docs, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    source = {r["doc_id"]: r["source"] for r in rows}
    weights = {s: 1.0 + i for i, s in enumerate(sorted({x for x in source.values() if x}))} | {None: 0.5}
    natural = packing.pack(docs, path, window=512).collect()
    pieces = packing.pack(docs, path, window=512, quantum=64, weights=weights).collect()
    total = sum(p.length for p in natural)
    assert sum(p.length for p in pieces) == total and len(pieces) < len(natural)
    assert sorted((p.doc_id, p.ids_crc32) for p in pieces if p.length == p.doc_tokens) != [] and all(n == 512 for n, _ in sorted(windows_of(pieces), key=lambda x: x[1][0].sequence_id)[:-1])
    taken, left = Counter(), Counter()
    for p in pieces:
        left[source[p.doc_id]] += p.length
    for _, ps in sorted(windows_of(pieces), key=lambda x: x[1][0].sequence_id):
        for p in ps:
            taken[source[p.doc_id]] += p.length
        if any(taken[s] == left[s] for s in weights):
            break
        share = {s: sum(taken.values()) * w / sum(weights.values()) for s, w in weights.items()}
        assert all(abs(taken[s] - share[s]) <= 2 * 64 for s in weights)
    with pytest.raises(ValueError, match="no positive weight"):
        packing.pack(docs, path, weights={"src0": 1.0})


def test_other_tokenizers_are_read_whole(docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = packing.WordTokeniser(path)
    texts = [r["text"] or "" for r in rows[:40]] + ["  two  spaces ", "a\n\nb"]
    want = Tokenizer.from_file(path)
    assert not t.by_word and [np.frombuffer(x, f"<u{t.width}").tolist() for x in t.ids(texts)] == [want.encode(x, add_special_tokens=False).ids for x in texts]
    assert packing.WordTokeniser(public_tokenizers.path("word_bpe_49k.json")).by_word


def test_multi_index_recall_with_slack(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)) + 3 * rng.normal(size=(30, 16))[np.arange(3000) % 30]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for slack, least in ((1.0, 1.0), (0.5, 0.95)):
        hits = 0
        for r in multiindex.search(d, F.col("vec_id") % 20 == 0, probe=200, slack=slack).groupBy("query_id").agg(F.collect_set("vec_id").alias("v")).collect():
            s = x @ x[r.query_id]
            s[r.query_id] = -np.inf
            hits += len(set(np.argsort(-s)[:20].tolist()) & set(r.v))
        assert hits >= least * 150 * 20


def test_rows_of_one_id_are_taken_alike_in_reruns(spark):
    d = spark.createDataFrame([(1, f"text number {i}", "s") for i in range(50)] + [(2, "a b c", "t")], "doc_id long, text string, source string")
    first = sorted(map(tuple, mixing.emit(d.repartition(1)).collect()))
    assert first == sorted(map(tuple, mixing.emit(d.repartition(7, "text")).collect()))


@pytest.mark.parametrize("n", [0, 1, 4, 17])
def test_distributed_order(spark, n):
    rng = random.Random(n)
    s = [rng.randrange(1, 3) for _ in range(n)]
    d = spark.createDataFrame([(i, c) for i, c in enumerate(s)], "pos long, c long").repartition(3)
    got = {r.pos: r.rank for r in distributed_suffixes.suffix_order(d).collect()}
    assert [got[i] for i in sorted(got)] == [sorted(range(n), key=lambda i: s[i:]).index(i) for i in range(n)]


def test_distributed_repeats(spark, monkeypatch):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("abé") for _ in range(rng.randrange(25)))) for i in range(8)] + [(9, None)]

    def removed():
        got = defaultdict(set)
        for r in distributed_suffixes.repeated_starts(spark.createDataFrame(texts, "rid long, text string"), 6).collect():
            if r.least < r.rid:
                got[r.rid].update(range(r.start, r.start + 6))
        return {i: len(got[i]) for i, _ in texts}

    want = {i: x[1] for i, x in brute_bytes([(i, t or "") for i, t in texts], 6).items()}
    assert removed() == want and any(want.values())
    monkeypatch.setattr(distributed_suffixes, "suffix_order", lambda s: s.select("pos", F.col("pos").alias("rank")))
    assert removed() != want  # runs are runs of the order: without it they fall apart


def test_near_duplicate_stage_against_all_pairs(spark):
    """The stage on the small table: the smallest id of each component of pairs of similarity 0.8 or more."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    want, pairs = brute_similar([(i, t.encode().decode()) for i, t in rows])
    stage = dict(corpus_pipeline.STAGES)["simhash near-dedup"]
    assert pairs > 0 and sorted(r.doc_id for r in stage(spark, docs, "").collect()) == want


def test_many_near_copies_join_without_all_pairs(spark):
    """A base and hundreds of edited copies of it: few pairs are checked."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [base]
    for _ in range(300):
        w = list(base)
        for k in rng.sample(range(200), 3):
            w[k] = f"n{rng.randrange(10**9)}"
        texts.append(w)
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "rid long, text string")
    checked = []
    kept = resemblance._checked
    try:
        resemblance._checked = lambda pairs, *a: checked.append(pairs.count()) or kept(pairs, *a)
        got = resemblance.components(d).collect()
    finally:
        resemblance._checked = kept
    sets = [{tuple(w[k : k + 5]) for k in range(196)} for w in texts]
    similar = [i for i in range(1, 301) if len(sets[0] & sets[i]) / len(sets[0] | sets[i]) >= 0.8]
    assert len(similar) > 200 and {r.label for r in got if r.rid in similar} == {0} and sum(checked) < 3000


def test_later_stages(spark):
    """Substring removal, mixing and packing of what the near-duplicate stage keeps."""
    sf = "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    one = stages["simhash near-dedup"](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).cache()
    sub = stages["substring dedup"](spark, one, sf).cache()
    want = brute_words(sorted((r.doc_id, r.text or "") for r in one.collect()), 20)
    assert sub.columns == one.columns and all(hashlib.sha256((r.text or "").encode()).hexdigest() == want[r.doc_id][2] and r.n_chars == len(r.text) for r in sub.collect() if want[r.doc_id][1])
    mixed = stages["mixing"](spark, sub, sf).cache()
    assert mixed.columns == one.columns
    packed = stages["packing"](spark, mixed, sf)
    assert packed.agg(F.sum("length")).first()[0] == packed.where("start = 0").agg(F.sum("doc_tokens")).first()[0]


def test_bitmap_of_repeated_anchors_grows_with_them(spark):
    import pyarrow as pa

    from siftline.llm import winnow

    rng = np.random.default_rng(5)
    twice, once = (rng.integers(0, 1 << 64, n, dtype=np.uint64) for n in (60_000, 120_000))
    slices = [winnow.dealt_places(x) for x in (np.r_[twice, once[:60_000]], np.r_[once[60_000:], twice[::-1]], np.zeros(0, np.uint64))]
    rows = spark.createDataFrame(pa.Table.from_batches(slices))
    for low, size in ((12, 20), (22, 22)):
        bitmap = winnow.repeated_bitmap(rows, min_bits=low, max_bits=24, room=8)
        assert winnow.passes(bitmap, twice).all() and winnow.passes(bitmap, once).mean() < 0.12
        assert (1 << low) <= 8 * len(bitmap) <= 1 << max(size, 20)
    assert not winnow.repeated_bitmap(rows.limit(0)).any()
