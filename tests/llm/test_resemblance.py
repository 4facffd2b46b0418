"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import random

import corpus_pipeline


def brute(docs, similarity=0.8, shingle=5):
    """Documents that are the smallest of their component, and the number of similar pairs."""
    sets = {}
    for i, t in docs:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))}
    label, pairs = {i: i for i in sets}, 0
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity:
                pairs += 1
                lo, hi = sorted((label[a], label[b]))
                label = {i: lo if x == hi else x for i, x in label.items()}
    return sorted(i for i, x in label.items() if i == x), pairs


def edited(rng, words, edits):
    w = list(words)
    for k in rng.sample(range(len(w)), edits):
        w[k] = f"new{rng.randrange(10**9)}"
    return w


def test_stage_finds_every_pair_of_similarity_08(spark):
    rng = random.Random(5)
    common = [f"licence{k}" for k in range(30)]
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 300))]
        texts.append(base + common)
        for _ in range(rng.randrange(4)):
            texts.append(edited(rng, texts[-1], rng.randrange(1 + len(base) // 25)))
    nine = "a b c d e f g h i".split()
    texts += [nine[:8], nine[:9], nine[:8] + ["z"], common, common + ["x"], ["one"], ["One"], ["two"]]  # the first and second have 4 shingles of 5 in common
    rng.shuffle(texts)
    docs = list(enumerate(" ".join(w) for w in texts))
    want, pairs = brute(docs)
    assert pairs > 40
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["simhash near-dedup"]
    assert sorted(r.doc_id for r in stage(spark, d, "/root/testdata/sf0.001").collect()) == want
