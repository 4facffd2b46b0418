"""Operators 1, 2, 3, 5, 8 and 10 against brute force, and their edge cases."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from siftline.llm import language, mixing, packing, queries, repetition, simhash, toxicity

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def words(text):
    return (text or "").encode().split()


def brute_repetition(text):
    w = words(text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    longest = 0
    for n in (5, 20, 70, 100, 101, 1500, 2999):
        c = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        if c and max(c.values()) > 1:
            longest = n
    return len(w), len(covered), longest


def test_repetition(docs, messy, none, rows):
    got = {r.doc_id: r for r in repetition.repetition(docs).collect()}
    assert len(got) == len({r["doc_id"] for r in rows})
    for r in rows:
        t, g = r["text"] or "", got[r["doc_id"]]
        n, covered, longest = brute_repetition(t)
        assert (g.n_words, g.n_repeat_words) == (n, covered), r["doc_id"]
        assert g.longest_repeat >= longest and (g.longest_repeat > 100) == (longest > 100)
        assert sum(s.end - s.start for s in g.spans) == covered
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert g.n_dup_lines == len(lines) - len(set(lines))
        assert g.word_chars == sum(c not in " \t\n\x0b\x0c\r" for c in t) and g.n_symbols == sum(c in "#*$%&|<>" for c in t)
        failed = n < 10 or 100 * covered > 20 * n
        assert g.base_failed == failed and g.kept == (not failed and g.longest_repeat <= 100)
    assert repetition.repetition(messy).count() == messy.count()
    assert repetition.repetition(none).count() == 0


def test_longest_repeats_random():
    rng = random.Random(3)
    for _ in range(30):
        docs = [[rng.randrange(3) for _ in range(rng.randrange(0, 40))] for _ in range(4)]
        ids = np.array([x for d in docs for x in d], np.int64)
        doc = np.array([k for k, d in enumerate(docs) for _ in d], np.int64)
        want = []
        for d in docs:
            for i in range(len(d)):
                best = 0
                for j in range(len(d)):
                    n = 0
                    while i != j and max(i, j) + n < len(d) and d[i + n] == d[j + n]:
                        n += 1
                    best = max(best, n)
                want.append(best if best >= 3 else 0)
        assert repetition.longest_repeats(ids, doc, 3).tolist() == want


def brute_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components_of(fp, radius):
    parent = {i: i for i in fp}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fp)
    for a in ids:
        for b in ids:
            if b > a and bin(fp[a] ^ fp[b]).count("1") <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash(spark, docs, messy, none, rows):
    got = simhash.near_duplicates(docs).withColumn("hex", simhash.hex_fingerprint()).collect()
    fp = {r["doc_id"]: brute_fingerprint(r["text"]) for r in rows}
    want = components_of(fp, 2)
    assert len(got) == len(rows)
    for g in got:
        assert (int(g.hex, 16), g.component_id) == (fp[g.doc_id], want[g.doc_id])
    assert simhash.near_duplicates(messy).count() == messy.count()
    assert simhash.near_duplicates(none).count() == 0
    with pytest.raises(ValueError):
        simhash.links(spark.range(1).toDF("fp"), 3)


def test_simhash_chains(spark):
    rng = random.Random(5)
    fp, at = {}, rng.getrandbits(64)
    for i in rng.sample(range(1000), 120):
        at = rng.getrandbits(64) if rng.random() < 0.1 else at ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        fp[i] = at
    df = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in fp.items()], "doc_id long, fp long")
    assert {r.doc_id: r.component_id for r in simhash.components(df).collect()} == components_of(fp, 2)


def targets(sizes, weights=(5, 2, 1)):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    t, free, rest = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        level = rest / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] > 2 * sizes[s]}
        if not full:
            t |= {s: level * w[s] for s in free}
            break
        for s in full:
            t[s] = 2.0 * sizes[s]
        free -= full
        rest = 1.5 * sum(sizes.values()) - sum(t.values())
    return t


def test_mixing(docs, messy, none, rows):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(words(r["text"]))
    want, taken = targets(dict(sizes)), Counter()
    assert len(got) == len(rows)
    for g in got:
        assert g.source_size == sizes[g.source] and g.target == pytest.approx(want[g.source]) and g.taken in (0, g.size, 2 * g.size)
        taken[g.source] += g.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * max((g.size for g in got if g.source == s))
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(messy).count() == messy.count() and mixing.mix(none).count() == 0
    out = mixing.emit(messy)
    assert out.columns == messy.columns and out.count() == mixing.mix(messy).agg(F.sum("copies")).first()[0]


def test_packing(docs, messy, none, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    pieces = packing.pack(docs, TOKENIZER, window=256).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for r in rows:
        want = t.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        ps = sorted(by_doc[r["doc_id"]], key=lambda p: p.start)
        if r["doc_id"] == 9010:
            assert sum(p.length for p in ps) == 2 * len(want)
            continue
        assert [i for p in ps for i in np.frombuffer(p.ids, "<u4").tolist()] == want and {p.doc_tokens for p in ps} == {len(want)}
    full = 0
    share = Counter()
    for s, ps in by_seq.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        full += at == 256
    assert full >= len(by_seq) - 1 and sorted(by_seq) == list(range(len(by_seq)))
    source = {r["doc_id"]: r["source"] for r in rows}
    total = Counter()
    for p in pieces:
        total[source[p.doc_id]] += p.length
        if p.sequence_id == 3:
            share[source[p.doc_id]] += p.length
    n = sum(total.values())
    assert all(abs(share[s] - 256 * total[s] / n) <= 2 for s in total)
    assert packing.pack(messy, TOKENIZER).count() > 0 and packing.pack(none, TOKENIZER).count() == 0


def windows(pieces, docs):
    """Tokens of each source in each full window, in order, and of each source in all."""
    by = pieces.join(docs.select("doc_id", "source"), "doc_id").groupBy("sequence_id", "source").agg(F.sum("length").alias("n")).collect()
    out, total = defaultdict(Counter), Counter()
    for r in by:
        out[r.sequence_id][r.source] += r.n
        total[r.source] += r.n
    return [out[k] for k in sorted(out) if sum(out[k].values()) == 2048], total


def test_packing_query_holds_shares_in_every_window(spark):
    sf = "/root/testdata/sf0.01"
    full, total = windows(queries.op10_mixture_packing(spark, sf), spark.read.parquet(f"{sf}/documents.parquet"))
    n = sum(total.values())
    assert len(full) > 400 and all(abs(w[s] - 2048 * total[s] / n) <= 2 for w in full for s in total)


def test_packing_query_holds_weights(spark):
    """Until a queue is used up, every window has each source at its target weight, at most two tokens off."""
    sf = "/root/testdata/sf0.01"
    full, total = windows(queries.packing_to_weights(spark, sf), spark.read.parquet(f"{sf}/documents.parquet"))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(total))}
    rate = 2048 / sum(weight.values())
    first_end = int(min(total[s] / (weight[s] * rate) for s in total))
    assert first_end > 20 and all(abs(w[s] - weight[s] * rate) <= 2 for w in full[: first_end - 1] for s in total)
    assert any(abs(w[s] - weight[s] * rate) > 2 for w in full[first_end + 1 :] for s in total)


def test_token_order():
    n = np.array([1.0, 7.0, 30.0, 2.0])
    key = sorted(((x + 0.5) / n[s], s, x) for s in range(4) for x in range(int(n[s])))
    for place, (_, s, x) in enumerate(key):
        assert packing.places(np.array([s]), np.array([x]), n)[0] == place
    for upto in range(41):
        assert packing.first_tokens(np.array([upto]), n)[0].tolist() == [sum(k[1] == s for k in key[:upto]) for s in range(4)]


def test_language(spark, messy, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op1_language_mixture(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = got.count(), got.where("lang = lang_pred").count()
    assert n > 100 and right / n > 0.95
    out = {r.doc_id: r for r in language.identify(messy, train=F.lit(True)).collect()}
    assert out[9001].lang_pred == out[9002].lang_pred == out[9004].lang_pred == "und" and out[9005].lang_pred != "und"
    assert language.identify(none, train=F.lit(True)).count() == 0
    assert {r.lang_pred for r in language.identify(messy, train=F.lit(False)).collect()} == {"und"}


def test_language_mixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    en = docs.where("lang = 'en' AND n_chars BETWEEN 1500 AND 4000").first().text
    fr = docs.where("lang = 'fr' AND n_chars BETWEEN 1500 AND 4000").first().text
    both = spark.createDataFrame([(1, en[:1400] + "\n" + fr[:900])], "doc_id long, text string")
    table = docs.select("doc_id", "text", "lang").unionByName(both.select((F.col("doc_id") - 5).alias("doc_id"), "text", F.lit(None).cast("string").alias("lang")))
    r = language.identify(table, train=F.lit(True)).where("doc_id = -4").first()
    assert {x.lang for x in r.languages} == {"en", "fr"} and 0.5 < r.score < 0.75


def test_toxicity(spark, messy, none):
    sf = "/root/testdata/sf0.1"
    got = queries.op5_toxicity_mil(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("toxic", "predicted", "score").toPandas()
    hit = (got.predicted == 1) & (got.toxic == 1)
    assert len(got) > 300 and hit.sum() / (got.toxic == 1).sum() > 0.8 and hit.sum() / (got.predicted == 1).sum() > 0.7
    labels = spark.createDataFrame([(9010, 1), (9005, 0), (None, 1), (9007, None)], "doc_id long, label int")
    model = toxicity.fit(messy, labels)
    assert toxicity.score(messy, model).count() == messy.count() and toxicity.score(none, model).count() == 0
    assert {r.score for r in toxicity.score(messy, None).collect()} == {0.0}


def test_toxicity_sentences():
    m = toxicity.Model(["idiot"], np.array([6.0]), -4.0)
    s, bad = m.score("All is well. You idiot! Fine.", 0.3)
    assert [(b["start"], b["end"]) for b in bad] == [(12, 22)] and s > 0.8
    assert m.score("", 0.3)[0] == pytest.approx(1 / (1 + np.exp(4.0)))
