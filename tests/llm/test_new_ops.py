"""Spelling variants, conversation repair and token counts against plain computations."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from siftline.llm import conversations, queries, spelling, token_counts

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


# Spelling variants


def one_edit(w, letters):
    out = {w[:i] + w[i + 1 :] for i in range(len(w))}
    out |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
    out |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
    return out - {w}


def brute_variants(n, ratio=10):
    letters, out = sorted(set("".join(n))), {}
    for w in n:
        near = [x for x in one_edit(w, letters) if x in n]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = [form, None, n[w], len(near), n[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(x) for w, x in out.items()}


def brute_words(rows):
    n = Counter()
    for r in rows:
        for raw in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def of(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_spelling_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = of(queries.op11_errata_trie(spark, SF))
    assert got == brute_variants(brute_words([r.asDict() for r in docs.collect()])) and sum(x[0] is not None for x in got.values()) > 5


def test_spelling_variants(spark):
    """All strings of three letters over an alphabet of three, so that skips, runs of one letter and light groups all meet; and forms of forms."""
    dense = {"".join(p): 1 + (zlib.crc32("".join(p).encode()) % 50) ** 2 for k in (1, 2, 3, 4) for p in itertools.product("abc", repeat=k) if zlib.crc32(("x" + "".join(p)).encode()) % 4}
    chain = {"wwwwwwwww": 1, "wwwwwwwwww": 10, "wwwwwwwwwww": 100, "wwwwwwwwwwww": 1000, "étranger": 20, "etranger": 2, "ztranger": 20, "strange": 2, "stranger": 19}
    for n in (dense, chain, {"only": 3}):
        got = of(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
        assert got == brute_variants(n)
    assert of(spelling.variants(spark.createDataFrame(list(chain.items()), "word string, n long")))["wwwwwwwww"][1] == "wwwwwwwwwwww"


def test_spelling_awkward_rows(spark, messy, none):
    assert of(spelling.group_spellings(messy)) == brute_variants(brute_words([r.asDict() for r in messy.collect()]))
    assert spelling.group_spellings(none).count() == 0


# Conversation repair


def brute_repair(rows):
    """``rows``: (role, fault) in order. Cheapest edits by dynamic programming over whole audits."""
    best = {"": (0, "")}  # roles' initials so far, as a state of the grammar
    state_of = lambda x: {"": 0, "s": 1}.get(x, 2 if x[-1:] == "u" else 3)
    legal = lambda x: re.fullmatch("s?(ua)*u?", x) is not None

    def inserted(best):
        for _ in range(4):
            for x, (c, a) in list(best.items()):
                for r in "ua":
                    if legal(x + r):
                        key = short(x + r)
                        best[key] = min(best.get(key, (10**9, "")), (c + 2, a + "I"))
        return best

    short = lambda x: ("", "s", "u", "ua")[state_of(x)]
    for role, fault in rows:
        new = {}
        for x, (c, a) in inserted(best).items():
            options = [(x, c + 3, a + "D")]
            if fault in ("", "truncated"):
                t = fault == "truncated"
                options += [(x + r, c + 2 + t, a + "R") for r in "ua" if legal(x + r)] + [(x + role[:1], c + t, a + "K")] * legal(x + role[:1])
            for y, cost, audit in options:
                new[short(y)] = min(new.get(short(y), (10**9, "")), (cost, audit))
        best = new
    best = inserted(best)
    return min(best[x] for x in ("", "ua") if x in best)


def brute_conversations(rows):
    conv = {}
    for r in rows:
        c, t = r["conv_id"], r["turn"]
        kept = conv.setdefault(c, [])
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if r["role"] is None else r["role"], " " if r["text"] is None else r["text"]
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        kept += [(t is not None, t or 0, "user" if h == 4 else role, text)] * (h != 0) * (1 + (h == 3))
    out = {}
    for c, kept in conv.items():
        kept.sort()
        seen, faults = set(), []
        for _, _, role, text in kept:
            bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for known, t, _, _ in kept if known}
        cost, audit = brute_repair([(k[2], f) for k, f in zip(kept, faults)])
        lines, x, i = [], "", 0
        for edit in audit:
            if edit != "D":
                role = kept[i][2] if edit == "K" else "assistant" if x[-1:] == "u" else "user"
                x += role[:1]
                lines.append(f"{role}:{'' if edit == 'I' else kept[i][3]}")
            i += edit != "I"
        assert re.fullmatch("(s?(ua)+)?", x)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(rows):
    got = conversations.summary(conversations.damage(rows), rows).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


def test_conversation_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, sf).collect()}
    assert got == brute_conversations(rows) and len({x[6] for x in got.values()}) > 20


ODD = [
    (1, None, "user", "Hi."), (1, 3, None, "What?"), (1, 7, "assistant", None), (1, 7, "assistant", "Yes"), (2, 0, "", "None."), (2, 1, "user", "A."), (2, 2, "", "B."), (2, 3, "agent", "C. \n"),
    (None, 0, "user", "null id"), (None, 1, "assistant", "Fine!"), (None, None, "user", "Fine!"), (3, 0, "system", "S."), (4, 5, "user", "\t\n "), (5, 0, "user", "x." * 100_000), (5, 1, "tool", "Ω?"), (5, 1, "tool", "Ω?"),
]


def awkward(spark):
    long = [(9, t, ("user", "assistant", "system", "assistant", "tool", "user")[zlib.crc32(b"%d" % t) % 6], f"t{t % 97}" + ".!? "[t % 4]) for t in range(900)]
    return spark.createDataFrame([(*r, "clash", 1) for r in ODD + long + [(20 + k, t, "assistant", "Same.") for k in range(40) for t in range(3)]], "conv_id long, turn long, role string, text string, seg string, uid int")


@pytest.mark.parametrize("rows", [512, 40, 7, 1])
def test_conversation_segments(spark, rows):
    """Segments of any size join to what whole conversations give."""
    d = awkward(spark)
    want = brute_conversations([r.asDict() for r in d.collect()])
    judged = conversations._judged(conversations.damage(d)).orderBy(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "uid").collect()
    by = {}
    for r in judged:
        by.setdefault(r.conv_id, []).append((r.conv_id, r.turn, r.role, r.text, r.initial, r.fault))
    for c, group in by.items():
        parts = [conversations._segment(group[i : i + rows], i, True) for i in range(0, len(group), rows)]
        joined = conversations._join([p | {"first_initial": p["initials"][0], "last_initial": p["initials"][-1]} for p in parts])
        x = joined[0]
        assert (x["gaps"], x["blank"], x["duplicate"], x["truncated"], x["illegal"], x["cost"], "".join(j["audit"] for j in joined)) == want[c][:7]


def test_conversations_awkward_rows(spark):
    d = awkward(spark)
    want = brute_conversations([r.asDict() for r in d.collect()])
    assert repaired(d) == want
    assert repaired(d.repartition(7)) == want
    assert repaired(d.where("conv_id < 0")) == {}
    fixed = conversations.turns(conversations.repair(conversations.damage(d)))
    assert fixed.where("conv_id = 1").count() == sum(x != "D" for x in want[1][6])


def test_search_takes_the_least_audit():
    assert conversations.search("ua") == {3: (0, "KK")}
    assert conversations.search("") == {0: (0, "")}
    assert conversations.search("d") == {0: (3, "D")}
    assert conversations.search("u") == {3: (2, "KI")}
    assert conversations.search("UA") == {3: (2, "KK")}
    assert conversations.search("s") == {0: (3, "D")}


# Token counts


def library_counts(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


SPECIAL = ["<|endoftext|>", "a<|endoftext|>b <|ENDOFTEXT|>.", "<|startoftext|> <|EndOfText|>!", "don't DON'T x.'s", "e\ń", "  two  spaces\x0b\x1c\x85 x ", "İstanbul ΑΣ", "日本 語テキスト"]


def test_token_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op13_token_counts(spark, SF).collect()}
    want = library_counts([r.text for r in docs])
    assert got == {r.doc_id: (len((r.text or "").encode()), n, n > 2048) for r, n in zip(docs, want)} and any(x[2] for x in got.values())


def test_token_cache(spark, messy, none, tmp_path):
    extra = spark.createDataFrame([(7000 + i, t) for i, t in enumerate(SPECIAL)], "doc_id long, text string")
    both = messy.select("doc_id", "text").unionByName(extra).withColumn("digest", F.lit("clash")).withColumn("n_tokens", F.lit("clash"))
    cache = str(tmp_path / "cache")
    given = both.collect()
    n = library_counts([r.text for r in given])
    want = Counter((r.doc_id, len((r.text or "").encode()), k, k > 2048) for r, k in zip(given, n))
    stored = lambda: token_counts.read_cache(spark, cache, token_counts.version(WORDS)).count()
    assert token_counts.count_tokens(none, WORDS, cache).count() == 0
    assert token_counts.count_tokens(both.where("doc_id < 9000"), WORDS, cache).count() == both.where("doc_id < 9000").count()
    first = stored()
    for _ in range(2):
        assert Counter(tuple(r) for r in token_counts.count_tokens(both, WORDS, cache).collect()) == want
    assert first < stored() <= len({r.text for r in given})


def test_token_cache_is_read(spark, tmp_path):
    """Stored counts are believed, only misses are encoded, and another tokenizer doesn't see them."""
    d = spark.createDataFrame([(1, "one two"), (2, "One   TWO"), (3, "three")], "doc_id long, text string")
    cache, of = str(tmp_path / "cache"), token_counts.version(WORDS)
    counter = token_counts.Counter(WORDS)
    assert counter.fold and counter.squeeze
    import hashlib as h

    key = h.blake2b(counter.normalise(b"one two"), digest_size=16).digest()
    spark.createDataFrame([(key, 77)] * 2, token_counts.CACHE).write.parquet(f"{cache}/version={of}")
    assert sorted((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(d, WORDS, cache).collect()) == [(1, 77), (2, 77), (3, 1)]
    piece = public_tokenizers.path("piece_bpe_32k.model")
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=piece)
    texts = [*SPECIAL, "one two", "One   TWO", "", "a\nb"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_tokens for r in token_counts.count_tokens(rows, piece, cache).orderBy("doc_id").collect()] == [len(model.encode(t)) for t in texts]
    with pytest.raises(ValueError):
        token_counts.Counter("x.txt")


def test_counts_with_a_warm_cache(spark, tmp_path):
    """A few missing texts are found by a broadcast."""
    docs, cache = spark.read.parquet(f"{SF}/documents.parquet"), str(tmp_path / "cache")
    assert token_counts.count_tokens(docs.where("doc_id % 20 > 0"), WORDS, cache).count() > 100
    rows = docs.collect()
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, WORDS, cache).collect()}
    assert got == dict(zip([r.doc_id for r in rows], library_counts([r.text for r in rows])))
