"""Spelling variants: words one edit apart, found by merging the light subtrees of the words' trie.

The trie is a table of prefixes.  At each prefix the character below which most
words lie leads on along the heavy path (ties: the larger character); the other
children are light, and so is a word that ends there.  Words of light subtrees
are merged once with the character after the prefix skipped or replaced, as an
errata trie does, always the small part into the large:

* replaced by the heavy character, skipped, or with the heavy character put in
  before it, a word is looked up among all words;
* replaced by any, the light words of one prefix meet on what follows.  At most
  one comes from each child, so such a group is no larger than the alphabet, and
  each of its words gets the group's size and its most frequent other word; no
  pairs are made.

Two words one edit apart part at one prefix, and one of them is light there, so
each pair is found exactly once.  A word is light at no more prefixes than the
binary logarithm of the number of words, so lookups grow by that factor, not by
the length of words.  All of it is joins and sums; prefixes of up to two
characters, which all words share, are a table of at most 8,191 rows (an alphabet
of 90) and are broadcast.

A word's form is its most frequent near word, if that is ``ratio`` times as
frequent as itself; forms of forms are followed by pointer jumping.

Defined results: a null text has no words, a null id is written as nothing in
the hash; rows that repeat an id or a text count each; a text is read whole; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators.scratch import drop

from .common import materialise, sliced

#: Letters of a word; A-Z are lower-cased, which leaves 90 characters.
LETTERS = "[A-Za-zÀ-ÿ]"
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Words that a counting task holds before it gives them out.
HELD = 200_000
#: Prefixes of up to this length are broadcast.
SHALLOW = 2


def misspelt(word: str, seed: int, every: int = 31) -> str:
    """``word``, or where ``every`` divides its CRC-32, begun from ``seed``, without the character that the CRC-32 names."""
    h = zlib.crc32(word.encode(), seed)
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def count_words(docs: DataFrame, least: int = 7, every: int | None = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)``: words of at least ``least`` characters; with ``every``, some are misspelt on purpose, see :func:`misspelt`."""
    run_of = re.compile(f"{LETTERS}{{{least},}}")
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, int] = {}

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], schema=schema)

        for b in sliced(batches):
            for doc, text in zip(b.column("doc").to_pylist(), b.column("text").to_pylist()):
                seed = zlib.crc32(f"{doc}:".encode())
                for word, n in Counter(run_of.findall(text or "")).items():
                    word = word.lower() if word.isascii() else word.translate(_LOWER)
                    if every:
                        word = misspelt(word, seed, every)
                        if len(word) < least:
                            continue
                    found[word] = found.get(word, 0) + n
                if len(found) >= HELD:
                    yield given()
                    found.clear()
        if found:
            yield given()

    ids = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    counted = docs.select(ids.alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _rest(start: Column) -> Column:
    """The word from its character ``start`` on, counted from 1."""
    return F.substring("word", start, F.length("word"))


def light_words(words: DataFrame) -> DataFrame:
    """``(word, n, prefix, c, heavy)``: each word at each prefix where it is light; ``c`` is its next character, or null where it ends."""
    at = F.col("at")
    steps = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("at"))
    steps = steps.select("word", "n", F.substring("word", F.lit(1), at).alias("prefix"), F.substring("word", at + 1, F.lit(1)).alias("c"))
    below = steps.groupBy("prefix", "c").agg(F.count(F.lit(1)).alias("below"))
    heavy = materialise(below.groupBy("prefix").agg(F.max(F.struct("below", "c")).alias("m"), F.count(F.lit(1)).alias("children")).select("prefix", F.col("m.c").alias("heavy"), "children"), "heavy")
    branching = heavy.where("children > 1").select("prefix", "heavy")
    shallow, deep = branching.where(F.length("prefix") <= SHALLOW), branching.where(F.length("prefix") > SHALLOW)
    near = steps.where(F.length("prefix") <= SHALLOW).join(F.broadcast(shallow), "prefix").unionByName(steps.where(F.length("prefix") > SHALLOW).join(deep, "prefix"))
    ends = words.join(heavy.select(F.col("prefix").alias("word"), "heavy"), "word").select("word", "n", F.col("word").alias("prefix"), F.lit(None).cast("string").alias("c"), "heavy")
    return near.where("c <> heavy").select("word", "n", "prefix", "c", "heavy").unionByName(ends)


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n_near, best_n, best)``: for words with a near word, how many there are, and the most frequent (ties: the smallest)."""
    light = materialise(light_words(words), "light")
    depth, c = F.length("prefix"), F.col("c")
    rest = _rest(depth + 2)
    following = F.substring("word", depth + 2, F.lit(1))
    lookups = F.array_compact(
        F.array(
            F.when(c.isNotNull(), F.concat("prefix", "heavy", rest)),
            F.when(c.isNotNull() & (following != c), F.concat("prefix", rest)),
            F.concat("prefix", "heavy", _rest(depth + 1)),
        )
    )
    asked = light.select("word", "n", F.explode(lookups).alias("other"))
    links = materialise(asked.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other"), "links")
    one = F.lit(1).cast("long").alias("near")
    there = links.select("word", one, F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")).alias("best"))
    back = links.select(F.col("other").alias("word"), one, F.struct((-F.col("n")).alias("n"), F.col("word").alias("word")).alias("best"))
    group = light.where(c.isNotNull()).groupBy("prefix", rest.alias("rest")).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))).alias("all"))  # one from each light child at most
    group = group.where(F.size("all") > 1).select("all", F.posexplode("all").alias("at", "one"))
    others = F.when(F.col("at") == 0, F.get("all", F.lit(1))).otherwise(F.get("all", F.lit(0)))
    merged = group.select(F.col("one.word").alias("word"), (F.size("all") - 1).cast("long").alias("near"), others.alias("best"))
    every = there.unionByName(back).unionByName(merged)
    return every.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``(word, form)``: the last form on the way; each round doubles the steps, and no way is a circle as forms are more frequent than their words."""
    f = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        g = f.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = materialise(f.join(g, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = new.where("moved").limit(1).count()
        drop(f)
        f = new.select("word", "root")
        f.copied_to = new.copied_to
        if not moved:
            return f


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for each row of ``words(word, n)``, whose words are distinct."""
    words = materialise(words, "words")
    near = near_words(words).withColumnRenamed("word", "_w")
    is_form = F.col("best_n") >= F.col("n") * ratio
    d = words.join(near, F.col("word") == F.col("_w"), "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    d = materialise(d, "forms")
    r = roots(d.where("form IS NOT NULL").select("word", "form")).withColumnRenamed("word", "_w")
    return d.join(r, F.col("word") == F.col("_w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_spellings(docs: DataFrame, least: int = 7, occurrences: int = 2, ratio: int = 10, every: int | None = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`variants` of the words of ``docs`` that occur ``occurrences`` times or more."""
    return variants(count_words(docs, least, every, id_col, text_col).where(F.col("n") >= occurrences), ratio)
