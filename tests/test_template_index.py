"""Clusters that are kept between runs against clusters of all messages at once."""

import random

import pytest
from pyspark.sql import functions as F

from siftline.operators import templates
from siftline.operators.template_index import TemplateIndex

KIND = "key long, fp long, label string, shard int, batch int"


def rows(some):
    return [(k, fp, "x", 7, 7) for k, fp in some]


def planted(seed=5):
    """Chains of fingerprints one to three bits apart, which single linkage joins over several steps; copies, strays, zeros and nulls."""
    r, out = random.Random(seed), []
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 6, 12])):
            out += [x] * r.choice([1, 1, 3])
            for bit in r.sample(range(64), r.randint(1, 3)):
                x ^= 1 << bit
    out = [x - (1 << 64) if x >> 63 else x for x in out] + [0, 0, None]
    r.shuffle(out)
    return list(enumerate(out))


def brute(some):
    some = [(k, fp) for k, fp in some if fp]
    label = {fp: fp for _, fp in some}
    changed = True
    while changed:
        changed = False
        for a in label:
            least = min(label[b] for b in label if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3)
            if least < label[a]:
                label[a], changed = least, True
    size = {x: sum(label[fp] == x for _, fp in some) for x in label.values()}
    return sorted((k, label[fp], size[label[fp]]) for k, fp in some if size[label[fp]] > 1)


def got(index):
    return sorted(tuple(r) for r in index.clusters().select("key", "label", "size").collect())


def test_batches_give_the_clusters_of_all(spark, tmp_path):
    some = planted()
    whole = spark.createDataFrame(rows(some), KIND)
    assert sorted(tuple(r) for r in templates.clusters(whole.select("key", "fp"), "key").select("key", "label", "size").collect()) == brute(some)
    index = TemplateIndex(spark, f"{tmp_path}/a", shards=3)
    assert got(index) == []
    for upto, part in [(30, some[:30]), (30, []), (50, some[30:50]), (len(some), some[50:])]:
        assert index.add(spark.createDataFrame(rows(part), KIND), "key")
        assert got(TemplateIndex(spark, f"{tmp_path}/a", shards=3)) == brute(some[:upto])
    index.compact()
    assert got(index) == brute(some)
    more = [(1000 + k, fp) for k, fp in planted(9)[:20]] + [(2000, some[0][1])]
    assert index.add(spark.createDataFrame(rows(more), KIND), "key")
    assert got(index) == brute(some + more)


def test_merges_follow_to_the_newest_label(spark, tmp_path):
    """Three clusters are joined by later bridges, the last of them to a smaller label each time."""
    a, b, c = 0b111111 << 40, 0b111111 << 30, 0b111111
    index = TemplateIndex(spark, f"{tmp_path}/m", shards=2)
    step = [[(1, a), (2, b), (3, c)], [(4, a | 0b111 << 30), (5, (0b111 << 40) | 0b111111 << 30), (6, (0b111 << 40) | (0b111 << 30))], [(7, 0b111 | 0b111111 << 30), (8, (0b111 << 30) | 0b111111)], [(9, 0b111 << 30 | 0b111)]]
    for i in range(len(step)):
        index.add(spark.createDataFrame(rows(step[i]), KIND), "key", f"b{i}")
        assert got(index) == brute(sum(step[: i + 1], []))
    assert not index.add(spark.createDataFrame(rows(step[0]), KIND), "key", "b0")
    assert got(index) == brute(sum(step, []))


def test_a_batch_writes_and_reads_its_own(spark, tmp_path):
    r = random.Random(1)
    index = TemplateIndex(spark, f"{tmp_path}/w", shards=64)
    index.add(spark.createDataFrame(rows([(i, r.getrandbits(62) + 1) for i in range(400)]), KIND), "key")
    first = index._read("labels").first()["fp"]
    index.add(spark.createDataFrame(rows([(500, first ^ 1), (501, first), (502, 12345)]), KIND), "key")
    per = {kind: index._read(kind).where("batch = 1").count() for kind in ("keys", "labels", "bands", "merged")}
    assert (per["keys"], per["labels"], per["bands"]) == (3, 2, 40) and per["merged"] <= 1
    one = spark.createDataFrame([(first,)], "fp long").withColumn("shard", index._shard("fp"))
    read = index._in_shards("labels", one)
    assert read.where(F.col("fp") == first).count() == 1
    assert all(f"shard={one.first()['shard']}/" in r.f for r in read.select(F.input_file_name().alias("f")).distinct().collect()) and read.count() < 40


def test_a_failed_batch_leaves_no_trace(spark, tmp_path):
    index = TemplateIndex(spark, f"{tmp_path}/f", shards=2)
    index.add(spark.createDataFrame(rows([(1, 3), (2, 1)]), KIND), "key")
    before = got(index)
    broken = TemplateIndex(spark, f"{tmp_path}/f", shards=2)
    broken._tables.marks = index._tables.marks
    broken._tables._fs = None
    with pytest.raises(AttributeError):
        broken.add(spark.createDataFrame(rows([(3, 2), (4, 7)]), KIND), "key")
    assert got(index) == before == [(1, 1, 2), (2, 1, 2)]
    index.add(spark.createDataFrame(rows([(5, 0xFFFF << 40)]), KIND), "key")
    assert got(index) == before
