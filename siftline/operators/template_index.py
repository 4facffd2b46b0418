"""Template clusters that are kept between runs: a batch of mail costs what its own new fingerprints cost.

Four tables, a folder of each per batch: ``keys(key, fp)`` of all messages;
``labels(fp, label)`` and ``bands(fp, choice, bits)`` of distinct fingerprints,
in ``shards`` folders by a hash, so that a batch reads the folders its own
values fall into; and ``merged(label, into)``, the labels that later batches
joined to a smaller one.  A label is the smallest fingerprint of its cluster.

A batch looks up its new fingerprints in the bands of the old ones.  Its links,
with each old fingerprint replaced by its label, are a graph of new
fingerprints and touched labels only; the components of that graph are the new
labels and the merges.  No row of an old cluster is written anew: a label that
is joined to another gets a row in ``merged``, as do the labels that were
joined to it before, so that one lookup always finds the newest label.

Batches are written and counted as :mod:`siftline.operators.batches` says.

Defined results: fingerprint zero or null takes no part; a null key is a message
like any other; a key that is added twice counts twice, unless its batch has a
name that was added before, which is skipped; an empty batch changes nothing;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.batches import BatchTables
from siftline.operators.graph import connected_components
from siftline.operators.scratch import drop, saved
from siftline.operators.templates import dealt, near, similar

KINDS = {"keys": "{key}, fp long", "labels": "fp long, label long, shard int", "bands": "fp long, choice int, bits long, shard int", "merged": "label long, into long"}


class TemplateIndex:
    """The index in ``folder``; ``key`` is the type of its keys, ``shards`` stays what it was at the first batch."""

    def __init__(self, spark: SparkSession, folder: str, distance: int = 3, shards: int = 16, key: str = "long"):
        self.spark, self.distance, self.shards, self.key = spark, distance, shards, key
        self._tables = BatchTables(spark, folder, {n: schema.format(key=f"key {key}") for n, schema in KINDS.items()})

    def add(self, fps: DataFrame, key: str, name: str | None = None) -> bool:
        """Add messages ``(key, fp)``; false if the batch ``name`` (letters and digits, as of a stream's batch) is there already."""
        at = self._tables.next(name)
        if at is None:
            return False
        messages = saved(fps.where("fp <> 0").select(F.col(key).cast(self.key).alias("key"), "fp"), "batch")
        mine = messages.select("fp").distinct().withColumn("shard", self._shard("fp"))
        new = saved(mine.join(self._in_shards("labels", mine).select("fp"), "fp", "left_anti"), "new")
        bands = saved(dealt(new, self.distance).withColumn("shard", self._shard("choice", "bits")), "bands")
        old = self._in_shards("bands", bands).select(F.col("fp").alias("old"), "choice", "bits")
        met = bands.select("fp", "choice", "bits").join(old, ["choice", "bits"]).where(near("fp", "old", self.distance)).select("fp", "old").distinct()
        met = saved(met.withColumn("shard", self._shard("old")), "met")
        label = self._newest(self._in_shards("labels", met).select(F.col("fp").alias("old"), "label"))
        touched = saved(met.join(label, "old").select("fp", "label").distinct(), "touched")
        edges = similar(new, self.distance).unionByName(touched.select(F.col("fp").alias("src"), F.col("label").alias("dst")))
        found = connected_components(edges).select(F.col("u").alias("fp"), F.col("label").alias("least"))
        labels = new.join(found, "fp", "left").select("fp", F.coalesce("least", "fp").alias("label"), "shard")
        joined = saved(touched.select("label").distinct().join(found.withColumnRenamed("fp", "label"), "label").where("label <> least").select("label", F.col("least").alias("into")), "joined")
        before = self._merged().select(F.col("label").alias("first"), F.col("into").alias("label")).join(joined, "label").select(F.col("first").alias("label"), "into")
        self._tables.write({"keys": messages, "labels": labels, "bands": bands, "merged": joined.unionByName(before)}, at, name)
        for copy in (messages, new, bands, met, touched, joined, found):
            drop(copy)
        return True

    def labels(self) -> DataFrame:
        """``(fp, label)`` of all distinct fingerprints."""
        return self._newest(self._read("labels").select("fp", "label"))

    def clusters(self) -> DataFrame:
        """``(key, label, size)`` of messages in groups of two or more, as :func:`siftline.operators.templates.clusters` gives of all messages at once."""
        d = self._read("keys").join(self.labels(), "fp").select("key", "label")
        return d.join(d.groupBy("label").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "label").select("key", "label", "size")

    def compact(self) -> None:
        """Write all batches as one, with their newest labels, and delete the folders of those before."""
        if self._tables.marks():
            labels = self.labels().withColumn("shard", self._shard("fp"))
            self._tables.fold({"keys": self._read("keys"), "labels": labels, "bands": self._read("bands"), "merged": self._read("merged").limit(0)})

    def _shard(self, *columns: str):
        return F.pmod(F.xxhash64(*columns), F.lit(self.shards)).cast("int")

    def _read(self, kind: str) -> DataFrame:
        return self._tables.read(kind)

    def _in_shards(self, kind: str, of: DataFrame) -> DataFrame:
        """The rows in the shards of ``of``: at most ``shards`` numbers reach the driver."""
        mine = [r["shard"] for r in of.select("shard").distinct().collect()]
        return self._read(kind).where(F.col("shard").isin(mine))

    def _merged(self) -> DataFrame:
        return self._read("merged").groupBy("label").agg(F.max_by("into", "batch").alias("into"))

    def _newest(self, labelled: DataFrame) -> DataFrame:
        other = [c for c in labelled.columns if c != "label"]
        return labelled.join(self._merged(), "label", "left").select(*other, F.coalesce("into", "label").alias("label"))
