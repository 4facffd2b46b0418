"""Tables that grow by batches, each batch in folders of its own.

A batch counts when its mark in ``done`` is written, last of all; folders of one
that failed are overwritten by the next.  One writer at a time.  A batch whose
name was added before is known by its mark, also after the batches were folded
into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class BatchTables:
    """``kinds``: the schema of each table in ``folder``; a table with a column ``shard`` has a folder for each of its values."""

    def __init__(self, spark: SparkSession, folder: str, kinds: dict[str, str]):
        self.spark, self.folder, self.kinds = spark, folder.rstrip("/"), kinds
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def marks(self) -> list[tuple[int, bool, str]]:
        """``(number, whether it holds all before, name)`` of finished batches, in order."""
        found = self._fs.globStatus(self._path(f"{self.folder}/done/*")) or []
        names = [x.getPath().getName() for x in found]
        return sorted((int(m.removesuffix(".all").partition("-")[0]), m.endswith(".all"), m.partition("-")[2]) for m in names)

    def next(self, name: str | None = None) -> int | None:
        """The number of the next batch; none if a batch ``name`` (letters and digits) is there already."""
        if name is not None and not name.isalnum():
            raise ValueError(f"not a batch name: {name}")
        marks = self.marks()
        if name is not None and any(m[2] == name for m in marks):
            return None
        return max((m[0] for m in marks), default=-1) + 1

    def read(self, kind: str) -> DataFrame:
        """All rows of a table, with ``batch``."""
        marks = self.marks()
        whole = max((n for n, every, _ in marks if every), default=0)
        paths = [f"{self.folder}/{kind}/batch={n}" for n, *_ in marks if n >= whole]
        schema = self.kinds[kind] + ", batch int"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{kind}").parquet(*paths)

    def write(self, tables: dict[str, DataFrame], at: int, name: str | None = None) -> None:
        self._write(tables, at, f"{at}-{name}" if name else f"{at}")

    def fold(self, tables: dict[str, DataFrame]) -> None:
        """Write ``tables``, which hold the rows of all batches, as one batch, and delete the folders of those before."""
        marks = self.marks()
        at = marks[-1][0] + 1
        self._write(tables, at, f"{at}.all")
        for n, *_ in marks:
            for kind in self.kinds:
                self._fs.delete(self._path(f"{self.folder}/{kind}/batch={n}"), True)

    def _write(self, tables: dict[str, DataFrame], at: int, mark: str) -> None:
        for kind, df in tables.items():
            df, path = df.drop("batch"), f"{self.folder}/{kind}/batch={at}"
            if "shard" in df.columns:
                df.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)
            else:
                df.write.mode("overwrite").parquet(path)
        self._fs.create(self._path(f"{self.folder}/done/{mark}"), False).close()
