"""Files of the input: numbers of writers, and the archive of files that were read.

All of it goes through Hadoop's file systems on the driver, and moves names, not rows.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def claim_run(spark: SparkSession, table: str) -> int:
    """A number that no other writer of ``table`` has or will have; the next one, kept as an empty file ``_runs/N``."""
    fs, where = _at(spark, f"{table}/_runs")
    fs.mkdirs(where)
    n = max([int(s.getPath().getName()) + 1 for s in fs.listStatus(where) if s.getPath().getName().isdigit()], default=0)
    while True:
        place = _at(spark, f"{table}/_runs/{n}")[1]
        try:
            fs.create(place, False).close()  # fails if another writer was first
            return n
        except Exception:
            if not fs.exists(place):
                raise
            n += 1


def read_number(spark: SparkSession, path: str) -> int | None:
    """The number that a small file holds; none without the file."""
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return None
    source = fs.open(where)
    try:
        return int(bytes(source.readNBytes(32)).decode())
    finally:
        source.close()


def write_number(spark: SparkSession, path: str, number: int) -> None:
    fs, where = _at(spark, path)
    out = fs.create(where, True)
    out.writeBytes(str(number))
    out.close()


def mail_files(spark: SparkSession, root: str) -> list[str]:
    """Mails and mailboxes below a folder, in the order of their names."""
    fs, where = _at(spark, root)
    found, names = fs.listFiles(where, True), []
    while found.hasNext():
        names.append(found.next().getPath().toString())
    return sorted(n for n in names if n.lower().endswith((".eml", ".mbox")))


def free_name(exists, base: str, suffix: str, first: int) -> str:
    """``base + suffix``, or with ``_N`` between them, where N counts from ``first``, if that is taken."""
    name, n = base + suffix, first
    while exists(name):
        name, n = f"{base}_{n}{suffix}", n + 1
    return name


def batches(spark: SparkSession, table: str) -> list[tuple[int, int]]:
    """``(run, batch)`` of the finished batches of a message table, in order."""
    fs, pattern = _at(spark, f"{table}/run=*/batch=*/_SUCCESS")
    found = [x.getPath().getParent() for x in fs.globStatus(pattern) or []]
    return sorted((int(p.getParent().getName()[4:]), int(p.getName()[6:])) for p in found)


def archive(spark: SparkSession, paths: list[str], root: str, scanned: str, day: str) -> list[str]:
    """Move files of ``root`` to the same place below ``scanned/day``; a taken name gets ``_1``, ``_2`` and so on."""
    moved = []
    for path in paths:
        fs, source = _at(spark, path)
        below = path.rpartition("/" + root.rstrip("/").rpartition("/")[2] + "/")[2]
        stem, dot, kind = below.rpartition(".")
        to = free_name(lambda x: fs.exists(_at(spark, x)[1]), f"{scanned.rstrip('/')}/{day}/{stem if dot else below}", dot + kind if dot else "", 1)
        target = _at(spark, to)[1]
        fs.mkdirs(target.getParent())
        if not fs.rename(source, target):
            raise OSError(f"can't move {path} to {to}")
        moved.append(to)
    return moved


def zip_days(spark: SparkSession, scanned: str) -> list[str]:
    """Replace each folder of a day below ``scanned`` by a zip file of it, ``_2`` and so on where that name is taken."""
    fs, top = _at(spark, scanned)
    jvm, made = spark.sparkContext._jvm, []
    if not fs.exists(top):
        return made
    for status in sorted(fs.listStatus(top), key=lambda s: s.getPath().getName()):
        folder = status.getPath()
        if not status.isDirectory() or not _DAY.fullmatch(folder.getName()):
            continue
        to = free_name(lambda x: fs.exists(_at(spark, x)[1]), f"{scanned.rstrip('/')}/{folder.getName()}", ".zip", 2)
        out = jvm.java.util.zip.ZipOutputStream(fs.create(_at(spark, to)[1]))
        base = len(fs.makeQualified(top).toString()) + 1
        found = fs.listFiles(folder, True)
        while found.hasNext():
            path = found.next().getPath()
            out.putNextEntry(jvm.java.util.zip.ZipEntry(path.toString()[base:]))
            source = fs.open(path)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
            source.close()
            out.closeEntry()
        out.close()
        fs.delete(folder, True)
        made.append(to)
    return made
