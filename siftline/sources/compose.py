"""Mail composed from table rows, so that the parser reads texts and pages that lie in tables.

Header values in any script are written as encoded words and bodies as base64,
so what is put in is what a mail reader gets out, whatever its line ends.
Headers and bodies are built in the JVM; only the parser itself runs in Python.
A null body is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder under which the composed files seem to lie.
ROOT = "/composed"


def word(text: Column) -> Column:
    """An encoded word."""
    return F.concat(F.lit("=?utf-8?b?"), F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"\s", ""), F.lit("?="))


def mails(rows: DataFrame, name: Column, body: Column, kind: str = "text/plain", headers: dict[str, Column] | None = None) -> DataFrame:
    """``(path, content)`` as :func:`siftline.sources.mail.parse_files` reads them; ``name``: the path below ``ROOT`` without suffix; a null header is left out."""
    lines = [F.concat(F.lit(f"{k}: "), v, F.lit("\n")) for k, v in (headers or {}).items()]
    head = F.concat_ws("", *lines, F.lit(f"MIME-Version: 1.0\nContent-Type: {kind}; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"))
    text = F.base64(F.encode(F.coalesce(body, F.lit("")), "UTF-8"))
    return rows.select(F.concat(F.lit(f"{ROOT}/"), name, F.lit(".eml")).alias("path"), F.encode(F.concat(head, text), "UTF-8").alias("content"))


def key_of(path: Column) -> Column:
    """The last part of ``name`` in :func:`mails`."""
    return F.regexp_extract(path, r"([^/]*)\.eml$", 1)
