"""Workbooks, read back by a plain XML reader."""

import io
import re
import zipfile
from xml.etree import ElementTree

from test_fixtures import MAILS

from siftline.plans import report
from siftline.plans.store import Store
from siftline.sources import tables, workbook

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def read(data):
    """``{sheet: rows}`` of text, numbers, or None; every part is named in the types and linked."""
    with zipfile.ZipFile(data) as z:
        assert z.testzip() is None
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        known = set(re.findall('PartName="/([^"]*)"', z.read("[Content_Types].xml").decode()))
        out = {}
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{NS}sheet"):
            path = "xl/" + links[s.get(REL)]
            assert path in known
            cells = lambda r: [int(c[0].text) if len(c) and c[0].tag == f"{NS}v" else c[0][0].text if len(c) else None for c in r]
            out[s.get("name")] = [cells(r) for r in ElementTree.fromstring(z.read(path)).iter(f"{NS}row")]
        return out


def test_cells():
    out = io.BytesIO()
    rows = [("=1+1", 5, True, None, ""), (" <a&b> ", -(10**14), 10**15, "line\nnext\r\n", "x\x00\x0by\ufffe"), ("z" * 40_000, 0, "🙂ｆｕ\ue000", "]]>", '"')]
    assert workbook.write([("A & \"B\"", list("abcde"), iter(rows)), ("none", ["x"], iter([]))], out) == ['A & "B"', "none"]
    got = read(out)
    assert got["none"] == [["x"]] and got['A & "B"'][0] == list("abcde")
    assert got['A & "B"'][1:] == [["=1+1", 5, "True", None, None], [" <a&b> ", -(10**14), str(10**15), "line\nnext\r\n", "xy"], ["z" * 32_767, 0, "🙂ｆｕ\ue000", "]]>", '"']]


def test_long_sheets_go_on():
    out = io.BytesIO()
    names = workbook.write([("n" * 40, ["i"], ([i] for i in range(9))), ("full", ["i"], ([i] for i in range(3)))], out, most_rows=4)
    assert names == ["n" * 31, "n" * 27 + " (2)", "n" * 27 + " (3)", "full"]
    got = read(out)
    assert [r[0] for n in names[:3] for r in got[n][1:]] == list(range(9)) and all(got[n][0] == ["i"] for n in names)


def test_store(spark, tmp_path):
    """The 19 sheets, cell by cell those of the tables."""
    (tmp_path / "in").mkdir()
    for n in sorted(MAILS):
        (tmp_path / "in" / f"{n}.eml").write_bytes(MAILS[n])
    store = Store(spark, f"file://{tmp_path}/store")
    store.ingest(f"file://{tmp_path}/in")
    with open(tmp_path / "out.xlsx", "wb") as f:
        assert store.workbook(f) == list(report.SHEETS)
    got = read(tmp_path / "out.xlsx")
    assert {n: rows[0] for n, rows in got.items()} == report.SHEETS
    want = {}
    m = store.messages()
    some = ("Emails", "Domain Clusters", "Phone Numbers", "Images", "Trends", "Triage Queue")
    for name, (df, order) in report.sheets(m, store.dims()).items():
        if name in some:
            keys = [report.F.desc(c[1:]) if c.startswith("-") else report.F.col(c) for c in order]
            want[name] = [[x or None for x in r] for r in tables.flat(df.orderBy(*keys).select(*report.SHEETS[name])).collect()]
    for name in some:
        text = [[None if x is None else str(x) for x in r] for r in got[name][1:]]
        assert text == want[name] and text
    assert isinstance(got["Domain Clusters"][1][1], int) and len(got["Emails"]) == len(MAILS)
