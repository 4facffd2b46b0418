"""Commands, and the frames behind charts and badges."""

import json

import pytest

from siftline.commands import main, parser
from siftline.operators import tableview

MAIL = b"From: a@x.example\nSubject: urgent\nDate: Mon, 01 Jan 2024 10:00:00 +0000\n\nbody\n"


def test_commands(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.eml").write_bytes(MAIL)
    store = f"file://{tmp_path}/store"
    run = lambda *a: main([store, *a], spark)
    assert run("ingest", str(tmp_path / "in")) == {"likely_scam": 1, "files": 1, "duplicates": 0, "unreadable": 0}
    run("log-action", "report", "domain", "x.example", "--date", "2024-01-02")
    run("mark-triage", "abc", "--notes", "n")
    assert [(r["target"], r["status"]) for r in run("log-action", "--list")] == [("x.example", "submitted")] and run("mark-triage", "--list")[0]["notes"] == "n"
    assert run("publish", str(tmp_path / "in"), str(tmp_path / "out.json"), "--skip-ingest", "--skip-lookups", "--sheets", f"file://{tmp_path}/sheets") == {"ingest": "skipped", "ips": "skipped", "domains": "skipped", "wallets": "skipped", "report": "done", "sheets": "done"}
    assert len([p for p in (tmp_path / "sheets").iterdir() if p.is_dir()]) == 19
    doc = json.loads((tmp_path / "out.json").read_text())
    assert doc["message_total"] == 1 and doc["actions"][0]["target"] == "x[.]example" and len(doc["triage_queue"]) == 1
    assert parser().parse_args([store, "domains"]).whois == parser().parse_args([store, "publish", "a", "b"]).whois == "siftline.sources.whois:record"
    with pytest.raises(SystemExit):
        parser().parse_args([store, "publish"])


def test_frames(spark):
    d = spark.createDataFrame([("a", 1, 2), ("b", 3, 0), ("c", 3, 1)], "name string, n int, m int")
    assert [tuple(r) for r in tableview.bars(d, "name", "n", 2).collect()] == [("b", 3), ("c", 3)]
    assert sorted(map(tuple, tableview.stacked(d.where("name = 'a'"), "name", ["n", "m"]).collect())) == [("a", "m", 2), ("a", "n", 1)]
    log = spark.createDataFrame([("2024-02-01", "second", "", "ok", "a"), ("2024-01-01", "first", "r", "ok", "a")], "date string, action string, reference string, status string, target string")
    got = {r.name: [x.action for x in r.acted] for r in tableview.actions_of(d, log, "name").collect()}
    assert got == {"a": ["first", "second"], "b": [], "c": []}
