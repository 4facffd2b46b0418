"""The port-43 client against servers of the test's own."""

import json
import socketserver
import threading
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siftline.plans import enrichment as E
from siftline.sources import whois
from siftline.sources.explorers import domain_client

REGISTRY = """   Domain Name: GOOD.EXAMPLE
   Registrar WHOIS Server: {registrar}
   Registrar: First Registrar, Inc.
   Creation Date: 2020-01-02T03:04:05Z
   Name Server: NS2.HOST.EXAMPLE
   Name Server: ns1.host.example
>>> Last update of whois database <<<
"""
REGISTRAR = """Registrar: Other Name
Creation Date: 2020-01-03
Registrant Organization: Good Ltd
Registrant Country: SE
Name Server: ns1.host.example
"""


class Handler(socketserver.StreamRequestHandler):
    def handle(self):
        query = self.rfile.readline().decode().strip()
        self.server.asked.append(query)
        answer = self.server.answers.get(query, self.server.answers.get("*", "No match for domain"))
        if answer is None:
            time.sleep(1.5)
            return
        self.wfile.write(answer.encode())


@pytest.fixture()
def serve():
    running = []

    def start(answers):
        server = socketserver.ThreadingTCPServer(("127.0.0.1", 0), Handler)
        server.answers, server.asked, server.daemon_threads = answers, [], True
        threading.Thread(target=server.serve_forever, daemon=True).start()
        running.append(server)
        return server, f"127.0.0.1:{server.server_address[1]}"

    yield start
    for server in running:
        server.shutdown()
        server.server_close()


def quick(server, query):
    return whois.ask(server, query, 0.5)


def test_referrals(serve):
    registrar, at = serve({"good.example": REGISTRAR})
    registry, there = serve({"good.example": REGISTRY.format(registrar=at), "alone.example": "Registrar: R\ncreated: 02-Jan-2019\n"})
    root, top = serve({"example": f"% note\ndomain: EXAMPLE\nrefer: {there}\n"})
    got = whois.record("Good.Example.", quick, top)
    assert got == {"creation_date": [datetime(2020, 1, 2, 0, 0), datetime(2020, 1, 3, 0, 0)], "registrar": ["First Registrar, Inc.", "Other Name"], "name_servers": ["NS2.HOST.EXAMPLE", "ns1.host.example"], "org": ["Good Ltd"], "country": ["SE"]}
    assert (root.asked, registry.asked, registrar.asked) == (["example"], ["good.example"], ["good.example"])
    assert whois.record("alone.example", quick, top)["creation_date"] == [datetime(2019, 1, 2)]
    registry.answers["loop.example"] = f"Registrar: R\nRegistrar WHOIS Server: {there}\n"
    assert whois.record("loop.example", quick, top)["registrar"] == ["R"] and registry.asked.count("loop.example") == 1


def test_failures(serve):
    silent, slow = serve({"*": None})
    registry, there = serve({"slow.example": REGISTRY.format(registrar=slow), "busy.example": "Query rate limit exceeded, try later\n", "big.example": "x" * (whois.MOST + 10)})
    _, top = serve({"example": f"refer: {there}", "quiet": f"refer: {slow}", "gone": "refer: 127.0.0.1:1", "*": "no such domain"})
    assert whois.record("slow.example", quick, top)["registrar"] == ["First Registrar, Inc."] and silent.asked == ["slow.example"]
    for domain, kind in [("a.quiet", TimeoutError), ("a.gone", ConnectionRefusedError), ("busy.example", ConnectionRefusedError), ("big.example", OSError), ("free.example", whois.NoMatch), ("a.nowhere", whois.NoMatch)]:
        with pytest.raises(kind):
            whois.record(domain, quick, top)
    for name in ("", "localhost", "a b.example", "a.example\r\nb"):
        with pytest.raises((ValueError, UnicodeError)):
            whois.record(name, quick, top)


def test_forms():
    text = "Domain name:\n  x.uk\n\nRegistrar:\n  Some Registrar [Tag = X]\n\nRegistered on: 02-Jan-2001\n\nName servers:\n  ns1.x.uk  1.2.3.4\n  ns2.x.uk\n\nnserver: a.b\n"
    got = whois.parsed(text)
    assert got["registrar"] == ["Some Registrar [Tag = X]"] and got["name_servers"] == ["ns1.x.uk", "ns2.x.uk", "a.b"] and got["creation_date"] == [datetime(2001, 1, 2)]
    assert whois.parsed("created: before 1996\n")["creation_date"] == ["before 1996"] and whois.parsed("") == {f: [] for f in whois.FIELDS}


def test_rows(spark):
    """From the client to the table: a record, a domain that is free, and one to be asked again."""

    def ask(server, query):
        if query == "late.example":
            raise TimeoutError("x")
        return {"example": "refer: r.example", "good.example": REGISTRY.format(registrar="")}.get(query, "No match for domain")

    client = domain_client(lambda domain: whois.record(domain, ask, "root.example"))
    answers = E.look_up(spark.createDataFrame([("good.example",), ("free.example",), ("late.example",)], "domain string").repartition(1), "domain", client, 1, 0).cache()
    rows = {r.domain: r for r in E.domain_rows(answers).unionByName(E.failed_domains(answers)).collect()}
    assert set(rows) == {"good.example", "free.example"}
    assert (rows["good.example"].registered_date, rows["good.example"].registrar, rows["good.example"].nameservers) == ("2020-01-02", "First Registrar, Inc.", "ns1.host.example; ns2.host.example")
    assert rows["free.example"].notes == "Bad Request -- WHOIS lookup failed: No match: free.example"
    assert json.loads(client(["good.example"])[0])["org"] == [] and answers.where(F.col("error").startswith("TimeoutError")).count() == 1
