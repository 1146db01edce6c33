import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from pubspark.sources import readers
from pubspark.sources.oai import OaiDataSource

NS = "http://www.openarchives.org/OAI/2.0/"


def page(records, token=""):
    body = "".join(
        f"<record><header{' status=\"deleted\"' if gone else ''}><identifier>{i}</identifier><datestamp>2020-01-0{i[-1]}</datestamp></header>{'' if gone else f'<metadata><mods><t>{i}</t></mods></metadata>'}</record>"
        for i, gone in records
    )
    return f'<OAI-PMH xmlns="{NS}"><ListRecords>{body}<resumptionToken>{token}</resumptionToken></ListRecords></OAI-PMH>'


class Repository(BaseHTTPRequestHandler):
    failed = False

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        if q.get("set") == "none":
            text = f'<OAI-PMH xmlns="{NS}"><error code="noRecordsMatch"/></OAI-PMH>'
        elif q.get("set") == "bad":
            text = f'<OAI-PMH xmlns="{NS}"><error code="badArgument">no</error></OAI-PMH>'
        elif q.get("resumptionToken") == "t1" and not Repository.failed:
            Repository.failed = True
            self.send_response(503)
            self.send_header("Retry-After", "0")
            return self.end_headers()
        else:
            text = page([("oai:3", True)]) if "resumptionToken" in q else page([("oai:1", False), ("oai:2", False)], "t1")
        self.send_response(200)
        self.end_headers()
        self.wfile.write(text.encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def url():
    server = HTTPServer(("127.0.0.1", 0), Repository)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/oai"
    server.shutdown()


def test_oai(spark, url):
    spark.dataSource.register(OaiDataSource)
    read = lambda s: spark.read.format("oai").options(url=url, set=s, wait="0").load()
    rows = sorted(read("a,none").collect())
    assert [(r.oai_id, r.deleted, r.source_subset) for r in rows] == [("oai:1", False, "a"), ("oai:2", False, "a"), ("oai:3", True, "a")]
    assert "oai:1" in rows[0].xml and rows[2].xml is None
    with pytest.raises(Exception, match="badArgument"):
        read("bad").collect()


def test_oai_files(spark, tmp_path):
    (tmp_path / "p.xml").write_text(page([("oai:1", False), ("oai:2", True)]))
    rows = sorted(readers.oai_records(spark, str(tmp_path / "p.xml")).collect())
    assert [(r.oai_id, r.deleted, r.broken) for r in rows] == [("oai:1", False, None), ("oai:2", True, None)]
    assert "<t>oai:1</t>" in rows[0].xml


def test_lists(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"a": {"code": "a", "name": "A", "sets": [{"url": "u", "subset": "x", "metadata_prefix": "mods"}, {"url": "v", "subset": None, "metadata_prefix": "m", "envs": ["PROD"]}]}}))
    assert sorted(r.url for r in readers.source_sets(spark, str(tmp_path / "s.json"), "PROD").collect()) == ["u", "v"]
    assert [r.url for r in readers.source_sets(spark, str(tmp_path / "s.json"), "DEV").collect()] == ["u"]
    (tmp_path / "b.csv").write_text('isbn,doi,url\n978-91-7740-107-0||123,x 10.1/abc,u1\n,10.1/abc,u2\n')
    assert sorted(map(tuple, readers.book_list(spark, str(tmp_path / "b.csv"), "isbn", "doi", "url").collect())) == [("10.1/abc", "u2"), ("9789177401070", "u1")]
    (tmp_path / "k.txt").write_text("a\n b \n\na\n")
    assert sorted(r.id for r in readers.known_ids(spark, str(tmp_path / "k.txt")).collect()) == ["a", "b"]
    (tmp_path / "l.csv").write_text("Year;Identifier;Level\n2020;1234-567x;1\n2021;1234-567x;0\n")
    assert sorted(map(tuple, readers.journal_list(spark, str(tmp_path / "l.csv")).collect())) == [(2020, "1234-567X", 1), (2021, "1234-567X", 0)]
    (tmp_path / "l2.csv").write_text("Year;Identifier;Level\n2020;1234-567x;1\n2020;1234-567X;0\n")
    with pytest.raises(Exception, match="listed twice"):
        readers.journal_list(spark, str(tmp_path / "l2.csv")).collect()
    graph = [{"@id": "1", "code": "1", "prefLabelByLang": {"sv": "Ett", "en": "One"}}, {"@id": "101", "code": "101", "broader": {"@id": "1"}, "narrowMatch": [{"@id": "9"}], "isReplacedBy": [{"@id": "7"}, {"@id": "8"}]}]
    (tmp_path / "c.json").write_text(json.dumps({"@graph": graph}))
    c = readers.concepts(spark, str(tmp_path / "c.json"))
    assert sorted((r.id, r.broader) for r in c.collect()) == [("1", None), ("101", "1")]
    assert dict(map(tuple, readers.replacement(c).collect())) == {"1": "1", "101": "9"}
