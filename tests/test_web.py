import json
import threading
import urllib.parse
import warnings
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tidemill.sources import read_source, write_sink

ITEMS = [{"id": i, "name": f"n{i}\n"} for i in range(25)]


class Handler(BaseHTTPRequestHandler):
    posted: list = []
    failures = 2

    def log_message(self, *args):
        pass

    def answer(self, body, status=200, headers=()):
        raw = json.dumps(body).encode()
        self.send_response(status)
        for k, v in headers:
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(raw)

    def do_GET(self):
        url = urllib.parse.urlsplit(self.path)
        q = {k: v[0] for k, v in urllib.parse.parse_qs(url.query).items()}
        if url.path == "/page":
            a = (int(q["page"]) - 1) * int(q["page_size"])
            self.answer({"data": {"rows": ITEMS[a : a + int(q["page_size"])]}})
        elif url.path == "/cursor":
            a = int(q.get("cursor", 0))
            self.answer({"items": ITEMS[a : a + 10], "next_cursor": a + 10 if a + 10 < len(ITEMS) else None})
        elif url.path == "/link":
            a = int(q.get("at", 0))
            self.answer(ITEMS[a : a + 10], headers=[("Link", f'</link?at={a + 10}>; rel="next"')] if a + 10 < len(ITEMS) else [])
        elif url.path == "/flaky" and Handler.failures:
            Handler.failures -= 1
            self.answer({}, 503)
        elif url.path == "/flaky":
            self.answer(ITEMS if self.headers["Authorization"] == "Bearer t" else [])
        else:
            self.answer({}, 404)

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path == "/graphql":
            a = int(body["variables"].get("after") or 0)
            edges = [{"node": r} for r in ITEMS[a : a + 10]]
            self.answer({"data": {"all": {"edges": edges, "pageInfo": {"hasNextPage": a + 10 < len(ITEMS), "endCursor": str(a + 10)}}}} if "bad" not in body["query"] else {"errors": ["no"]})
        else:
            Handler.posted.append(body)
            self.answer({})


@pytest.fixture(scope="module")
def address():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


@pytest.mark.parametrize("spec", [
    {"url": "/page", "pagination": "page", "page_size": 10, "data_path": "data.rows"},
    {"url": "/page", "pagination": "page", "page_size": 4, "data_path": "data.rows", "parallel": 3},
    {"url": "/cursor", "pagination": "cursor", "data_path": "items"},
    {"url": "/link", "pagination": "link", "schema": "id long, name string"},
    {"url": "/flaky", "auth": "bearer", "credentials": {"token": "t"}},
])
def test_rest(spark, address, spec):
    rows = read_source(spark, {"type": "rest"} | spec | {"url": address + spec["url"]}).collect()
    assert sorted((r["id"], r["name"]) for r in rows) == [(r["id"], r["name"]) for r in ITEMS]


@pytest.mark.parametrize("spec", [
    {"type": "rest", "url": "/page", "pagination": "page", "page_size": 10, "data_path": "data.rows"},
    {"type": "rest", "url": "/cursor", "pagination": "cursor", "data_path": "items"},
    {"type": "graphql", "url": "/graphql", "query": "q", "data_path": "all", "pagination": "cursor", "page_size": 10},
])
def test_a_limit_of_pages_is_told(spark, address, spec):
    spec = spec | {"url": address + spec["url"]}
    with pytest.warns(UserWarning, match="max_pages"):
        assert read_source(spark, spec | {"max_pages": 2}).count() == 20
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        assert read_source(spark, spec | {"max_pages": 3}).count() == 25


def test_graphql_and_errors(spark, address):
    spec = {"type": "graphql", "url": f"{address}/graphql", "query": "q", "data_path": "all", "pagination": "cursor", "page_size": 10}
    assert sorted(r["id"] for r in read_source(spark, spec).collect()) == list(range(25))
    with pytest.raises(Exception, match="no"):
        read_source(spark, spec | {"query": "bad"}).collect()
    with pytest.raises(Exception, match="404"):
        read_source(spark, {"type": "rest", "url": f"{address}/none"}).collect()


def test_posting(spark, address):
    Handler.posted.clear()
    write_sink(spark.createDataFrame([(i, None) for i in range(7)], "id long, x string").coalesce(1), {"type": "webhook", "url": f"{address}/in", "batch_rows": 3, "wrapper_key": "rows"})
    assert [len(p["rows"]) for p in Handler.posted] == [3, 3, 1] and Handler.posted[0]["rows"][0] == {"id": 0, "x": None}
