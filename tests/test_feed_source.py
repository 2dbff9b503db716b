"""Every failure of a feed is a row with its reason."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from quillspark.sources import feed, feed_source

DOCUMENT = {"totalDishes": 1, "lastUpdated": "now", "dishes": [{"name": "Soup", "cost": {"amount": "1.50", "unit": "MXN"}, "calculationNotes": "water"}]}
BODIES = {"/good": json.dumps(DOCUMENT).encode(), "/cut": b'{"dishes": [', "/list": b"[]", "/closed": b'{"error": "closed"}', "/empty": b"{}", "/binary": b"\xff\xfe", "/odd": b'{"dishes": [1]}'}


@pytest.fixture(scope="module")
def server():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            self.send_response(200 if self.path in BODIES else 404)
            self.end_headers()
            self.wfile.write(BODIES.get(self.path, b"gone"))

        def log_message(self, *args):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}"
    http.shutdown()


def test_reasons(spark, server):
    urls = [server + p for p in [*BODIES, "/missing"]] + ["http://127.0.0.1:1/refused", "nothing", "file:///no/such/file"]
    df = feed_source.read_feed(spark, urls, seconds="5", partitions="3")
    assert df.rdd.getNumPartitions() == 3
    got = {r["url"].removeprefix(server): r for r in df.collect()}
    assert {k: r["reason"] for k, r in got.items() if k != "/odd"} == {
        "/good": None, "/cut": "not JSON: JSONDecodeError", "/list": "not an object", "/closed": "feed says: closed", "/empty": "no dishes", "/binary": "not JSON: UnicodeDecodeError",
        "/missing": "status 404", "http://127.0.0.1:1/refused": "unreachable: URLError", "nothing": "unreachable: ValueError", "file:///no/such/file": "unreachable: URLError",
    }
    assert got["/good"]["dishes"][0]["cost"]["amount"] == "1.50" and got["/cut"]["dishes"] is None
    notes = [r["content"] for r in feed.feed_notes(df.filter("reason is null and url like '%/good'").drop("url", "reason")).collect()]
    assert "Soup: 1.50 MXN to produce" in notes and len(notes) == 3


def test_no_urls(spark):
    assert feed_source.read_feed(spark, []).count() == 0
