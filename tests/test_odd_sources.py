"""No source ends a job: files of every format with bytes cut, changed and put in; and pages from a server."""

import http.server
import threading

import numpy as np
import pytest

from sheaf.engine import Engine
from sheaf.sources import uris, web

from . import fixtures
from .test_engine import ATOM, RSS


def odd(data: bytes, rng) -> bytes:
    out = bytearray(data)
    kind = rng.integers(0, 4)
    if kind == 0:
        del out[int(rng.integers(0, len(out))) :]
    elif kind == 1:
        for at in rng.integers(0, len(out), 8):
            out[at] = int(rng.integers(0, 256))
    elif kind == 2:
        at = int(rng.integers(0, len(out)))
        out[at:at] = rng.integers(0, 256, 20, dtype=np.uint8).tobytes()
    else:
        at, to = sorted(rng.integers(0, len(out), 2))
        del out[at:to]
    return bytes(out)


def test_no_source_ends_a_job(spark):
    rng = np.random.default_rng(9)
    whole = {".docx": fixtures.docx(), ".pptx": fixtures.pptx(), ".xlsx": fixtures.xlsx(), ".xls": fixtures.xls(), ".epub": fixtures.epub(), ".pdf": fixtures.pdf(), ".ipynb": fixtures.notebook(), ".rss": RSS, ".atom": ATOM, ".csv": b"a,b\n1,2", ".html": b"<p>a<b>b<table>c", ".zip": fixtures.package({"a.csv": "x,y", "b.html": "<p>q"}), ".txt": "né".encode()}
    rows = [(ext, odd(data, rng), None) for ext, data in whole.items() for _ in range(12)]
    rows += [(ext, rng.integers(0, 256, 60, dtype=np.uint8).tobytes(), None) for ext in whole]
    rows += [(ext, b"", None) for ext in whole] + [(ext, b"<" * 5000 + b"[" * 5000 + b"{" * 5000, None) for ext in whole]
    deep = b"<b>" * 1500 + b"x"
    rows += [(".html", deep, None), (".rss", b"<rss><channel><item><title>t</title><description>" + deep.replace(b"<", b"&lt;") + b"</description></item></channel></rss>", None), (".ipynb", b"[" * 100_000, None)]
    rows += [(".txt", b"caf\xe9", label) for label in ("rot13", "hex", "base64", "zip", "bz2", "punycode", "utf-7", "nothing", "idna")]
    sources = spark.createDataFrame([(i, bytearray(data), ext, label) for i, (ext, data, label) in enumerate(rows)], "source_id long, content binary, extension string, charset string")
    got = {r.source_id: r for r in Engine(spark).convert(sources).collect()}
    assert len(got) == len(rows)
    for r in got.values():
        assert (r.status == "ok") == (r.error is None) and r.status in ("ok", "failed", "unsupported")
    by_text = {rows[i][1]: r for i, r in got.items()}
    assert by_text[deep].markdown == "**x**" and by_text[rows[-10][1]].attempts[0].converter == "ipynb"
    assert all(got[len(rows) - 1 - i].markdown == "caf�" for i in range(9))


class Pages(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        body = {"/fine": b"hello", "/large": b"x" * 5000, "/unsized": b"y" * 5000}.get(self.path)
        self.send_response(404 if body is None else 200)
        self.send_header("Content-Type", "text/plain; charset=utf-8")
        if self.path != "/unsized":
            self.send_header("Content-Length", str(len(body or b"")))
        self.end_headers()
        self.wfile.write(body or b"")

    def log_message(self, *args):
        pass


def test_web_source(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        web.register(spark)
        base = f"http://127.0.0.1:{server.server_address[1]}"
        urls = "\n".join(f"{base}/{x}" for x in ("fine", "large", "unsized", "lost")) + "\nhttp://127.0.0.1:1/closed"
        read = lambda: spark.read.format("web").option("urls", urls).option("max_bytes", 1000).option("urls_per_task", 2)
        frame = read().option("enable_http", "true").load()
        assert frame.rdd.getNumPartitions() == 3
        got = {r.url.rpartition("/")[2]: r for r in frame.collect()}
        assert (bytes(got["fine"].content), got["fine"].content_type, got["fine"].error) == (b"hello", "text/plain; charset=utf-8", None)
        assert all("over the limit of 1000" in got[x].error and got[x].content is None for x in ("large", "unsized"))
        assert "404" in got["lost"].error and got["closed"].error
        with pytest.raises(Exception, match="remote sources are disabled"):
            read().load().collect()
        with pytest.raises(Exception, match="not a web address"):
            spark.read.format("web").option("urls", "file:///etc/hosts").option("enable_http", "true").load().collect()
    finally:
        server.shutdown()
    assert issubclass(uris.RemoteTooLarge, Exception)
