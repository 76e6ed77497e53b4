"""HTTP endpoint for SPARQL: GET or POST /sparql, POST /sparql-update.

The Accept header chooses CSV, TSV, JSON or XML.  Statements run one at a time;
results stream through toLocalIterator, so the driver holds a partition at most.
"""

from __future__ import annotations

from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock
from urllib.parse import parse_qs, urlparse

from .sources.tabular import format_rows
from .sparql.parser import SparqlError, UnsupportedFeature

FORMATS = {"text/csv": "csv", "text/tab-separated-values": "tsv", "application/sparql-results+json": "json", "application/json": "json", "application/sparql-results+xml": "xml"}


def answer(engine, path: str, text: str, accept: str) -> tuple[int, str, str]:
    """(status, content type, body) of a request."""
    if path not in ("/sparql", "/sparql-update") or not text:
        return 404 if text else 400, "text/plain", "no query"
    kind = next((k for part in accept.split(",") for k in [part.split(";")[0].strip()] if k in FORMATS), "application/sparql-results+json")
    try:
        out = engine.sparql(text)
        if out is None:
            return 200, "text/plain", "ok"
        rows = [tuple(r) for r in out.toLocalIterator()]
        return 200, kind, format_rows(out.columns, rows, FORMATS[kind])
    except UnsupportedFeature as e:
        return 501, "text/plain", f"unsupported: {e}"
    except SparqlError as e:
        return 400, "text/plain", str(e)


def serve(engine, port: int = 0) -> ThreadingHTTPServer:
    """A server bound to port; call serve_forever()."""
    lock = Lock()

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, text):
            with lock:
                status, kind, body = answer(engine, urlparse(self.path).path, text, self.headers.get("Accept", ""))
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            self._reply(parse_qs(urlparse(self.path).query).get("query", [""])[0])

        def do_POST(self):
            body = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
            if "form-urlencoded" in self.headers.get("Content-Type", ""):
                fields = parse_qs(body)
                body = (fields.get("query") or fields.get("update") or [""])[0]
            self._reply(body)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
