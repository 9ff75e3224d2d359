"""A thin HTTP service over an engine, with the standard library."""

from __future__ import annotations

import json
from dataclasses import asdict
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .engine import Engine, TooManyRows
from .streaming.ingest import CollectedCounter


def serve(engine: Engine, port: int = 8080, counter: CollectedCounter | None = None) -> ThreadingHTTPServer:
    """A server; call serve_forever() on it. POST /query, GET /download, /stats and /metrics."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, code: int, body: bytes, kind: str = "text/plain; charset=utf-8") -> None:
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.send_header("Access-Control-Allow-Origin", "*")
            self.end_headers()
            self.wfile.write(body)

        def do_OPTIONS(self) -> None:
            """What browsers ask before they post JSON."""
            self.send_response(204)
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Access-Control-Allow-Methods", "GET, POST, OPTIONS")
            self.send_header("Access-Control-Allow-Headers", "Content-Type")
            self.send_header("Access-Control-Max-Age", "86400")
            self.end_headers()

        def do_POST(self) -> None:
            if urlsplit(self.path).path != "/query":
                return self.answer(405 if urlsplit(self.path).path in ("/download", "/stats") else 404, b"")
            try:
                asked = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                sql, start, end = asked["query"], *(datetime.fromisoformat(asked[k]) for k in ("start", "end"))
                if not sql:
                    raise ValueError("no query")
            except (ValueError, KeyError, TypeError) as error:
                return self.answer(400, f"bad request: {error}".encode())
            try:
                result = engine.query(sql, start, end)
            except TooManyRows as error:
                return self.answer(413, str(error).encode())
            except Exception as error:
                return self.answer(500, str(error).encode())
            self.answer(200, json.dumps(asdict(result)).encode(), "application/json")

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            given = {k: v[0] for k, v in parse_qs(url.query).items()}
            if url.path == "/stats":
                self.answer(200, json.dumps(engine.stats()).encode(), "application/json")
            elif url.path == "/metrics":
                self.answer(200, (counter.exposition() if counter else "").encode())
            elif url.path == "/download":
                try:
                    start, end = (datetime.fromisoformat(given[k].replace(" ", "+")) for k in ("from", "to"))
                except (ValueError, KeyError) as error:
                    return self.answer(400, f"bad request: {error}".encode())
                begun = False
                try:
                    with engine.members(start, end, given.get("where", "")) as found:
                        self.send_response(200)
                        self.send_header("Content-Type", "application/octet-stream")
                        self.send_header("Content-Length", str(found.size))
                        self.send_header("Content-Disposition", f'attachment; filename="events_{given["from"]}_{given["to"]}.jsonl.gz"')
                        self.send_header("Access-Control-Allow-Origin", "*")
                        self.end_headers()
                        begun = True
                        found.pass_on(self.wfile)
                except Exception as error:
                    if begun:  # the answer's head is out: only a cut connection can tell
                        self.close_connection = True
                        raise
                    self.answer(500, str(error).encode())
            else:
                self.answer(405 if url.path == "/query" else 404, b"")

        def log_message(self, *args) -> None: ...

    return ThreadingHTTPServer(("", port), Handler)
