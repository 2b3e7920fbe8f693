"""The query API over HTTP, on the standard library's server."""

from __future__ import annotations

import json
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from ordertide.plans.engine import Engine


def respond(engine: Engine, target: str) -> tuple[int, dict]:
    """Status and body of a GET."""
    url = urlsplit(target)
    q = {k: v[0] for k, v in parse_qs(url.query).items()}
    if url.path == "/health":
        return 200, engine.health()
    m = re.fullmatch(r"/api/v1/restaurants/([^/]*)/topk(/revenue)?", url.path)
    if not m:
        return 404, {"error": "not found"}
    name = unquote(m[1])
    if not name:
        return 400, {"error": "restaurant id is missing"}
    args = {"start": q.get("start", q.get("startTime")), "end": q.get("end", q.get("endTime")), "k": q.get("k")}
    try:
        if m[2]:
            return 200, engine.top_k_by_revenue(name, **args)
        return 200, engine.top_k_global(**args) if name == "all" else engine.top_k(name, **args)
    except Exception as e:  # noqa: BLE001  any failure of a query is the server's error
        return 500, {"error": str(e)}


def serve(engine: Engine, port: int = 8080) -> ThreadingHTTPServer:
    """A server; the caller runs ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            status, body = respond(engine, self.path)
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
