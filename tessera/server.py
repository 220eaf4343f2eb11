"""A small HTTP service over a stored index: one question a request.

python -m tessera serve PASSAGES BASELINE.json [PORT]
"""

from __future__ import annotations

import json
from collections.abc import Callable
from http import HTTPStatus
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import DataFrame

from .functions import checkpoints
from .operators import lexical_index, service
from .operators.sufficiency import Model

MAX_BODY, DEFAULT_LIMIT = 16 * 1024, 5

PAGE = """<!doctype html><meta charset="utf-8"><title>tessera</title><h1>Ask the corpus</h1>
<form id="f"><input id="q" size="80" maxlength="2000" required><button>Ask</button></form><pre id="a"></pre>
<script>f.onsubmit = async e => { e.preventDefault(); a.textContent = '...';
const r = await fetch('/api/query', {method: 'POST', body: JSON.stringify({question: q.value})}); a.textContent = JSON.stringify(await r.json(), null, 2) }</script>"""

Ask = Callable[[str, int], dict[str, Any]]


class Refused(Exception):
    """A request that gets no answer, with the status to say so."""

    def __init__(self, status: HTTPStatus, why: str) -> None:
        super().__init__(why)
        self.status = status


def checked(request: Any) -> tuple[str, int]:
    """The question, stripped, and the limit of a request's JSON; ``ValueError`` if either is out of bounds."""
    if not isinstance(request, dict):
        raise ValueError("the body must be a JSON object")
    question, limit = request.get("question"), request.get("limit", DEFAULT_LIMIT)
    if not isinstance(question, str) or not question.strip():
        raise ValueError("question must be a string that isn't blank")
    if len(question.strip()) > service.MAX_QUESTION:
        raise ValueError(f"question must have at most {service.MAX_QUESTION} characters")
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= service.MAX_LIMIT:
        raise ValueError(f"limit must be an integer in 1..{service.MAX_LIMIT}")
    return question.strip(), limit


def asker(passages: DataFrame, model: Model) -> Ask:
    """Answers over an index of ``passages`` that is built once; a request leaves no table behind."""
    spark = passages.sparkSession
    index = lexical_index.build(service.eligible(passages).select("passage_id", "text"))

    def ask(question: str, limit: int) -> dict[str, Any]:
        with checkpoints.scope(spark):
            one = spark.createDataFrame([(0, question)], "query_id long, text string")
            row = service.answer(passages, one, model, limit, index=index).drop("query_id").first()
        return {"question": question, **row.asDict(recursive=True)}

    return ask


def handler(ask: Ask) -> type[BaseHTTPRequestHandler]:
    """Requests by a table of routes: each gives a body and its type, or raises."""
    as_json, as_html = "application/json", "text/html"

    def body_of(request: BaseHTTPRequestHandler) -> bytes:
        told = request.headers.get("Content-Length") or "0"
        if not told.isascii() or not told.isdecimal():
            raise Refused(HTTPStatus.BAD_REQUEST, "the length of the body is not a number")
        if not 1 <= int(told) <= MAX_BODY:
            request.close_connection = True
            raise Refused(HTTPStatus.REQUEST_ENTITY_TOO_LARGE, f"a body has 1 to {MAX_BODY} bytes")
        return request.rfile.read(int(told))

    def query(request: BaseHTTPRequestHandler) -> tuple[Any, str]:
        whole = body_of(request)
        try:
            asked = checked(json.loads(whole.decode()))
        except ValueError as e:  # bad UTF-8 and bad JSON are ValueErrors too
            raise Refused(HTTPStatus.BAD_REQUEST, str(e)) from e
        return ask(*asked), as_json

    routes: dict[tuple[str, str], Callable[[BaseHTTPRequestHandler], tuple[Any, str]]] = {
        ("GET", "/"): lambda _: (PAGE, as_html),
        ("GET", "/api/health"): lambda _: ({"status": "ok", "service": "tessera"}, as_json),
        ("POST", "/api/query"): query,
    }

    class Handler(BaseHTTPRequestHandler):
        def respond(self) -> None:
            status, kind = HTTPStatus.OK, as_json
            try:
                route = routes.get((self.command, self.path))
                if route is None:
                    raise Refused(HTTPStatus.NOT_FOUND, f"nothing is at {self.command} {self.path}")
                body, kind = route(self)
            except Refused as e:
                status, body = e.status, {"error": str(e)}
            data = (body if kind == as_html else json.dumps(body, ensure_ascii=False)).encode()
            self.send_response(status)
            for k, v in (("Content-Type", f"{kind}; charset=utf-8"), ("Content-Length", str(len(data))), ("Cache-Control", "no-store")):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = respond

        def log_message(self, *args: Any) -> None:
            pass

    return Handler


def server(ask: Ask, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that isn't running yet; port 0 takes a free one."""
    if isinstance(port, bool) or not isinstance(port, int) or not 0 <= port <= 65535:
        raise ValueError("port must be an integer in 0..65535")
    return ThreadingHTTPServer((host, port), handler(ask))
