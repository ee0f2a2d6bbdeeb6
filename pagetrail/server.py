"""A small REST service: /api/corpus, /api/page and /api/shortest-path, and static files."""

from __future__ import annotations

import json
import mimetypes
import threading
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, unquote, urlsplit

from pagetrail.api import GraphReader, displayed
from pagetrail.operators.graph import LinkGraph, Page


class ArgumentError(Exception):
    pass


class Service:
    def __init__(self, graph: LinkGraph, name: str, base_url: str, static: str | None = None):
        self.graph, self.static = graph, Path(static).resolve() if static else None
        self.reader = GraphReader(graph)
        self.corpus = {"corpus": {"base_url": base_url, "graph_filename": name, "vertex_count": self.reader.vertex_count, "edge_count": self.reader.edge_count}}

    def _argument(self, query: dict[str, list[str]], key: str) -> str:
        values = query.get(key, [])
        if len(values) != 1:
            raise ArgumentError(f"{'Multiple' if values else 'Missing'} {key} argument{'s' if values else ''}")
        return values[0]

    def _page(self, argument: str) -> Page | None:
        if argument == "?":
            return self.graph.page_by_id(self.graph.random_page_id())
        if not argument.startswith("#"):
            return self.graph.page_by_title(argument)
        try:
            page_id = int(argument[1:])
        except ValueError as e:
            raise ArgumentError("Invalid page id") from e
        if not 0 < page_id < self.reader.vertex_count:
            raise ArgumentError("Page id out of range")
        return self.graph.page_by_id(page_id)

    @staticmethod
    def _shown(page: Page | None) -> dict:
        return {"page": {"id": page.id, "title": page.title}} if page else {"error": {"message": "Page not found."}}

    def answer(self, path: str, query: dict[str, list[str]]) -> tuple[int, dict] | None:
        """(status, value) of an API address, None for any other."""
        if path == "/api/corpus":
            return 200, self.corpus
        if path == "/api/page":
            page = self._page(self._argument(query, "page"))
            return 200 if page else 404, self._shown(page)
        if path == "/api/shortest-path":
            start, finish = (self._page(self._argument(query, k)) for k in ("start", "finish"))
            result = {"start": self._shown(start), "finish": self._shown(finish)}
            if not (start and finish):
                return 404, result | {"error": {"message": "Page not found."}}
            found, stats = self.reader.shortest_path_with_stats(start.id, finish.id)
            return 200, result | {"path": displayed(self.graph, found), "stats": asdict(stats)}
        return None

    def file(self, path: str) -> Path | None:
        if not self.static:
            return None
        asked = (self.static / unquote(path).lstrip("/")).resolve()
        asked = asked / "index.html" if asked.is_dir() else asked
        return asked if asked.is_relative_to(self.static) and asked.is_file() else None


def _handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, kind: str, body: bytes, head: bool) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            if not head:
                self.wfile.write(body)

        def _handle(self, head: bool) -> None:
            url = urlsplit(self.path)
            try:
                answer = service.answer(url.path, parse_qs(url.query))
            except ArgumentError as e:
                return self._send(400, "text/plain; charset=utf-8", str(e).encode(), head)
            if answer:
                return self._send(answer[0], "application/json", json.dumps(answer[1]).encode(), head)
            if file := service.file(url.path):
                return self._send(200, mimetypes.guess_type(file.name)[0] or "application/octet-stream", file.read_bytes(), head)
            return self._send(404, "text/plain; charset=utf-8", b"Not found", head)

        def do_GET(self) -> None:
            self._handle(False)

        def do_HEAD(self) -> None:
            self._handle(True)

        def do_POST(self) -> None:
            self._send(405, "text/plain; charset=utf-8", b"Method not allowed", False)

        do_PUT = do_DELETE = do_PATCH = do_POST

        def log_message(self, *args) -> None:
            pass

    return Handler


def serve(service: Service, host: str = "127.0.0.1", port: int = 8001, background: bool = False) -> ThreadingHTTPServer:
    server = ThreadingHTTPServer((host, port), _handler(service))
    if background:
        threading.Thread(target=server.serve_forever, daemon=True).start()
    else:
        server.serve_forever()
    return server
