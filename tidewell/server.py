"""A thin HTTP front of a catalog.

    PUT  /series/<name>           create
    POST /series/<name>           append {"entries": [{"ts": ..., "value": ...}]}
    GET  /series/<name>?from&group_by&aggregators&limit
    GET  /series/<name>/export    lines of text
    POST /series/<name>/restore   lines of text

Run it as `python -m tidewell.server -p PATH server -a HOST:PORT`.
"""

from __future__ import annotations

import argparse
import itertools
import json
import uuid
from collections.abc import Iterable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import SparkSession

from tidewell.errors import BadRequest, Conflict, SeriesError, SeriesNotFound
from tidewell.operators.query import json_document
from tidewell.plans.statement import Statement
from tidewell.sources.catalog import SeriesCatalog
from tidewell.scratch import scratch_path
from tidewell.sources.storage import Folder
from tidewell.sources.textio import export_lines, restore

#: Bytes of a request that are held at once; a body of lines goes to the shared folder.
BLOCK_BYTES = 1 << 20
#: Messages that clients see.
MESSAGES = {404: "Not found", 400: "Bad request", 409: "Conflict", 500: "Internal error"}


def _entries(body: bytes) -> list[tuple[int, float]]:
    def refuse(constant: str) -> float:
        raise BadRequest("invalid json body")

    try:
        listed = json.loads(body, parse_constant=refuse)["entries"]
        found = [(e["ts"], e["value"]) for e in listed]
        if all(type(t) is int and -(2**63) <= t < 2**63 and type(v) in (int, float) for t, v in found):
            return [(t, float(v)) for t, v in found]
    except (ValueError, KeyError, TypeError):
        pass
    raise BadRequest("invalid json body")


def _separated(rows: Iterable[str]) -> Iterator[str]:
    for i, row in enumerate(rows):
        yield f",{row}" if i else row


class Handler(BaseHTTPRequestHandler):
    catalog: SeriesCatalog

    def log_message(self, *args: object) -> None:
        pass

    def _route(self) -> tuple[str, str, dict[str, str]]:
        url = urlsplit(self.path)
        parts = [unquote(x) for x in url.path.strip("/").split("/")]
        if len(parts) not in (2, 3) or parts[0] != "series":
            raise SeriesNotFound(url.path)
        return parts[1], parts[2] if len(parts) == 3 else "", {k: v[-1] for k, v in parse_qs(url.query, keep_blank_values=True).items()}

    def _answer(self, status: int, body: bytes, kind: str) -> None:
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def _handled(self, work) -> None:
        try:
            work(*self._route())
        except SeriesError as e:
            message = str(e) if isinstance(e, BadRequest) and "json" in str(e) else MESSAGES[e.status]
            self._answer(e.status, json.dumps({"code": e.status, "message": message}).encode(), "application/json")
        except Exception:
            self._answer(500, json.dumps({"code": 500, "message": MESSAGES[500]}).encode(), "application/json")

    def _blocks(self) -> Iterator[bytes]:
        """The body in blocks of bounded size, with a Content-Length or in chunks."""
        if "chunked" in (self.headers.get("Transfer-Encoding") or "").lower():
            while size := self._chunk_size():
                yield from self._read(size)
                self.rfile.readline()
            while self.rfile.readline().strip():
                pass  # trailers
        else:
            yield from self._read(int(self.headers.get("Content-Length") or 0))

    def _chunk_size(self) -> int:
        try:
            return int(self.rfile.readline(1 << 10).split(b";")[0], 16)
        except ValueError:
            raise BadRequest("malformed chunk") from None

    def _read(self, n: int) -> Iterator[bytes]:
        while n:
            block = self.rfile.read(min(n, BLOCK_BYTES))
            if not block:
                raise BadRequest("the body was cut short")
            n -= len(block)
            yield block

    def do_PUT(self) -> None:
        self._handled(self._create)

    def do_POST(self) -> None:
        self._handled(self._post)

    def do_GET(self) -> None:
        self._handled(self._get)

    def _create(self, name: str, action: str, query: dict[str, str]) -> None:
        if action:
            raise SeriesNotFound(action)
        self.catalog.create(name)
        self._answer(201, b"", "text/plain")

    def _post(self, name: str, action: str, query: dict[str, str]) -> None:
        blocks = self._blocks()
        if action == "restore":
            self._restore(name, blocks)
        elif action:
            raise SeriesNotFound(action)
        else:
            writer = self.catalog.writer(name)
            rows = [(t, v, i) for i, (t, v) in enumerate(_entries(b"".join(blocks)))]
            writer.append(self.catalog.spark.createDataFrame(rows, "ts long, value double, seq long"))
        self._answer(200, b"", "text/plain")

    def _restore(self, name: str, blocks: Iterator[bytes]) -> None:
        if self.catalog.exists(name):
            raise Conflict(name)
        folder = Folder(self.catalog.spark, scratch_path(self.catalog.spark, "restore"))
        folder.make()
        try:
            file = f"{uuid.uuid4().hex}.txt"
            folder.create_from(file, blocks)
            restore(self.catalog, name, f"{folder.path}/{file}")
        finally:
            folder.delete("")

    def _get(self, name: str, action: str, query: dict[str, str]) -> None:
        reader = self.catalog.reader(name)
        if action == "export":
            self._export(export_lines(reader.scan(0)))
        elif action:
            raise SeriesNotFound(action)
        else:
            statement = Statement.parse(*[query.get(k) for k in ("from", "group_by", "aggregators", "limit")])
            rows = json_document(reader.query(statement), statement).toLocalIterator()
            self._send("application/json", itertools.chain(['{"rows":['], _separated(r["json"] for r in rows), ["]}"]))

    def _export(self, lines) -> None:
        self._send("text/csv", (f"{r['line']}\n" for r in lines.toLocalIterator()))

    def _send(self, kind: str, parts: Iterable[str]) -> None:
        """A body of any size, a partition of the result at a time; the connection's end ends it. A query that fails at once is answered as an error."""
        parts = iter(parts)
        head = list(itertools.islice(parts, 2))
        self.send_response(200)
        self.send_header("Content-Type", kind)
        self.end_headers()
        for part in itertools.chain(head, parts):
            self.wfile.write(part.encode())


def make_server(spark: SparkSession, path: str, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    handler = type("BoundHandler", (Handler,), {"catalog": SeriesCatalog(spark, path)})
    return ThreadingHTTPServer((host, port), handler)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidewell")
    parser.add_argument("-p", "--path", required=True, help="root folder of the series")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("server").add_argument("-a", "--addr", default="127.0.0.1:8080")
    given = parser.parse_args(args)
    host, _, port = given.addr.rpartition(":")
    spark = SparkSession.builder.appName("tidewell").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    make_server(spark, given.path, host, int(port)).serve_forever()


if __name__ == "__main__":
    main()
