"""The frame server of a process that holds a socket: numbers frames as they come and hands them to executors.

Frames stay in memory until Spark has stored them, ``most`` at most: then the socket waits, as it would for any
slow reader. See ``tidemark.sources.frames`` for what is asked of it.
"""

from __future__ import annotations

import json
import threading
from collections import deque
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from itertools import islice
from urllib.parse import parse_qs, urlsplit


class FrameLog:
    """Numbered frames of each market, from the first that is not committed on."""

    def __init__(self, most: int = 500_000) -> None:
        self.most, self.waiting = most, 0
        self.first: dict[str, int] = {}
        self.kept: dict[str, deque] = {}
        self.room = threading.Condition()

    def add(self, frame: str, receive_ns: int, epoch: int, stop: threading.Event | None = None) -> bool:
        """Number a frame; False if ``stop`` is set while there is no room."""
        try:
            market = str(json.loads(frame).get("code"))
        except (ValueError, AttributeError):
            market = ""  # it is kept all the same, and found wanting later
        with self.room:
            while self.waiting >= self.most:
                if stop is not None and stop.is_set():
                    return False
                self.room.wait(0.1)
            self.kept.setdefault(market, deque()).append((frame, receive_ns, epoch))
            self.first.setdefault(market, 0)
            self.waiting += 1
        return True

    def offsets(self) -> dict[str, list[int]]:
        with self.room:
            return {m: [self.first[m], self.first[m] + len(held)] for m, held in self.kept.items()}

    def stretch(self, market: str, after: int, upto: int) -> list[tuple]:
        with self.room:
            first = self.first.get(market, 0)
            return list(islice(self.kept.get(market, ()), max(0, after - first), max(0, upto - first))) if after >= first else []

    def commit(self, ends: dict[str, int]) -> None:
        with self.room:
            for market, end in ends.items():
                held = self.kept.get(market, deque())
                while held and self.first[market] < end:
                    held.popleft()
                    self.first[market] += 1
                    self.waiting -= 1
            self.room.notify_all()


class Gateway:
    """Serves a log over HTTP on a thread of its own until ``close``."""

    def __init__(self, log: FrameLog, host: str = "127.0.0.1", port: int = 0) -> None:
        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:
                asked = urlsplit(self.path)
                if asked.path == "/offsets":
                    return self._answer(json.dumps(log.offsets()).encode())
                q = {k: v[0] for k, v in parse_qs(asked.query, keep_blank_values=True).items()}
                self._answer(b"".join(json.dumps(f).encode() + b"\n" for f in log.stretch(q["market"], int(q["after"]), int(q["upto"]))))

            def do_POST(self) -> None:
                log.commit(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
                self._answer(b"")

            def _answer(self, body: bytes) -> None:
                self.send_response(200)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *args) -> None:
                pass

        self.server = ThreadingHTTPServer((host, port), Handler)
        self.url = f"http://{host}:{self.server.server_address[1]}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def close(self) -> None:
        self.server.shutdown()
        self.server.server_close()
