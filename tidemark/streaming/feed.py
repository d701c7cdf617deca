"""Connections to a stream of frames: states, stalls, growing pauses, refreshes of the universe, and files.

The socket is the caller's: ``connect(markets)`` returns ``receive(seconds)``, which returns the next
frame, raises TimeoutError if none comes in that time, and anything else when the connection ends.
Frames go to a log that executors fetch them from (``gateway``), events to ``connection_events``.
"""

from __future__ import annotations

import sys
import threading
import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.operators.journal import refresh_due
from tidemark.sources import store
from tidemark.streaming.gateway import FrameLog
from tidemark.streaming.live import connection_events

Receive = Callable[[float], str]

#: The longest pause between connections.
MOST_PAUSE = 60
PROGRESS_SECONDS = 10


class Feed:
    """Runs connections one after another until ``stop`` is set; what has come stays in the log until it is stored."""

    def __init__(self, spark: SparkSession, config: Config, log: FrameLog, universe: Callable[[], list[str]], connect: Callable[[list[str]], Receive], clock: Callable[[], float] = time.time, say: Callable[[str], None] = lambda x: print(x, file=sys.stderr)) -> None:
        self.spark, self.config, self.log = spark, config, log
        self.universe, self.connect, self.clock, self.say = universe, connect, clock, say
        self.stop = threading.Event()
        self.epoch, self.taken, self.pause = -1, 0, 1
        self.lost_at: float | None = None
        self.failed: Exception | None = None
        self.started = self.looked = self.told = clock()
        self.day = datetime.fromtimestamp(self.started, UTC)
        self.markets = universe()
        self._store_universe()

    def _store_universe(self) -> None:
        """The markets followed from now on, in ``universes``."""
        rows = self.spark.createDataFrame([(int(self.clock() * 1_000_000), self.markets, "ALL")], "refreshed_at bigint, markets array<string>, market string")
        store.append(rows.withColumn("date", F.to_date(F.timestamp_micros("refreshed_at"))), self.config.data_root, "universes")

    def record(self, state: str, detail: str, gap: float | None = None) -> None:
        event = (state, detail, None if gap is None else round(gap * 1000), self.clock())
        store.append(connection_events(self.spark, [event]), self.config.data_root, "connection_events")

    def _refresh_due(self) -> bool:
        return refresh_due(self.day, datetime.fromtimestamp(self.clock(), UTC), self.config.daily_refresh_utc_hour)

    def _refresh(self) -> None:
        self.markets, self.day = self.universe(), datetime.fromtimestamp(self.clock(), UTC)
        self._store_universe()
        self.record("universe_changed", "universe refreshed; rolling state reset")

    def _follow(self, receive: Receive) -> tuple[str, str] | None:
        """Take frames until the connection is to end; why it ended, or None on a stop."""
        last = self.clock()
        while not self.stop.is_set():
            try:
                frame = receive(min(1.0, self.config.stall_timeout_seconds))
                last = self.clock()
                self.taken += self.log.add(frame, int(last * 1e9), self.epoch, self.stop)
            except TimeoutError:
                if self.clock() - last >= self.config.stall_timeout_seconds:
                    return "stalled", "no frame within stall timeout"
            except Exception as why:  # noqa: BLE001 - the connection has ended, whatever the socket raises
                return "disconnected", str(why)
            if self.clock() - self.looked >= self.config.flush_interval_seconds:
                self.looked = self.clock()
                if self._refresh_due():
                    return "universe_refresh_due", "daily universe refresh due; reconnecting"
            if self.clock() - self.told >= PROGRESS_SECONDS:
                self.told = self.clock()
                self.say(f"collect: elapsed={self.told - self.started:.0f}s markets={len(self.markets)} frames={self.taken} waiting={self.log.waiting}")
        return None

    def watched(self, connections: int | None = None) -> None:
        """``run`` for a thread of its own: what ends it, such as a universe that cannot be fetched or a folder that
        cannot be written, is kept in ``failed`` for who waits."""
        try:
            self.run(connections)
        except Exception as why:  # noqa: BLE001 - handed over to the waiting thread
            self.failed = why

    def run(self, connections: int | None = None) -> None:
        """Connect again and again, at most ``connections`` times; pauses double up to a minute and start
        anew after a connection."""
        while not self.stop.is_set() and connections != 0:
            connections = None if connections is None else connections - 1
            if self._refresh_due():
                self._refresh()
            self.record("connecting", f"{len(self.markets)} markets")
            try:
                receive = self.connect(self.markets)
            except Exception as why:  # noqa: BLE001 - retried after a pause
                self.lost_at = self.lost_at or self.clock()
                self.record("connect_failed", str(why))
            else:
                self.epoch, self.pause = self.epoch + 1, 1
                self.record("connected", "rolling and sequence state reset", None if self.lost_at is None else self.clock() - self.lost_at)
                self.lost_at = None
                ended = self._follow(receive)
                if ended is None:
                    break
                self.lost_at = self.clock()
                self.record(*ended)
            if connections == 0:
                break
            began = self.clock()
            self.stop.wait(self.pause)
            self.record("reconnect", "backoff reconnect", self.clock() - began)
            self.pause = min(self.pause * 2, MOST_PAUSE)
        self.say(f"collect: connections ended after {self.clock() - self.started:.0f}s; frames={self.taken} waiting={self.log.waiting}")
