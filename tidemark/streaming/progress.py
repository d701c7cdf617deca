"""Progress of collection, from what the engine counts in each batch."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener

#: Seconds between two lines.
EVERY = 10


class Progress(StreamingQueryListener):
    """Adds up the records and markets that the sinks of ``collect`` observe, and tells them with the state rows of the
    live detector every EVERY seconds. Numbers come with the batches; no job is run for them."""

    def __init__(self, say: Callable[[str], None] = lambda x: print(x, file=sys.stderr), clock: Callable[[], float] = time.time) -> None:
        self.say, self.clock = say, clock
        self.started = self.told = clock()
        self.records: dict[str, int] = {}
        self.markets: set[str] = set()
        self.state_rows = self.errors = 0

    def line(self) -> str:
        counts = " ".join(f"{k}={n}" for k, n in sorted(self.records.items()))
        return f"collect: elapsed={self.clock() - self.started:.0f}s markets={len(self.markets)} {counts} state={self.state_rows}"

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            if name.startswith("taken_"):
                self.records[name[6:]] = self.records.get(name[6:], 0) + row["records"]
                self.markets |= set(row["markets"])
        if event.progress.name == "live_events" and event.progress.stateOperators:
            self.state_rows = event.progress.stateOperators[0].numRowsTotal
        if self.clock() - self.told >= EVERY:
            self.told = self.clock()
            self.say(self.line())

    def onQueryTerminated(self, event) -> None:
        self.errors += event.exception is not None
