"""Spark stream source of numbered frames: executors fetch stretches of them from a frame server.

The server numbers each market's frames from 0 and keeps them until they are committed:

    GET  /offsets                              {market: [first kept, number of the next]}
    GET  /frames?market=M&after=A&upto=B       frames A to B - 1, a JSON line [frame, receive_ns, epoch] each
    POST /commit  {market: N}                  frames before N are stored and can go

The driver handles numbers alone. A batch is a stretch of numbers per market, so one that is repeated reads the same
frames: a restart from a checkpoint neither loses nor repeats any.

    spark.dataSource.register(FrameSource)
    spark.readStream.format("tidemark_frames").option("url", "http://host:port").load()
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FRAMES = "frame string, receive_ns bigint, epoch bigint"
#: Seconds that a server may take to answer.
PATIENCE = 30


@dataclass
class Stretch(InputPartition):
    """Frames ``after`` to ``upto`` - 1 of a market."""

    market: str
    after: int
    upto: int


class FrameSource(DataSource):
    """Options: ``url`` of the server, ``framesPerBatch`` (of each market, 1,000,000 unless set) and ``framesPerTask``
    (50,000: a busy market is many tasks)."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_frames"

    def schema(self) -> str:
        return FRAMES

    def streamReader(self, schema) -> FrameReader:
        return FrameReader(self.options["url"], int(self.options.get("framesPerBatch", 1_000_000)), int(self.options.get("framesPerTask", 50_000)))


class FrameReader(DataSourceStreamReader):
    def __init__(self, url: str, batch: int, task: int) -> None:
        self.url, self.batch, self.task = url.rstrip("/"), batch, task
        self.planned: dict[str, int] = {}

    def _get(self, path: str, **query):
        return urlopen(f"{self.url}/{path}" + (f"?{urlencode(query)}" if query else ""), timeout=PATIENCE)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        with self._get("offsets") as answer:
            kept = json.load(answer)
        # a batch is limited from where the last one ended: commits come only with the next
        return {m: min(end, max(first, self.planned.get(m, 0)) + self.batch) for m, (first, end) in sorted(kept.items())}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        self.planned = dict(end)
        return [Stretch(m, a, min(a + self.task, upto)) for m, upto in sorted(end.items()) for a in range(start.get(m, 0), upto, self.task)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        found = 0
        with self._get("frames", market=partition.market, after=partition.after, upto=partition.upto) as answer:
            for line in answer:
                found += 1
                yield tuple(json.loads(line))
        if found != partition.upto - partition.after:
            raise OSError(f"{partition}: the server gave {found} frames")

    def commit(self, end: dict) -> None:
        urlopen(Request(f"{self.url}/commit", json.dumps(end).encode(), method="POST"), timeout=PATIENCE).close()
