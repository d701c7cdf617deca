"""The universe of markets, fetched from an exchange's public pages in chunks that tasks ask for."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urlencode
from urllib.request import urlopen

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Markets that one page of tickers may name.
CHUNK = 100
#: Seconds that a page may take.
PATIENCE = 30


def tickers(spark: SparkSession, url: str, prefix: str = "KRW-", chunk: int = CHUNK) -> DataFrame:
    """(market, volume, ordinal) of all markets whose name starts with ``prefix``: the day's traded value and the place
    in the exchange's order, as ``wire.universe`` ranks them. A market without either is left out.

    The list of names is one page; tickers are asked for in chunks of ``chunk`` names, each by a task of its own.
    A page that cannot be had or read is an error."""
    with urlopen(f"{url}/v1/market/all?isDetails=true", timeout=PATIENCE) as page:
        names = [m["market"] for m in json.load(page) if str(m.get("market", "")).startswith(prefix)]
    chunks = [(first, ",".join(names[first : first + chunk])) for first in range(0, len(names), chunk)]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, markets in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                with urlopen(f"{url}/v1/ticker?{urlencode({'markets': markets})}", timeout=PATIENCE) as page:
                    found = [(t.get("market"), t.get("acc_trade_price_24h"), first + k) for k, t in enumerate(json.load(page))]
                found = [t for t in found if isinstance(t[0], str) and isinstance(t[1], int | float)]
                columns = list(zip(*found)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64())], ["market", "volume", "ordinal"])

    pages = spark.createDataFrame(chunks, "first bigint, markets string").repartition(max(1, len(chunks)), "first")
    return pages.mapInArrow(fetch, "market string, volume double, ordinal bigint")
