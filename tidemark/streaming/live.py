"""Live collection: raw records, live signals with their alerts, and sequence checks, from a stream of frames.

Every sink is a streaming file sink, so a restart from its checkpoint neither loses nor repeats rows.
Live state is keyed by market in RocksDB: a batch reads and writes a market's few values, appends its
trades to the window as one part, and takes off the parts that have left it.
Live detection differs from a replay on purpose: it follows arrival, drops records whose sequence id
does not rise, and starts anew with each connection (``epoch``). Raw records are always kept, and
nothing is dropped as late: a late row goes to the folder of its own date.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.config import Config
from tidemark.operators.detect import LEAST, WALL_LEFT, number, rationale, snapshot
from tidemark.operators.journal import EVENT
from tidemark.operators.paper import cooldown
from tidemark.plans import render
from tidemark.sources import market, store, wire
from tidemark.sources.frames import FRAMES, FrameSource

#: What the detector finds: signals (``alert`` when their rule is qualified), integrity_* rows, and ``stalled`` markets.
FOUND = "market string, ts bigint, receive_ns bigint, kind string, signal_type string, rule_id string, direction string, feature_value double, baseline double, evidence string, detail string, alert boolean"
#: ... as they are stored.
STORED = f"{FOUND}, rationale string, market_snapshot string, date date"
#: Alerts as they are sent.
SENT = f"{STORED}, rule_key string, emitted_at timestamp"
_VALUES = "epoch bigint, last_id string, total double, n bigint, first bigint, done bigint, next bigint, active array<string>, wall double, wall_side string"
#: Trades of one part of a window.
PART = 4096


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings while a query is started: it keeps a copy of them, the session's own are put back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Rolling:
    """The trades of one market's window with their count and sum. Stored parts are read one at a time and from
    the oldest on, when something of them leaves; what a batch adds is stored as parts of its own."""

    def __init__(self, parts, total: float, n: int, first: int, done: int, next_: int) -> None:
        self.parts, self.total, self.n = parts, total, n
        self.first, self.done, self.next = first, done, next_
        self.part: tuple[list, list] | None = None
        self.fresh: tuple[list, list] = ([], [])
        self.gone = 0  # of the fresh ones

    def clear(self) -> None:
        for k in range(self.first, self.next):
            self.parts.removeKey((k,))
        self.total, self.n, self.first, self.done = 0.0, 0, self.next, 0
        self.part, self.fresh, self.gone = None, ([], []), 0

    def expire(self, bound: int) -> None:
        """Take off what is older than ``bound``."""
        while self.n:
            stored = self.first < self.next
            if stored and self.part is None:
                times, notionals = self.parts.getValue((self.first,))
                self.part = list(times), list(notionals)
            times, notionals = self.part if stored else self.fresh
            at = self.done if stored else self.gone
            if times[at] >= bound:
                return
            self.total, self.n = self.total - notionals[at], self.n - 1
            if not stored:
                self.gone += 1
            elif at + 1 == len(times):
                self.parts.removeKey((self.first,))
                self.first, self.done, self.part = self.first + 1, 0, None
            else:
                self.done += 1
        self.total = 0.0

    def add(self, ts: int, notional: float) -> None:
        self.fresh[0].append(ts)
        self.fresh[1].append(notional)
        self.total, self.n = self.total + notional, self.n + 1

    def store(self) -> None:
        times, notionals = self.fresh[0][self.gone :], self.fresh[1][self.gone :]
        for k in range(0, len(times), PART):
            self.parts.updateValue((self.next,), (times[k : k + PART], notionals[k : k + PART]))
            self.next += 1


class Detector:
    """One market's state, a record at a time."""

    def __init__(self, config: Config, qualified: list[str], values: tuple | None, parts) -> None:
        self.config, self.qualified = config, qualified
        if values is None:
            values = (None, None, 0.0, 0, 0, 0, 0, [], None, None)
        self.epoch, last, total, n, first, done, next_, active, self.wall, self.wall_side = values
        self.last_id, self.active = None if last is None else int(last), set(active)
        self.window = Rolling(parts, total, n, first, done, next_)

    def start(self, epoch: int | None) -> None:
        """A new connection: nothing before it counts."""
        self.epoch, self.last_id, self.wall, self.wall_side, self.active = epoch, None, None, None, set()
        self.window.clear()

    def values(self) -> tuple:
        w = self.window
        w.store()
        return (self.epoch, None if self.last_id is None else str(self.last_id), float(w.total), w.n, w.first, w.done, w.next, sorted(self.active), self.wall, self.wall_side)

    def _fires(self, rule: str, active: bool) -> bool:
        """Whether ``rule`` turned active; an inactive record re-arms it."""
        was = rule in self.active
        (self.active.add if active else self.active.discard)(rule)
        return active and not was

    def _row(self, r, kind: str, signal_type=None, rule=None, direction=None, feature=None, baseline=None, evidence=None, detail=None) -> dict:
        alert = kind == "signal" and f"{signal_type}:{rule}" in self.qualified
        return {"market": r.market, "ts": r.ts, "receive_ns": r.receive_ns, "kind": kind, "signal_type": signal_type, "rule_id": rule, "direction": direction,
                "feature_value": feature, "baseline": baseline, "evidence": evidence and json.dumps(evidence), "detail": detail, "alert": alert}

    def take(self, r) -> list[dict]:
        if r.epoch != self.epoch:
            self.start(r.epoch)
        return self._trade(r) if r.is_trade else self._book(r)

    def _trade(self, r) -> list[dict]:
        if r.sequential_id is not None:
            found = int(r.sequential_id)
            if self.last_id is not None and found <= self.last_id:
                kind = "integrity_duplicate" if found == self.last_id else "integrity_out_of_order"
                return [self._row(r, kind, detail=f"{found} after {self.last_id}")]
            self.last_id = found
        window, notional, out = self.config.trade_rate_window_seconds, r.price * r.volume, []
        self.window.expire(r.ts - window * 1_000_000)
        n, total = self.window.n, self.window.total
        mean = total / max(n, 1)
        seen = {"source": "trade", "trigger": {"market": r.market, "ts": r.ts, "price": r.price, "volume": r.volume, "side": r.side}, "rolling_trade_count": n}
        for m in self.config.candidate.large_trade_multiples:
            if self._fires(rule := f"large-{number(m)}", n >= LEAST and notional > mean * m):
                out.append(self._row(r, "signal", "large_aggressive_trade", rule, r.side, notional, mean, seen | {"rolling_notional_sum": total, "rolling_notional_mean": mean}))
        rate, base = n / window, LEAST / window
        for m in self.config.candidate.trade_rate_multiples:
            if self._fires(rule := f"rate-{number(m)}", n >= LEAST and rate > base * m):
                out.append(self._row(r, "signal", "trade_rate_acceleration", rule, r.side, rate, base, seen | {"window_seconds": window, "rolling_rate_per_second": rate, "baseline_rate_per_second": base}))
        self.window.add(r.ts, notional)
        return out

    def _book(self, r) -> list[dict]:
        out, total = [], r.ask + r.bid
        seen = {"source": "orderbook", "total_bid_size": r.bid, "total_ask_size": r.ask, "levels": json.loads(r.levels or "[]")}
        if total > 0:
            lean = (r.bid - r.ask) / total
            for t in self.config.candidate.imbalance_thresholds:
                if self._fires(rule := f"imbalance-{number(t)}", abs(lean) >= t):
                    out.append(self._row(r, "signal", "orderbook_imbalance", rule, "buy" if lean > 0 else "sell", lean, 0.0, seen | {"imbalance": lean}))
        else:
            self.active -= {f"imbalance-{number(t)}" for t in self.config.candidate.imbalance_thresholds}
        if pd.isna(r.ask_wall):
            self.wall = self.wall_side = None
            return out
        wall, side = max(r.ask_wall, r.bid_wall), "sell" if r.ask_wall > r.bid_wall else "buy"
        if self.wall is not None and self.wall >= self.config.wall_min_krw and wall < self.wall * WALL_LEFT:
            out.append(self._row(r, "signal", "wall_disappearance", "wall-drop", self.wall_side, wall, self.wall, seen | {"previous_wall_krw": self.wall, "previous_wall_side": self.wall_side, "current_largest_wall_krw": wall, "current_largest_wall_side": side}))
        self.wall, self.wall_side = wall, side
        return out


class LiveDetector(StatefulProcessor):
    """A market's values and window parts as keyed state, and a timer that tells when nothing has come for too long."""

    def __init__(self, config: Config, qualified: list[str]) -> None:
        self.config, self.qualified = config, qualified

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getValueState("values", _VALUES)
        self.parts = handle.getMapState("parts", "part bigint", "times array<bigint>, notionals array<double>")

    def _quiet_until(self, now: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(now + self.config.stall_timeout_seconds * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        detector = Detector(self.config, self.qualified, self.values.get() if self.values.exists() else None, self.parts)
        batch = pd.concat(list(rows), ignore_index=True).sort_values("receive_ns", kind="stable")
        found = [x for r in batch.astype({"sequential_id": object}).itertuples(index=False) for x in detector.take(r)]
        self.values.update(detector.values())
        self._quiet_until(timerValues.getCurrentProcessingTimeInMs())
        if found:
            yield pd.DataFrame(found, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        row = dict.fromkeys(_COLUMNS) | {"market": key[0], "ts": at * 1000, "receive_ns": at * 1_000_000, "kind": "stalled", "detail": "no frame within stall timeout", "alert": False}
        yield pd.DataFrame([row], columns=_COLUMNS).astype({"feature_value": float, "baseline": float})

    def close(self) -> None:
        pass


_COLUMNS = [c.split()[0] for c in FOUND.split(", ")]
_STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def detect_live(records: DataFrame, config: Config, qualified: list[str]) -> DataFrame:
    """``records`` (is_trade, market, ts, receive_ns, epoch and the fields of trades or books) as a
    stream to FOUND rows. State per market: a few values, and its window's trades in parts. A batch's
    rows of a market are sorted by arrival in its task, so batches are to be limited at the source. A market of which
    nothing comes for the stall timeout gives one ``stalled`` row, whatever the others send."""
    return records.groupBy("market").transformWithStateInPandas(LiveDetector(config, qualified), FOUND, "append", "ProcessingTime")


def records_of(normalized: DataFrame) -> DataFrame:
    """Trades and books of normalized frames as one stream for the detector."""
    good = normalized.where("error is null")
    books = good.withColumn("levels", F.when(F.col("f.type") == "orderbook", F.col("f.orderbook_units")))
    is_trade = F.col("f.type") == "trade"
    return market.books_from_levels(books).select(
        is_trade.alias("is_trade"), F.col("f.code").alias("market"), (F.col("f.timestamp") * 1000).alias("ts"), "receive_ns", "epoch",
        F.col("f.sequential_id").cast("string").alias("sequential_id"), F.col("f.trade_price").alias("price"), F.col("f.trade_volume").alias("volume"),
        F.when(F.col("f.ask_bid") == "BID", "buy").otherwise("sell").alias("side"),
        F.col("f.total_ask_size").alias("ask"), F.col("f.total_bid_size").alias("bid"), "ask_wall", "bid_wall", F.to_json("levels").alias("levels"),
    )


def _sink(df: DataFrame, root: str, dataset: str, checkpoint: str, kind: str = "parquet", by: tuple[str, ...] = ("date", "market"), more: dict[str, str] | None = None, **trigger) -> StreamingQuery:
    placed = df.repartition(*by) if len(by) > 1 else df
    writer = (
        placed.writeStream.format(kind).option("path", f"{root}/{dataset}").option("checkpointLocation", f"{checkpoint}/{dataset}")
        .option("compression", "zstd" if kind == "parquet" else "none").partitionBy(*by).trigger(**trigger).queryName(dataset).outputMode("append")
    )
    with settings(df.sparkSession, more or {}):
        return writer.start()


def land(spark: SparkSession, url: str, frames: str, checkpoint: str, once: bool = False, seconds: int = 5, **options: int) -> StreamingQuery:
    """Fetch frames from the server at ``url`` and keep them as JSON files in the folder ``frames``, which any number
    of queries follow; those that are stored are committed to the server."""
    spark.dataSource.register(FrameSource)
    found = spark.readStream.format(FrameSource.name()).option("url", url).options(**options).load()
    trigger = {"availableNow": True} if once else {"processingTime": f"{seconds} seconds"}
    return found.writeStream.format("json").option("path", frames).option("checkpointLocation", f"{checkpoint}/frames").trigger(**trigger).queryName("frames").outputMode("append").start()


def collect(frames: DataFrame, root: str, checkpoint: str, config: Config, qualified: list[str], once: bool = False) -> list[StreamingQuery]:
    """Start collection from a stream of FRAMES rows: ``trades`` and ``orderbooks`` as JSON payloads,
    ``dead_letters``, and ``live_events``. ``once`` takes what is there and ends; otherwise files are
    written every flush interval. Each batch of records is counted where it is made (see ``progress``)."""
    config.check()
    trigger = {"availableNow": True} if once else {"processingTime": f"{config.flush_interval_seconds} seconds"}
    normalized = wire.normalize(frames)
    day = F.to_date(F.timestamp_millis("ts_ms"))
    sinks = []
    for name, part in (("trades", wire.trades), ("orderbooks", wire.orderbooks)):
        rows = part(normalized, "receive_ns", "epoch")
        rows = rows.observe(f"taken_{name}", F.count(F.lit(1)).alias("records"), F.collect_set("market").alias("markets"))
        sinks.append(_sink(rows.select(F.to_json(F.struct(*rows.columns)).alias("payload"), day.alias("date"), "market"), root, name, checkpoint, **trigger))
    bad = normalized.where("error is not null").select("frame", "error", "receive_ns", F.to_date(F.timestamp_micros((F.col("receive_ns") / 1000).cast("bigint"))).alias("date"))
    sinks.append(_sink(bad, root, "dead_letters", checkpoint, by=("date",), **trigger))
    found = detect_live(records_of(normalized), config, qualified)
    found = snapshot(found.withColumn("rationale", rationale(config.trade_rate_window_seconds, config.wall_min_krw))).withColumn("date", F.to_date(F.timestamp_micros("ts")))
    # taking what is there ends with the last record, without waiting for timers
    more = _STATE_STORE | ({"spark.sql.streaming.noDataMicroBatches.enabled": "false"} if once else {})
    return [*sinks, _sink(found, root, "live_events", checkpoint, more=more, **trigger)]


def finish(query: StreamingQuery) -> None:
    """Stop a query once what has arrived is through. Timers give the live detector batches without end, so it is through
    when a later batch had nothing to read."""
    if query.isActive and query.name == "live_events":
        seen = query.lastProgress["batchId"] if query.lastProgress else -1
        while query.isActive:
            now = query.lastProgress
            if now and now["batchId"] > seen and not now["numInputRows"]:
                break
            time.sleep(0.1)
    elif query.isActive:
        query.processAllAvailable()
    query.stop()


def _alerts_before(spark: SparkSession, root: str, batch: int) -> DataFrame:
    """(market, rule_key, last): when an alert was last sent, by batches before this one."""
    path = f"{root}/alerts"
    fs, place = store._fs(spark, path)
    if not fs.exists(place):
        return spark.createDataFrame([], "market string, rule_key string, last bigint")
    sent = spark.read.schema(f"{SENT}, batch bigint").json(path).where(F.col("batch") < batch)
    return sent.groupBy("market", "rule_key").agg(F.max("ts").alias("last"))


def due_alerts(found: DataFrame, before: DataFrame, seconds: int) -> DataFrame:
    """Those of ``found`` (signals of qualified rules) that no alert of their market and rule, sent before or among
    them, is within ``seconds`` of."""
    keyed = found.withColumn("rule_key", F.concat_ws(":", "signal_type", "rule_id"))
    later = keyed.join(before, ["market", "rule_key"], "left").where(F.col("last").isNull() | (F.col("ts") >= F.col("last") + seconds * 1_000_000)).drop("last")
    return cooldown(later, ["market", "rule_key"], seconds, ["ts", "receive_ns"]).where("emitted").drop("emitted")


def send_alerts(spark: SparkSession, root: str, checkpoint: str, config: Config, results: dict[str, dict], window: dict, once: bool = False, show: Callable[[str], None] = print) -> StreamingQuery:
    """Follow ``live_events``: write each batch's alerts that are due as JSON lines under alerts/batch=N, and then show them
    with their rules' validation records.

    What has been written is what the cooldown counts: a batch that is not written sends nothing and pauses
    nothing, and one that is repeated overwrites itself. Alerts that cannot be written or shown
    are an ``alert_error`` in the connection events; their signals are stored all the same."""
    events = spark.readStream.schema(STORED).parquet(f"{root}/live_events")

    def run(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        try:
            due = due_alerts(batch.where("alert"), _alerts_before(session, root, number), config.alert.cooldown_seconds)
            path = f"{root}/alerts/batch={number}"
            due.withColumn("emitted_at", F.current_timestamp()).write.mode("overwrite").json(path)
            for row in session.read.schema(SENT).json(path).orderBy("ts", "market").toLocalIterator():
                show(render.alert(row.asDict(), results.get(row.rule_key), window))
        except Exception as why:  # noqa: BLE001 - whatever the store, the terminal or the pipe raises
            store.append(connection_events(session, [("alert_error", str(why)[:1000], None)]), root, "connection_events")

    trigger = {"availableNow": True} if once else {"processingTime": "10 seconds"}
    return events.writeStream.foreachBatch(run).option("checkpointLocation", f"{checkpoint}/alerts").trigger(**trigger).queryName("alerts").start()


def connection_events(spark: SparkSession, events: list[tuple], now: float | None = None) -> DataFrame:
    """Rows of ``connection_events`` for (state, detail, gap_ms, ...) at ``now`` or the time each ends with."""
    rows = [("ALL", int((e[3] if len(e) > 3 else now or time.time()) * 1_000_000), *e[:3]) for e in events]
    return spark.createDataFrame(rows, EVENT).withColumn("date", F.to_date(F.timestamp_micros("ts")))
