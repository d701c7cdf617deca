"""Collection from frames to reports, on a small archive whose signals are planted."""

import base64
import hashlib
import io
import json
import os
import random
import socket
import struct
import threading
import time
from collections import Counter
from contextlib import redirect_stdout
from datetime import UTC, datetime

import pytest

from tidemark import __main__ as cli
from tidemark import config as settings
from tidemark.operators import detect, journal
from tidemark.plans import render, study
from tidemark.sources import frames
from tidemark.streaming import exchange, feed, gateway, live, progress

BASE = int(datetime(2025, 1, 1, tzinfo=UTC).timestamp()) * 1000


def _trade(ms, price, market="KRW-A", volume=1.0, seq=None, side="BID"):
    return ms, {"type": "trade", "code": market, "timestamp": ms, "trade_price": price, "trade_volume": volume, "ask_bid": side, **({"sequential_id": seq} if seq is not None else {})}


def _book(ms, ask, bid, market="KRW-A", wall=None):
    unit = {"ask_price": 100.0, "bid_price": 99.0, "ask_size": wall or ask, "bid_size": bid}
    return ms, {"type": "orderbook", "code": market, "timestamp": ms, "total_ask_size": ask, "total_bid_size": bid, "orderbook_units": [] if wall == 0 else [unit]}


def _write(path, frames, epochs=None):
    path.mkdir(exist_ok=True)
    rows = [{"frame": f if isinstance(f, str) else json.dumps(f), "receive_ns": ms * 1_000_000 + i, "epoch": epochs[i] if epochs else 0} for i, (ms, f) in enumerate(frames)]
    half = len(rows) // 2
    for name, part in (("a", rows[:half]), ("b", rows[half:])):
        (path / f"{name}.json").write_text("\n".join(map(json.dumps, part)) + "\n")


def _config(tmp_path, **validation):
    c = settings.Config(data_root=str(tmp_path / "data"))
    c.candidate = settings.Candidate([0.4], [3.0], [2.0])
    for k, v in (dict(tuning_days=2, validation_days=2, min_validation_signals=1, bootstrap_iterations=200) | validation).items():
        setattr(c.validation, k, v)
    return c


def _collect(spark, tmp_path, config, rules=(), files=1):
    frames = spark.readStream.schema(live.FRAMES).option("maxFilesPerTrigger", files).json(str(tmp_path / "frames"))
    for q in live.collect(frames, config.data_root, str(tmp_path / "state"), config, list(rules), once=True):
        q.awaitTermination()


def _archive():
    """Per day three buy-heavy books with prices 1 percent up 15 minutes later, and flat prices after."""
    frames = []
    for day in range(4):
        for start in (0, 120, 240):
            at = BASE + day * 86_400_000 + start * 60_000
            frames += [_book(at, 50.0, 50.0), _book(at + 1000, 20.0, 80.0), _trade(at + 2000, 100.0)]
            frames += [_trade(at + 10 * 60_000, 101.0), _trade(at + 16 * 60_000, 101.0)] + [_trade(at + (20 + 3 * k) * 60_000, 101.0) for k in range(30)]
    return frames


def _say(spark, config, *argv):
    out = io.StringIO()
    with redirect_stdout(out):
        assert cli.run(cli._parser().parse_args(list(argv)), config, spark) == 0
    return out.getvalue()


def test_from_frames_to_reports(spark, tmp_path):
    config = _config(tmp_path)
    _write(tmp_path / "frames", _archive() + [(BASE, {"type": "trade", "code": "KRW-A", "timestamp": BASE}), (BASE, "not json")])
    with pytest.raises(study.Blocked):
        study.ruleset(spark, config)
    with pytest.raises(ValueError):
        study.analyze(spark, config)  # nothing there
    _collect(spark, tmp_path, config)
    assert spark.read.parquet(f"{config.data_root}/dead_letters").count() == 2
    assert study.trades(spark, config.data_root).count() == 4 * 3 * 33
    audit = study.analyze(spark, config)
    chosen = {r["rule_key"]: r for r in audit["results"]}
    rule = chosen["orderbook_imbalance:imbalance-0.4"]
    assert rule["val_n"] == 6 and rule["val_rate"] == 1.0 and rule["retention"] == 1.0
    assert audit["tuning_end"] == "2025-01-02" and audit["validation_start"] == "2025-01-03"
    text = _say(spark, config, "report")
    assert "GATE: " in text and "| orderbook_imbalance | orderbook_imbalance:imbalance-0.4 | 2025-01-01–2025-01-02 |" in text
    lines = _say(spark, config, "report", "--csv").splitlines()
    assert lines[0] == render.EVALUATION_COLUMNS and all(x.count(",") == 17 for x in lines)
    shown = _say(spark, config, "coverage")  # quiet for 90 s: 32 times a block, 2 between blocks, 1 before the next day
    assert "| 2025-01-01 | 99 | 6 | 3 | 1 | 0 | 99 | 0 | 0 |" in shown and "4 of 4 required contiguous UTC dates present" in shown
    assert rule["passed"]
    paper = _say(spark, config, "paper", "--csv").splitlines()
    assert paper[0] == render.PAPER_COLUMNS and paper[1].startswith("rule,orderbook_imbalance:imbalance-0.4,6,0,0,1.0000,") and paper[-1].startswith("VERDICT: STRATEGY WINS by ")
    assert "Window: 2025-01-03–2025-01-04 (validation only) · 1 market · horizon 15m · fees 5bps, slippage 3bps" in _say(spark, config, "paper")
    events = [json.loads(x) for x in _say(spark, config, "alert", "--json").splitlines()]
    assert len(events) == 12 and events[0]["rationale"] == "bid/ask size imbalance 0.600 (threshold 0.40, bid-heavy)"
    assert _say(spark, config, "alert").startswith("ALERT 2025-01-01T00:00:01+00:00  KRW-A  BUY  orderbook_imbalance\n  why:   bid/ask size")
    stored = spark.read.parquet(f"{config.data_root}/signals").first()
    assert stored.rationale and json.loads(stored.market_snapshot)["evidence"]["source"] in ("trade", "orderbook")
    config.alert.cooldown_seconds = 1  # no part of the fingerprint
    assert study.ruleset(spark, config)["config_fingerprint"].startswith("fnv1a64:")
    with pytest.raises(study.Blocked, match="qualified rule x:y has no passed validation result"):
        study.qualified(audit | {"rules": ["x:y"]})
    config.paper.fee_bps = 6.0
    with pytest.raises(study.Blocked, match="other settings"):
        study.ruleset(spark, config)


def test_candidates_are_those_of_the_window(spark, tmp_path):
    """A day before the window with a rule that fires only there: it is no candidate, its signals stay stored."""
    config = _config(tmp_path)
    config.candidate.large_trade_multiples = [50.0]
    early = BASE - 86_400_000
    _write(tmp_path / "frames", [_trade(early + k * 1000, 100.0) for k in range(6)] + [_trade(early + 7000, 100.0, volume=1000.0)] + _archive())
    _collect(spark, tmp_path, config)
    audit = study.analyze(spark, config)
    assert audit["tuning_start"] == "2025-01-01" and [r["rule_key"] for r in audit["candidates"] if "large" in r["rule_key"]] == []
    stored = study.store.read(spark, config.data_root, "signals", study.StructType.fromDDL("ts bigint, rule_id string"))
    assert stored.where("rule_id = 'large-50'").count() == 1


def test_signals_and_alerts_in_the_order_of_events(spark, tmp_path):
    """At one time books come before trades, then receipt, whatever the market, then rules as configured."""
    config = _config(tmp_path)
    config.candidate = settings.Candidate([0.8, 0.4], [3.0, 2.0], [2.0])
    warm = [x for m in "BA" for k in range(6) for x in (_trade(BASE + k, 10.0, f"KRW-{m}"), _book(BASE + k, 50.0, 50.0, f"KRW-{m}"))]
    at = BASE + 1000
    _write(tmp_path / "frames", warm + [_trade(at, 100.0, "KRW-B"), _book(at, 1.0, 99.0, "KRW-B"), _trade(at, 100.0, "KRW-A"), _book(at, 1.0, 99.0, "KRW-A")])
    _collect(spark, tmp_path, config)
    found = study.signals(study.trades(spark, config.data_root), study.books(spark, config.data_root), config)
    got = [(r.market[-1], r.rule_id) for r in found.where(f"ts = {at * 1000}").orderBy(*detect.EVENT_ORDER).collect()]
    assert got == [(m, f"imbalance-{t}") for m in "BA" for t in ("0.8", "0.4")] + [(m, f"large-{k}") for m in "BA" for k in (3, 2)]


@pytest.mark.parametrize(("rationale", "evidence", "why"), [(" ", "{}", "rationale must not be empty"), (None, "{}", "rationale"), ("x", None, "evidence must not be null")])
def test_a_signal_says_why(spark, rationale, evidence, why):
    df = spark.createDataFrame([(rationale, evidence)], "rationale string, evidence string")
    with pytest.raises(Exception, match=why):
        detect.checked(df).collect()


def test_a_feed_that_fails_ends_collection(spark, tmp_path):
    config, calls = _config(tmp_path), []

    def universe():
        calls.append(1)
        if len(calls) > 1:
            raise OSError("universe unreachable")
        return ["KRW-A"]

    f = feed.Feed(spark, config, gateway.FrameLog(), universe, lambda markets: None, say=lambda x: None)
    f._refresh_due = lambda: True
    f.watched()
    assert str(f.failed) == "universe unreachable"
    with pytest.raises(OSError, match="universe unreachable"):
        cli._until_stopped([], f, type("Done", (), {"join": lambda self: None})())


def test_no_qualified_rule_blocks_paper(spark, tmp_path, capsys):
    config = _config(tmp_path, min_validation_signals=100)
    _write(tmp_path / "frames", _archive())
    _collect(spark, tmp_path, config)
    study.analyze(spark, config)
    assert "insufficient validation sample (6/100)" in _say(spark, config, "report")
    assert _say(spark, config, "paper") == "paper blocked: no validation-qualified rules\n" and _say(spark, config, "alert") == ""
    assert "alerts blocked: no validation-qualified rules" in capsys.readouterr().err


def test_live_detection_equals_replay_when_nothing_is_filtered(spark, tmp_path):
    config, rng, ms, frames = _config(tmp_path), random.Random(3), BASE, []
    config.wall_min_krw, config.trade_rate_window_seconds = 5_000.0, 40
    for _ in range(400):
        ms += rng.choice([0, 500, 1000, 3000, 9000])
        market = rng.choice(["KRW-A", "KRW-B"])
        frames.append(_trade(ms, float(rng.randint(1, 400)), market) if rng.random() < 0.7 else _book(ms, float(rng.randint(0, 99)), float(rng.randint(0, 99)), market, rng.choice([None, 0, 5.0])))
    _write(tmp_path / "frames", frames)
    _collect(spark, tmp_path, config)
    columns = ["market", "ts", "signal_type", "rule_id", "direction", "feature_value", "baseline", "rationale"]
    rows = lambda df: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect()), key=str)
    found = rows(study.live_events(spark, config.data_root).where("kind = 'signal'"))
    signals = study.signals(study.trades(spark, config.data_root), study.books(spark, config.data_root), config)
    replayed = rows(signals)
    assert sorted(set(found) ^ set(replayed), key=str) == []
    names = ("source", "rolling_trade_count", "window_seconds", "total_bid_size", "previous_wall_side", "levels")

    def seen(df):
        both = [(r, json.loads(r.market_snapshot)) for r in df.collect()]
        assert all(set(s) == {"market", "exchange_ts", "feature", "baseline", "evidence"} and s["market"] == r.market for r, s in both)
        return sorted(str((r.market, r.ts, r.rule_id, [s["evidence"].get(n) for n in names])) for r, s in both)

    assert seen(study.live_events(spark, config.data_root).where("kind = 'signal'")) == seen(detect.snapshot(signals))
    assert found == replayed and {r[2] for r in found} == {"large_aggressive_trade", "trade_rate_acceleration", "orderbook_imbalance", "wall_disappearance"}


def test_live_sequence_checks_epochs_and_cooldown(spark, tmp_path):
    config = _config(tmp_path)
    big = 2**63 + 5
    frames = [_trade(BASE, 1.0, seq=10), _trade(BASE + 1, 1.0, seq=10), _trade(BASE + 2, 1.0, seq=9), _trade(BASE + 3, 1.0), _trade(BASE + 4, 1.0, seq=big), _trade(BASE + 5, 1.0, seq=7)]
    minutes = [0, 1, 2, 15, 16]
    for m in minutes:  # each turns active anew
        frames += [_book(BASE + m * 60_000 + 10, 50.0, 50.0), _book(BASE + m * 60_000 + 20, 10.0, 90.0)]
    epochs = [0] * 5 + [1] + [1] * 10
    _write(tmp_path / "frames", frames, epochs)
    _collect(spark, tmp_path, config, ["orderbook_imbalance:imbalance-0.4"])
    events = study.live_events(spark, config.data_root)
    checks = events.where("kind like 'integrity%'").orderBy("receive_ns").select("kind", "detail").collect()
    assert [tuple(r) for r in checks] == [("integrity_duplicate", "10 after 10"), ("integrity_out_of_order", "9 after 10")]
    assert study.trades(spark, config.data_root).count() == 6  # raw records stay
    links = study.connections(spark, config).orderBy("ts", "state").select("state", "gap_ms").collect()
    assert [tuple(r) for r in links if r.state != "stalled"] == [("connected", None), ("disconnected", None), ("connected", 1)] and sum(r.state == "stalled" for r in links) == 1
    assert events.where("kind = 'signal' and alert").count() == 5
    for _ in range(2):  # nothing is sent again
        live.send_alerts(spark, config.data_root, str(tmp_path / "state"), config, {}, {}, once=True, show=lambda x: None).awaitTermination()
    sent = spark.read.schema(live.SENT).json(f"{config.data_root}/alerts").orderBy("ts").collect()
    assert [(r.ts // 1000 - BASE - 20) // 60_000 for r in sent] == [0, 15]


def test_an_older_ruleset_is_an_error(spark, tmp_path):
    config = _config(tmp_path)
    df = spark.createDataFrame([('{"generated_at": "2025"}',)], "payload string").selectExpr("payload", "date'2025-01-01' as date", "'ALL' as market")
    study.store.append(df, config.data_root, "active_rule_sets")
    with pytest.raises(study.Blocked, match="older format"):
        study.ruleset(spark, config)


def test_an_alert_that_cannot_be_shown_is_recorded(spark, tmp_path):
    config, shown = _config(tmp_path), []
    _write(tmp_path / "frames", [_book(BASE, 50.0, 50.0), _book(BASE + 1, 10.0, 90.0, "KRW-A"), _book(BASE + 2, 10.0, 90.0, "KRW-B")])
    _collect(spark, tmp_path, config, ["orderbook_imbalance:imbalance-0.4"])

    def show(text):
        if "KRW-A" in text:
            raise OSError("no terminal")
        shown.append(text)

    live.send_alerts(spark, config.data_root, str(tmp_path / "state"), config, {}, {}, once=True, show=show).awaitTermination()
    assert shown == []
    links = study.connections(spark, config).where("state = 'alert_error'").collect()
    assert len(links) == 1 and study.live_events(spark, config.data_root).where("alert").count() == 2


def test_alerts_that_cannot_be_written_pause_nothing(spark, tmp_path, monkeypatch):
    """The cooldown counts what is written: after a failure the next signal of the rule is due; a batch that is
    repeated is neither doubled nor paused by itself."""
    config, shown = _config(tmp_path), []
    rows = lambda minutes: spark.createDataFrame([("KRW-A", (BASE + m * 60_000) * 1000, m, "signal", "orderbook_imbalance", "imbalance-0.4", "buy", 0.5, 0.0, "{}", None, True, "why", "{}") for m in minutes], live.STORED.removesuffix(", date date"))
    send = lambda: live.send_alerts(spark, config.data_root, str(tmp_path / "state"), config, {}, {}, once=True, show=shown.append).awaitTermination()
    put = lambda minutes: rows(minutes).withColumn("date", study.utc_date()).coalesce(1).write.mode("append").partitionBy("date").parquet(f"{config.data_root}/live_events")
    put([0])
    with monkeypatch.context() as m:
        m.setattr(live, "due_alerts", lambda *args: (_ for _ in ()).throw(OSError("disk full")))
        send()
    assert shown == [] and [r.detail for r in spark.read.parquet(f"{config.data_root}/connection_events").collect()] == ["disk full"]
    put([1, 2, 17])
    send()
    assert len(shown) == 2 and "validation record unavailable" in shown[0]
    sent = spark.read.schema(live.SENT + ", batch bigint").json(f"{config.data_root}/alerts")
    assert sorted((r.receive_ns, r.batch) for r in sent.collect()) == [(1, 1), (17, 1)]
    again = live.due_alerts(rows([1, 2, 17]), live._alerts_before(spark, config.data_root, 1), 900)  # the same batch once more
    assert sorted(r.receive_ns for r in again.collect()) == [1, 17]
    assert live.due_alerts(rows([18, 31, 32]), live._alerts_before(spark, config.data_root, 2), 900).count() == 1


def test_progress_is_what_batches_observe(spark, tmp_path):
    config, said, now = _config(tmp_path), [], [0.0]
    _write(tmp_path / "frames", [_trade(BASE + k, 1.0, f"KRW-{'AB'[k % 2]}") for k in range(7)] + [_book(BASE, 1.0, 2.0, "KRW-C")])
    counted = progress.Progress(said.append, lambda: now.append(now[-1] + 6) or now[-1])
    spark.streams.addListener(counted)
    try:
        _collect(spark, tmp_path, config)
        for _ in range(100):  # listeners are told a little later
            if counted.records == {"trades": 7, "orderbooks": 1} and counted.state_rows:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(counted)
    assert counted.records == {"trades": 7, "orderbooks": 1} and counted.markets == {"KRW-A", "KRW-B", "KRW-C"} and counted.errors == 0
    assert "markets=3 orderbooks=1 trades=7 state=" in counted.line() and said


def test_windows_go_on_in_parts_between_batches(spark, tmp_path, monkeypatch):
    """Many small batches, parts of three trades, quiet times and a new connection against one sequential pass."""
    monkeypatch.setattr(live, "PART", 3)
    config, rng, ms = _config(tmp_path), random.Random(9), BASE
    config.trade_rate_window_seconds = 30
    config.candidate = settings.Candidate([0.4], [1.5, 2.0], [1.2, 2.0])
    frames, epochs = [], []
    for k in range(300):
        ms += rng.choice([0, 200, 1000, 4000, 70_000 if k % 50 == 0 else 0])
        frames.append(_trade(ms, float(rng.randint(1, 90)), rng.choice(["KRW-A", "KRW-B"])))
        epochs.append(k // 200)
    (tmp_path / "frames").mkdir()
    rows = [{"frame": json.dumps(f), "receive_ns": m * 1_000_000 + i, "epoch": epochs[i]} for i, (m, f) in enumerate(frames)]
    for n in range(6):
        path = tmp_path / "frames" / f"{n}.json"
        path.write_text("\n".join(map(json.dumps, rows[n * 50 : n * 50 + 50])) + "\n")
        os.utime(path, (n + 1, n + 1))
    _collect(spark, tmp_path, config)
    got = sorted((r.receive_ns, r.rule_id, r.feature_value, round(r.baseline, 6)) for r in study.live_events(spark, config.data_root).where("kind = 'signal'").collect())
    want, seen, armed = [], {}, set()
    for r, (m, f) in zip(rows, frames):
        key = (f["code"], r["epoch"])
        past = seen[key] = [x for x in seen.get(key, []) if x[0] >= m - 30_000]
        n, mean = len(past), sum(x[1] for x in past) / max(len(past), 1)
        for rule, value, base, on in [(f"large-{x}", f["trade_price"], mean, n >= 5 and f["trade_price"] > mean * float(x)) for x in ("1.5", "2")] + [(f"rate-{x}", n / 30, 5 / 30, n >= 5 and n / 30 > 5 / 30 * float(x)) for x in ("1.2", "2")]:
            if on and (*key, rule) not in armed:
                want.append((r["receive_ns"], rule, value, round(base, 6)))
            (armed.add if on else armed.discard)((*key, rule))
        past.append((m, f["trade_price"]))
    assert got == sorted(want) and len(want) > 20


def test_queries_stop_when_what_arrived_is_through(spark, tmp_path):
    config = _config(tmp_path)
    config.flush_interval_seconds = 1
    _write(tmp_path / "frames", [_trade(BASE + k, 1.0) for k in range(20)] + [_book(BASE, 50.0, 50.0), _book(BASE + 1, 10.0, 90.0)])
    frames = spark.readStream.schema(live.FRAMES).option("maxFilesPerTrigger", 1).json(str(tmp_path / "frames"))
    running = live.collect(frames, config.data_root, str(tmp_path / "state"), config, [])
    for q in running:
        live.finish(q)
    assert not any(q.isActive for q in running)
    assert study.trades(spark, config.data_root).count() == 20 and study.live_events(spark, config.data_root).where("signal_type = 'orderbook_imbalance'").count() == 1


def test_a_market_without_frames_is_stalled_while_others_send(spark, tmp_path):
    config, folder = _config(tmp_path), tmp_path / "frames"
    config.stall_timeout_seconds = 4
    _write(folder, [_trade(BASE, 1.0, "KRW-A"), _trade(BASE, 1.0, "KRW-B")])
    frames = spark.readStream.schema(live.FRAMES).json(str(folder))
    with live.settings(spark, live._STATE_STORE):
        found = live.detect_live(live.records_of(live.wire.normalize(frames)), config, [])
        query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    stalled, end = [], time.time() + 90
    try:
        while time.time() < end and not stalled:
            aside = tmp_path / "aside.json"  # B goes on
            aside.write_text(json.dumps({"frame": json.dumps(_trade(BASE + 1, 1.0, "KRW-B")[1]), "receive_ns": time.time_ns(), "epoch": 0}) + "\n")
            aside.rename(folder / f"{time.time_ns()}.json")
            time.sleep(0.5)
            stalled = [r.market for r in spark.read.schema(live.FOUND).parquet(str(tmp_path / "out")).where("kind = 'stalled'").collect()] if list((tmp_path / "out").glob("*.parquet")) else []
    finally:
        query.stop()
    assert stalled == ["KRW-A"]


def test_feed_states_stalls_pauses_and_refresh(spark, tmp_path):
    config = _config(tmp_path)
    config.stall_timeout_seconds, config.flush_interval_seconds, config.daily_refresh_utc_hour = 3, 5, 1
    now, waits, said = [BASE / 1000 + 23 * 3600], [], []
    frame = json.dumps(_trade(BASE, 1.0)[1])

    def receiver(steps):
        """Each step: seconds that pass, and a frame, None (nothing comes) or an error."""
        steps = iter(steps)

        def receive(seconds):
            passed, what = next(steps)
            now[0] += passed
            if what is None:
                raise TimeoutError
            if isinstance(what, Exception):
                raise what
            return what

        return receive

    plan = [OSError("refused"), OSError("refused"), [(1, frame), (1, frame), (1, OSError("reset"))], [(1, frame), (1, None), (3, None)], [(1, frame), (7200, frame)], [(1, frame), (1, OSError("end"))]]

    def connect(markets):
        step = plan.pop(0)
        if isinstance(step, Exception):
            raise step
        return receiver(step)

    log = gateway.FrameLog()
    f = feed.Feed(spark, config, log, lambda: ["KRW-A"], connect, lambda: now[0], said.append)
    f.stop.wait = lambda seconds: (waits.append(seconds), now.__setitem__(0, now[0] + seconds))
    f.run(connections=6)
    states = [(r.state, r.gap_ms) for r in spark.read.schema(f"{journal.EVENT}, date date").parquet(f"{config.data_root}/connection_events").orderBy("ts").collect()]
    names = [s for s, _ in states]
    assert waits == [1, 2, 1, 1, 1]  # doubling while refused, anew after a connection
    assert Counter(names) == Counter(connecting=6, connect_failed=2, reconnect=5, connected=4, disconnected=2, stalled=1, universe_refresh_due=1, universe_changed=1)
    assert dict(states)["reconnect"] == 1000 and ("connected", 3000) in states and ("connected", 1000) in states
    rows = log.stretch("KRW-A", 0, 100)
    assert len(rows) == f.taken == 6 and {r[2] for r in rows} == {0, 1, 2, 3}
    universes = spark.read.parquet(f"{config.data_root}/universes").orderBy("refreshed_at").collect()
    assert [(r.markets, str(r.date)) for r in universes] == [(["KRW-A"], "2025-01-01"), (["KRW-A"], "2025-01-02")]
    assert said[-1].endswith("frames=6 waiting=6") and any("waiting=" in s for s in said[:-1])


def test_a_full_log_waits_for_commits(spark, tmp_path):
    config, log, calls = _config(tmp_path), gateway.FrameLog(most=3), []
    f = feed.Feed(spark, config, log, lambda: ["KRW-A"], lambda markets: receive, say=lambda x: None)

    def receive(seconds):
        calls.append(log.waiting)
        if len(calls) == 4:
            threading.Timer(0.3, log.commit, [{"KRW-A": 2}]).start()
        if len(calls) == 6:
            threading.Timer(0.3, f.stop.set).start()
        return json.dumps(_trade(BASE, float(len(calls)))[1])

    f.run()
    assert calls == [0, 1, 2, 3, 2, 3] and f.taken == 5  # the sixth found no room before the stop
    assert [json.loads(x[0])["trade_price"] for x in log.stretch("KRW-A", 2, 9)] == [3.0, 4.0, 5.0] and log.offsets() == {"KRW-A": [2, 5]}


def test_frames_from_a_server_are_neither_lost_nor_repeated(spark, tmp_path):
    """Batches of a few frames in several tasks, a restart between them, and one after a batch that was planned, not stored."""
    log = gateway.FrameLog()
    server = gateway.Gateway(log)
    put = lambda first, n: [log.add(json.dumps(_trade(BASE + k, 1.0, f"KRW-{'AB'[k % 3 == 0]}", seq=k)[1]) if k % 10 else "no json", k, 0) for k in range(first, first + n)]
    stored = lambda: sorted(r.receive_ns for r in spark.read.schema(live.FRAMES).json(str(tmp_path / "frames")).collect())
    run = lambda **options: live.land(spark, server.url, str(tmp_path / "frames"), str(tmp_path / "state"), **options)
    try:
        put(0, 50)
        run(once=True, framesPerTask=7).awaitTermination()
        assert stored() == list(range(50))
        put(50, 40)
        run(once=True, framesPerTask=3).awaitTermination()
        assert stored() == list(range(90))
        # the last batch as if its files had been written and its commit had not
        for name in ("1", ".1.crc"):
            (tmp_path / "state" / "frames" / "commits" / name).unlink()
        put(90, 30)
        query = run(seconds=1, framesPerBatch=4, framesPerTask=3)
        end = time.time() + 60
        while stored() != list(range(120)) and time.time() < end:
            time.sleep(0.3)
        query.stop()
        assert stored() == list(range(120))
        assert log.waiting < 120 - 90 + 1  # what is stored has been committed, but for the last batch
    finally:
        server.close()


def test_collect_with_a_feed_from_the_command_line(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "my_feed.py").write_text("""
class Source:
    def universe(self):
        return ["KRW-A"]
    def connect(self, markets):
        frames = iter(FRAMES)
        def receive(seconds):
            for f in frames:
                return f
            raise OSError("end")
        return receive
FRAMES = %r
""" % [json.dumps(_trade(BASE + k, 1.0, seq=k)[1]) for k in range(9)])
    monkeypatch.syspath_prepend(str(tmp_path))
    config = _config(tmp_path)
    _say(spark, config, "collect", "--frames", str(tmp_path / "frames"), "--checkpoint", str(tmp_path / "state"), "--once", "--feed", "my_feed:Source")
    assert study.trades(spark, config.data_root).count() == 9
    states = [r.state for r in spark.read.parquet(f"{config.data_root}/connection_events").orderBy("ts").collect()]
    assert states == ["connecting", "connected", "disconnected"] and "frames=9" in capsys.readouterr().err


def _say_to(conn, kind, body, end=True):
    size = bytes([len(body)]) if len(body) < 126 else bytes([126]) + struct.pack("!H", len(body)) if len(body) < 65536 else bytes([127]) + struct.pack("!Q", len(body))
    conn.sendall(bytes([(128 if end else 0) | kind]) + size + body)


def _heard(conn):
    head = conn.recv(2)
    size = head[1] & 127
    size = struct.unpack("!H", conn.recv(2))[0] if size == 126 else size
    mask, body = conn.recv(4), b""
    while len(body) < size:
        body += conn.recv(size - len(body))
    return head[0] & 15, bytes(b ^ mask[k % 4] for k, b in enumerate(body))


def _socket_server(script, accept=True):
    """A WebSocket of one connection that runs ``script(conn)`` after the handshake."""
    listening = socket.create_server(("127.0.0.1", 0))

    def serve():
        conn, _ = listening.accept()
        asked = b""
        while b"\r\n\r\n" not in asked:
            asked += conn.recv(4096)
        key = next(x.split(b": ")[1] for x in asked.split(b"\r\n") if x.lower().startswith(b"sec-websocket-key"))
        proof = base64.b64encode(hashlib.sha1(key + b"258EAFA5-E914-47DA-95CA-C5AB0DC85B11").digest())
        conn.sendall(b"HTTP/1.1 101 Switching Protocols\r\nSec-WebSocket-Accept: " + (proof if accept else b"x") + b"\r\n\r\n")
        script(conn)
        conn.close()
        listening.close()

    threading.Thread(target=serve, daemon=True).start()
    return f"ws://127.0.0.1:{listening.getsockname()[1]}/websocket/v1"


def test_socket_messages_pings_fragments_and_ends():
    heard, long = [], json.dumps(["x" * 70_000])

    def script(conn):
        heard.append(_heard(conn))
        _say_to(conn, 1, b'{"a":1}')
        _say_to(conn, 9, b"are you there")
        heard.append(_heard(conn))
        _say_to(conn, 2, "{\"b\":\"é".encode()[:7], end=False)
        _say_to(conn, 9, b"")
        heard.append(_heard(conn))
        _say_to(conn, 0, "{\"b\":\"é".encode()[7:] + b'"}')
        _say_to(conn, 1, long.encode())
        time.sleep(0.5)
        _say_to(conn, 8, struct.pack("!H", 1001))

    opened = exchange.Socket(_socket_server(script))
    opened.send(exchange.subscription(["KRW-A"] * 40).encode())
    assert [opened.receive(5) for _ in range(3)] == ['{"a":1}', '{"b":"é"}', long]
    with pytest.raises(TimeoutError):
        opened.receive(0.05)
    with pytest.raises(ConnectionError, match="closed by the exchange 1001"):
        opened.receive(5)
    assert [k for k, _ in heard] == [1, 10, 10] and heard[1][1] == b"are you there"
    assert [x.get("type") for x in json.loads(heard[0][1])] == [None, "trade", "orderbook", None] and json.loads(heard[0][1])[1]["codes"] == ["KRW-A"] * 40
    with pytest.raises(ConnectionError, match="ended"):
        exchange.Socket(_socket_server(lambda conn: None)).receive(5)
    with pytest.raises(ConnectionError, match="no WebSocket"):
        exchange.Socket(_socket_server(lambda conn: None, accept=False))


def test_collect_from_an_exchange(spark, tmp_path, monkeypatch):
    """From the command line: the universe's largest markets, one connection, and what it sent in the archive."""
    config, asked = _config(tmp_path), []
    config.top_market_count = 2
    tickers = spark.createDataFrame([("KRW-A", 1.0, 0), ("KRW-B", 3.0, 1), ("KRW-C", 2.0, 2)], "market string, volume double, ordinal bigint")
    monkeypatch.setattr(exchange.universe, "tickers", lambda spark, url, prefix: tickers)

    def script(conn):
        asked.extend(json.loads(_heard(conn)[1])[1]["codes"])
        for k in range(30):
            _say_to(conn, 2, json.dumps(_trade(BASE + k, 1.0, f"KRW-{'BC'[k % 2]}", seq=k)[1]).encode())
        _say_to(conn, 8, b"")

    _say(spark, config, "collect", "--frames", str(tmp_path / "frames"), "--checkpoint", str(tmp_path / "state"), "--once", "--rest", "http://x", "--socket", _socket_server(script))
    assert asked == ["KRW-B", "KRW-C"] and study.trades(spark, config.data_root).groupBy("market").count().orderBy("market").collect() == [("KRW-B", 15), ("KRW-C", 15)]


def test_a_server_that_lost_frames_is_an_error():
    log = gateway.FrameLog()
    server = gateway.Gateway(log)
    try:
        for k in range(5):
            log.add('{"code":"A"}', k, 0)
        reader = frames.FrameReader(server.url, 100, 2)
        assert reader.latestOffset() == {"A": 5} and [(p.after, p.upto) for p in reader.partitions({}, {"A": 5})] == [(0, 2), (2, 4), (4, 5)]
        assert [r[1] for r in reader.read(frames.Stretch("A", 1, 4))] == [1, 2, 3]
        reader.commit({"A": 3})
        assert log.offsets() == {"A": [3, 5]}
        with pytest.raises(OSError, match="gave 0 frames"):
            list(reader.read(frames.Stretch("A", 1, 4)))
    finally:
        server.close()


def test_universe_refresh():
    at = lambda day, hour: datetime(2025, 1, day, hour, tzinfo=UTC)
    assert journal.refresh_due(at(1, 5), at(2, 3), 3) and not journal.refresh_due(at(1, 5), at(2, 2), 3) and not journal.refresh_due(at(1, 5), at(1, 23), 3)


def test_settings(tmp_path):
    path = tmp_path / "t.toml"
    path.write_text(settings.template())
    assert settings.load(str(path)) == settings.Config() == settings.load(str(tmp_path / "missing.toml"))
    path.write_text("[validation]\nhorizon_minutes = 30\n")
    changed = settings.load(str(path))
    assert changed.validation.horizon_minutes == 30 and changed.validation.tuning_days == 14 and changed.fingerprint() != settings.Config().fingerprint()
    path.write_text("flush_interval_seconds = 0\n")
    with pytest.raises(ValueError, match="flush_interval_seconds must be greater than zero"):
        settings.load(str(path)).check()
    path.write_text("colour = 1\n")
    with pytest.raises(ValueError, match="colour"):
        settings.load(str(path))
