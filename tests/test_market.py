"""Detectors, joins, folds and storage against sequential versions on tie-heavy rows."""

import json
import math
import random
import threading
from datetime import date
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from tidemark.functions import timeline
from tidemark.functions.timeline import MICROS, running
from tidemark.operators import coverage, detect, evaluate, outcomes, paper
from tidemark.plans import render
from tidemark.sources import market, store, universe, wire
from tidemark.sources.market import books_from_levels

TRADE = "market string, ts bigint, seq bigint, price double, volume double, side string, notional decimal(18,2)"


def make_trades(n=400, seed=1):
    from decimal import Decimal

    rng = random.Random(seed)
    rows, t = [], 0
    for k in range(n):
        t += rng.choice([0, 0, 1, 3, 40]) * MICROS
        p = rng.randint(1, 60)
        rows.append((rng.choice("AAB"), t, k, float(p), 1.0, rng.choice(["buy", "sell"]), Decimal(p)))
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_trades()


@pytest.fixture(scope="module")
def trades(spark, rows):
    shuffled = rows[:]
    random.Random(2).shuffle(shuffled)
    return spark.createDataFrame(shuffled, TRADE)


@pytest.mark.parametrize("block", [30, 100, 10**6])
def test_prior_window_and_edges(trades, rows, block):
    want, fires = {}, set()
    for m in "AB":
        seen, was = [], False
        for r in (r for r in rows if r[0] == m):
            seen = [s for s in seen if s[1] >= r[1] - 30 * MICROS]
            n, total = len(seen), sum(s[3] for s in seen)
            want[r[2]] = (n, total)
            now = n >= 5 and r[3] > total / max(n, 1) * 1.5
            if now and not was:
                fires.add(r[2])
            was = now
            seen.append(r)
    got = {r.seq: (r.n, float(r.total)) for r in detect.prior_window(trades, 30, block).collect()}
    assert got == want
    assert {r.seq for r in detect.large_trades(trades, [1.5, 1.5], 30, block).collect()} == fires and fires


@pytest.mark.parametrize("block", [50, 10**6])
def test_outcomes(trades, rows, block):
    signals = trades.where("seq % 5 = 0").select("market", "ts", "seq", F.lit("x").alias("signal_type"), F.lit("r").alias("rule_id"), F.col("side").alias("direction"))
    got = {r.seq: r for r in outcomes.outcomes(signals, trades, 60, 2, 10.0, block).collect()}
    for r in (r for r in rows if r[2] % 5 == 0):
        own = [x for x in rows if x[0] == r[0]]
        entry = next(x for x in own if x[1] >= r[1])
        exit_ = next((x for x in own if x[1] >= r[1] + 60 * MICROS), None)
        hits = [x[3] for x in own if entry[1] <= x[1] <= r[1] + 60 * MICROS]
        hit = max(hits) / entry[3] - 1 if r[5] == "buy" else entry[3] / min(hits) - 1
        g = got[r[2]]
        assert (g.entry_price, g.horizon_price) == (entry[3], exit_ and exit_[3])
        assert g.complete == (exit_ is not None) and g.reached_target == (hit * 100 >= 10.0 if exit_ else None)


def test_walls(spark):
    level = lambda a, b: [(a, b, 1.0, 1.0)]
    raw = [("A", 0, 1, level(100.0, 90.0)), ("A", 1, 2, level(5.0, 9.0)), ("A", 2, 3, []), ("A", 3, 4, level(1.0, 1.0)), ("A", 4, 5, level(1.0, 100.0)), ("A", 10**12, 6, level(1.0, 2.0))]
    books = books_from_levels(spark.createDataFrame(raw, "market string, ts bigint, seq bigint, levels " + wire.LEVELS)).withColumns({"ask": F.lit(1.0), "bid": F.lit(1.0)})
    got = {r.seq: (r.direction, r.feature_value, r.baseline) for r in detect.wall_drop(books, 50.0).collect()}
    assert got == {2: ("sell", 9.0, 100.0), 6: ("buy", 2.0, 100.0)}


def test_imbalance_of_an_empty_book(spark):
    books = spark.createDataFrame([("A", 0, 1, 0.0, 0.0), ("A", 1, 2, 1.0, 9.0), ("A", 2, 3, 1.0, 9.0)], "market string, ts bigint, seq bigint, ask double, bid double")
    assert [r.seq for r in detect.imbalance(books, [0.4]).collect()] == [2]


def test_sequence_check(spark):
    df = spark.createDataFrame([("A", 0, k, i) for k, i in enumerate([10, 10, 9, None, 12])], "market string, epoch int, k int, sequential_id bigint")
    assert [r.integrity for r in detect.sequence_check(df, ["k"]).orderBy("k").collect()] == ["ok", "integrity_duplicate", "integrity_out_of_order", "ok", "ok"]


@pytest.mark.parametrize("seconds", [0, 5, 45])
def test_cooldown(trades, rows, seconds):
    want, last = set(), {}
    for r in rows:
        if seconds == 0 or r[0] not in last or r[1] >= last[r[0]] + seconds * MICROS:
            want.add(r[2])
            last[r[0]] = r[1]
    got = paper.cooldown(trades, ["market"], seconds, ["ts", "seq"]).where("emitted").collect()
    assert {r.seq for r in got} == want


def test_paper_trades_hold_one_position(spark):
    rng = random.Random(5)
    rows = [("A", rng.randint(0, 300), "s", "r", k, "buy", 10.0, 11.0, rng.random() < 0.7, None) for k in range(150)]
    rows = [(*r[:9], r[1] + rng.randint(5, 20) if r[8] else None) for r in rows]
    df = spark.createDataFrame(rows, "market string, ts bigint, signal_type string, rule_id string, seq bigint, direction string, entry_price double, horizon_price double, complete boolean, exit_ts bigint")
    got = {r.seq: r.state for r in paper.paper_trades(df, 0, 1000, 0.16).collect()}
    busy = -1
    for r in sorted(rows, key=lambda r: r[1:5]):
        state = "skipped" if r[1] < busy else "filled" if r[8] else "incomplete"
        assert got[r[4]] == state
        busy = r[9] if state == "filled" else busy


def test_bootstrap_bounds_and_reproducibility(spark):
    counts = spark.createDataFrame([("r", 100, 30, 15)], "rule_key string, n bigint, plus bigint, minus bigint")
    at = lambda tail: evaluate.bootstrap(counts.withColumn("tail", F.lit(tail)), 400, 7).first()
    wide, narrow = at(0.0005), at(0.025)
    assert wide.ci_low <= narrow.ci_low < 0.15 < narrow.ci_high <= wide.ci_high and at(0.025) == narrow


@pytest.mark.parametrize("n", [50, 1000, 10**6])
def test_resampled_means_spread_as_independent_draws(spark, n):
    plus, minus, iterations = n * 3 // 10, n // 5, 10_000
    counts = spark.createDataFrame([("r", n, plus, minus, 0.16)], "rule_key string, n bigint, plus bigint, minus bigint, tail double")
    ci = evaluate.bootstrap(counts, iterations, 7).first()
    mean, sd = (plus - minus) / n, ((plus + minus) / n - ((plus - minus) / n) ** 2) ** 0.5 / n**0.5
    # the 16th and 84th percentile lie about 0.994 standard deviations out
    assert abs((ci.ci_high - ci.ci_low) / (2 * 0.9945) - sd) < 0.1 * sd + 0.5 / n and abs((ci.ci_low + ci.ci_high) / 2 - mean) < 0.15 * sd + 0.5 / n


@pytest.mark.parametrize(("n", "plus", "minus"), [(1, 1, 0), (1, 0, 0), (2, 1, 1), (7, 3, 0), (7, 0, 7), (30, 10, 5), (300, 1, 2), (300, 150, 150)])
def test_cumulative_table_equals_the_sum_over_all_draws(n, plus, minus):
    rest, want = n - plus - minus, {}
    for x in range(n + 1):
        for y in range(n - x + 1):
            share = math.comb(n, x) * math.comb(n - x, y) * plus**x * minus**y * rest ** (n - x - y)
            want[x - y] = want.get(x - y, 0) + share
    low, got = evaluate.cumulative(n, plus, minus)
    for d in range(-n, n + 1):
        exact = sum(v for k, v in want.items() if k <= d) / n**n
        assert abs((0 if d < low else got[min(d - low, len(got) - 1)]) - exact) < 1e-12


def test_cumulative_table_is_short_for_many_pairs():
    low, got = evaluate.cumulative(10**8, 10**7, 10**7)
    assert len(got) < 200_000 and got[-1] == 1 and abs(got[-low] - 0.5) < 1e-3


def test_controls_differ_by_rule_and_split(spark):
    day = 86_400 * MICROS
    trades = [("A", d * day + k * 60 * MICROS, d * 1000 + k, float(k % 7 + 1), 1.0, "buy", None) for d in range(2) for k in range(600)]
    df = spark.createDataFrame(trades, TRADE)
    signals = [("A", d * day + k * 60 * MICROS, d * 1000 + k, "s", rule, "buy") for d in range(2) for k in range(0, 500, 5) for rule in ("r1", "r2")]
    signals = spark.createDataFrame(signals, "market string, ts bigint, seq bigint, signal_type string, rule_id string, direction string")
    done = outcomes.outcomes(signals, df, 120, 60, 10.0)
    at = lambda step: {tuple(r)[:5]: r.control for r in evaluate.control_pairs(done, df, 120, 60, 10.0, 7, "1970-01-01", step).select("market", "ts", "seq", "signal_type", "rule_id", "control").collect()}
    pairs = at(3600)
    assert len(pairs) == 400 and pairs == at(600) == at(10**6)
    differ = lambda rows: sum(a != b for a, b in rows) / 100
    for d in range(2):  # two rules of one trade have draws of their own
        one, two = ([v for k, v in sorted(pairs.items()) if k[2] // 1000 == d and k[4] == r] for r in ("r1", "r2"))
        assert differ(zip(one, two)) > 0.1
    first, second = ([v for k, v in sorted(pairs.items()) if k[2] // 1000 == d and k[4] == "r1"] for d in range(2))
    assert differ(zip(first, second)) > 0.1


def test_folds_of_a_market_that_never_pauses(spark):
    """10 ** 5 signals a second apart: linear work in blocks, none much larger than the others."""
    df = spark.range(100_000).selectExpr("'A' as market", "id * 1000000L as ts", "id as seq")
    got = paper.cooldown(df, ["market"], 10, ["ts", "seq"], block=3600)
    assert got.where("emitted").selectExpr("count(*) n", "min(seq % 10 = 0) as even").first() == (10_000, True)
    per_block = [r["count"] for r in df.selectExpr("ts div 3600000000 as b").groupBy("b").count().collect()]
    assert max(per_block) == 3600 and len(per_block) == 28


@pytest.mark.parametrize("block", [1, 7, 60, 10**6])
def test_folds_and_running_values_in_blocks(spark, trades, rows, block):
    want, last = set(), {}
    for r in rows:
        if r[0] not in last or r[1] >= last[r[0]] + 20 * MICROS:
            want.add(r[2])
            last[r[0]] = r[1]
    got = paper.cooldown(trades, ["market"], 20, ["ts", "seq"], block)
    assert {r.seq for r in got.where("emitted").collect()} == want and got.count() == len(rows)
    sums, total = {}, {}
    for r in rows:
        sums[r[0]] = sums.get(r[0], 0) + r[3]
        total[r[2]] = sums[r[0]]
    got = running(trades, ["market"], ["ts", "seq"], F.sum, F.col("price"), "s", block)
    assert {r.seq: r.s for r in got.collect()} == total


def test_drawdown_in_blocks(spark):
    rng = random.Random(8)
    rows = [(m, k * 10, "s", "r", k, "filled", k * 10 + rng.randint(1, 9) * MICROS, rng.uniform(-9, 8)) for k in range(120) for m in "AB"]
    trades = spark.createDataFrame(rows, "market string, ts bigint, signal_type string, rule_id string, seq bigint, state string, exit_ts bigint, net_pct double")
    held = spark.createDataFrame([("A",), ("B",), ("C",)], "market string")
    sleeves, value, peak, fall = {"A": 1.0, "B": 1.0}, 1.0, 1.0, 0.0
    for r in sorted(rows, key=lambda r: (r[6], r[0], r[1])):
        value += sleeves[r[0]] * r[7] / 100 / 3
        sleeves[r[0]] *= 1 + r[7] / 100
        peak = max(peak, value)
        fall = min(fall, (value - peak) / peak * 100)
    for block in (1, 3, 10**6):
        assert abs(paper.drawdown(trades, held, block).first()[0] - fall) < 1e-5


@pytest.mark.parametrize("block", [1, 10, 10**6])
def test_drawdown_of_an_account_that_falls_below_nothing(spark, block):
    """Sleeves that lose more than all turn sign; a fall to below 0 is measured from the highest peak before it."""
    for seed in range(4):
        rng, sleeves, value, peak, fall = random.Random(seed), {"A": 1.0, "B": 1.0}, 1.0, 1.0, 0.0
        rows = [(rng.choice("AB"), k, "s", "r", k, "filled", (k + rng.randint(0, 5)) * MICROS, rng.choice([-250.0, -130.0, -100.0, -20.0, 60.0, 150.0])) for k in range(30)]
        for r in sorted(rows, key=lambda r: (r[6], r[0], r[1])):
            value += sleeves[r[0]] * r[7] / 100 / 2
            sleeves[r[0]] *= 1 + r[7] / 100
            peak = max(peak, value)
            fall = min(fall, (value - peak) / peak * 100)
        trades = spark.createDataFrame(rows, "market string, ts bigint, signal_type string, rule_id string, seq bigint, state string, exit_ts bigint, net_pct double")
        got = paper.drawdown(trades, spark.createDataFrame([("A",), ("B",)], "market string"), block).first()[0]
        assert fall < -100 and got == pytest.approx(fall, abs=1e-6)


def test_tallies_come_from_one_scan(spark, tmp_path):
    rows = [("A", "s", "r1", "filled", 10.0), ("A", "s", "r2", "filled", -5.0), ("B", "s", "r1", "skipped", None), ("X", "s", "r1", "incomplete", None)]
    spark.createDataFrame(rows, "market string, signal_type string, rule_id string, state string, net_pct double").write.parquet(str(tmp_path / "p"))
    tallied = paper.tallies(spark.read.parquet(str(tmp_path / "p")))
    assert tallied._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("FileScan") == 1
    assert {r.rule_key: (r.trades, r.skipped, r.incomplete, r.wins, r.mean_net_pct) for r in paper.by_rule(tallied).collect()} == {"s:r1": (1, 1, 1, 1, 10.0), "s:r2": (1, 0, 0, 0, -5.0)}
    held = spark.createDataFrame([("A", 1.0), ("B", 2.0), ("C", 3.0)], "market string, hold_pct double")
    assert {r.market: (r.trades, r.return_pct, r.excess_pct) for r in paper.by_market(tallied, held).collect()} == {"A": (2, 4.5, 3.5), "B": (0, 0.0, -2.0), "C": (0, 0.0, -3.0)}
    assert paper.summary(tallied, held).first().asDict() == {"markets": 3, "strategy_pct": 1.5, "hold_pct": 2.0, "excess_pct": -0.5, "trades": 2, "skipped": 1, "incomplete": 1, "wins": 1, "verdict": "HOLD"}
    assert paper.summary(paper.tallies(spark.read.parquet(str(tmp_path / "p")).limit(0)), held.limit(0)).first().trades == 0


def test_a_market_outside_the_universe_takes_no_position(spark):
    rows = [("A", 0, "s", "r", 0, "buy", 10.0, 11.0, True, 5), ("X", 0, "s", "r", 1, "buy", 10.0, 11.0, True, 5), ("X", 2, "s", "r", 2, "buy", 10.0, 11.0, True, 7)]
    df = spark.createDataFrame(rows, "market string, ts bigint, signal_type string, rule_id string, seq bigint, direction string, entry_price double, horizon_price double, complete boolean, exit_ts bigint")
    got = {r.seq: r.state for r in paper.paper_trades(df, 0, 100, 0.16, spark.createDataFrame([("A",)], "market string")).collect()}
    assert got == {0: "filled", 1: "incomplete", 2: "incomplete"}


def test_rule_names_keep_all_digits():
    assert [detect.number(x) for x in (3.0, 0.25, 0.1234567, 0.1234568, 100.0, 1e-7)] == ["3", "0.25", "0.1234567", "0.1234568", "100", "0.0000001"]


def test_pruned_scan_reads_one_partition(spark, tmp_path, trades):
    store.append(trades.withColumn("date", F.expr("date_add(date'2025-01-01', cast(seq % 3 as int))")), str(tmp_path), "trades")
    df = store.read(spark, str(tmp_path), "trades", trades.drop("market").schema, date(2025, 1, 2))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and len(df.inputFiles()) > 0 and df.where("seq % 3 <> 1").count() == 0


def test_order_of_equal_times(spark):
    """Ties of stored records go by receipt, sequence id (none first), price, volume and side."""
    raw = [("A", 1, 5, 2.0, 1.0, "buy", None, 0), ("A", 1, 5, 1.0, 1.0, "sell", 3, 0), ("A", 1, 5, 1.0, 1.0, "buy", 3, 0), ("A", 1, 4, 9.0, 1.0, "buy", 9, 0), ("A", 0, 9, 7.0, 1.0, "buy", 1, 0)]
    got = market.trades_of(spark.createDataFrame(raw, "market string, ts_ms bigint, receive_ns bigint, price double, volume double, side string, sequential_id long, epoch bigint")).orderBy("ts", "seq")
    assert [(r.price, r.side) for r in got.collect()] == [(7.0, "buy"), (9.0, "buy"), (2.0, "buy"), (1.0, "buy"), (1.0, "sell")]


def test_coverage_gate(trades, spark):
    present = spark.createDataFrame([(date(2025, 1, d),) for d in (1, 2, 4)], "date date")
    assert [str(r.date) for r in coverage.missing_dates(present, 4).collect()] == ["2025-01-03"]
    with pytest.raises(ValueError, match="2025-01-03"):
        coverage.require_dates(present, 4)
    with pytest.raises(ValueError):
        coverage.required_dates(present, 0)
    assert render.span(119) == "119s" and render.span(7199) == "119m" and render.span(172_799) == "48.0h" and render.span(172_800) == "2.0d"


def test_store(spark, tmp_path, trades):
    root = str(tmp_path)
    schema = trades.drop("market").schema
    assert store.read(spark, root, "trades", schema).count() == 0 and store.footprint(spark, root + "/none") == (0, 0)
    df = trades.withColumn("date", F.lit("2025-01-01").cast("date"))
    store.append(df, root, "trades")
    assert store.footprint(spark, root)[1] == 2 and store.dataset_dates(spark, root, "trades") == [date(2025, 1, 1)]
    assert store.read(spark, root, "trades", schema, date(2025, 1, 2)).count() == 0
    store.replace(store.read(spark, root, "trades", schema).where("seq < 10"), root, "trades")
    assert store.read(spark, root, "trades", schema).count() == 10
    current = (tmp_path / "trades" / store.POINTER).read_text()
    (tmp_path / "trades" / current / "date=bad").mkdir()
    with pytest.raises(ValueError, match="date=bad"):
        store.dataset_dates(spark, root, "trades")


@pytest.mark.parametrize("point", ["append", "_point", "_fs"])
def test_replacing_is_all_or_nothing(spark, tmp_path, monkeypatch, point):
    """A failure while the version is written, before the rename, or while old ones are deleted."""
    root = str(tmp_path)
    rows = lambda n: spark.range(n).selectExpr("id", "date'2025-01-01' as date", "'A' as market")
    ids = lambda: store.read(spark, root, "d", spark.range(1).schema).count()
    store.replace(rows(3), root, "d")
    store.replace(rows(5), root, "d")
    assert ids() == 5 and len([p for p in (tmp_path / "d").iterdir() if p.name.startswith("version=")]) == 1
    kept, calls = getattr(store, point), []

    def fails(*args, **more):
        calls.append(args)
        if point == "_fs" and len(calls) == 1:  # the pointer's own
            return kept(*args, **more)
        if point == "append":
            kept(*args, **more)  # all of it is written
        raise OSError("killed")

    monkeypatch.setattr(store, point, fails)
    with pytest.raises(OSError, match="killed"):
        store.replace(rows(7), root, "d")
    monkeypatch.setattr(store, point, kept)
    assert ids() == (7 if point == "_fs" else 5)
    store.replace(store.read(spark, root, "d", spark.range(1).schema).where("id > 0"), root, "d")
    assert ids() == (6 if point == "_fs" else 4) and store.dataset_dates(spark, root, "d") == [date(2025, 1, 1)]
    assert len([p for p in (tmp_path / "d").iterdir() if p.name.startswith("version=")]) == 1


def test_universe_is_fetched_in_chunks(spark):
    """250 markets are three pages of at most 100 names, each asked for once; ranks go over all of them."""
    asked = []

    class Exchange(BaseHTTPRequestHandler):
        def do_GET(self):
            at = urlsplit(self.path)
            names = parse_qs(at.query).get("markets", [""])[0].split(",")
            if at.path == "/v1/market/all":
                body = [{"market": f"KRW-{k}"} for k in range(250)] + [{"market": "BTC-1"}, {"other": 1}]
            else:
                asked.append(names)
                body = [{"market": m, "acc_trade_price_24h": 7.0 if m in ("KRW-3", "KRW-201") else int(m[4:]) % 5} for m in names] + [{"market": "KRW-x"}]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Exchange)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        found = universe.tickers(spark, f"http://127.0.0.1:{server.server_address[1]}").collect()
    finally:
        server.shutdown()
        server.server_close()
    assert sorted(map(len, asked)) == [50, 100, 100] and len(found) == 250
    top = wire.universe(spark.createDataFrame(found), 3).collect()
    assert [r.market for r in top] == ["KRW-3", "KRW-201", "KRW-4"]


def test_wire(spark):
    frames = ['{"type":"trade","code":"K","timestamp":1,"trade_price":2.0,"trade_volume":1.0,"ask_bid":"?","sequential_id":18446744073709551615}', '{"type":"trade","code":"K"}', '{"type":"x"}', "no json"]
    out = wire.normalize(spark.createDataFrame([(f,) for f in frames], "frame string"))
    good = wire.trades(out).first()
    assert good.side == "sell" and int(good.sequential_id) == 2**64 - 1
    assert sorted(str(r.error) for r in out.collect()) == ["None", "missing timestamp, trade_price, trade_volume, ask_bid", "unknown type", "unknown type"]
    with pytest.raises(Exception, match="required"):
        wire.unpack(spark.createDataFrame([('{"a":1}',)], "payload string"), "a int, b int", ["b"]).collect()


@pytest.mark.parametrize(("leaf", "block"), [(2, 7), (3, 60), (64, 10**6)])
def test_look_up_in_blocks_and_levels(spark, trades, rows, leaf, block, monkeypatch):
    """First trades and ranges of any length against a scan, over several levels and blocks without trades."""
    monkeypatch.setattr(outcomes, "LEAF", leaf)
    rng, last = random.Random(4), rows[-1][1]
    probes = [(rng.choice("ABC"), rng.choice([None, rng.randint(-5, last // MICROS + 90) * MICROS, rng.choice(rows)[1]]), rng.choice(rows)[1], k, None) for k in range(120)]
    probes += [probes[5], probes[5], ("A", 0, 0, 900, -0.5), ("A", rows[3][1], rows[3][1] - 1, 901, None)]
    df = spark.createDataFrame(probes, "market string, a bigint, b bigint, id int, low double").repartition(3)
    got = outcomes.look_up(df, trades, {"x": "a", "y": "b"}, {"r": ("a", "b"), "s": ("b", "a")}, block).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(probes, key=str)
    spans = 0
    for r in got:
        own = [x for x in rows if x[0] == r.market]
        for name, at in (("x", r.a), ("y", r.b)):
            want = next(((x[1], x[2], x[3]) for x in own if at is not None and x[1] >= at), None)
            assert (r[name] and tuple(r[name])) == want
        for name, start, end in (("r", r.a, r.b), ("s", r.b, r.a)):
            inside = [x[3] for x in own if None not in (start, end) and start <= x[1] <= end]
            spans = max(spans, len(inside))
            assert (r[name] and tuple(r[name])) == ((min(inside), max(inside)) if inside else None)
    assert spans > leaf


def test_ranges_of_a_busy_market_are_linear_work(spark):
    """100 trades a second and ranges of 360,000: a probe asks for a few nodes, not for its range's trades."""
    trades = spark.range(1_000_000).selectExpr("'A' as market", "id * 10000L as ts", "id as seq", "cast(pmod(xxhash64(id), 100003) as double) as price")
    probes = spark.range(300).selectExpr("'A' as market", "id * 21000000L + 3 as a", "id * 21000000L + 3600000003L as b", "id")
    got = {r.id: tuple(r.r) for r in outcomes.look_up(probes, trades, {"x": "a"}, {"r": ("a", "b")}).where("id % 60 = 0").collect()}
    prices = [r.price for r in trades.orderBy("seq").select("price").collect()]
    for k, found in got.items():
        first, last = k * 2100 + 1, min(k * 2100 + 360_000, 999_999)
        assert found == (min(prices[first : last + 1]), max(prices[first : last + 1]))
    levels = outcomes.levels_above(1_000_000 // outcomes.LEAF)
    place = lambda n: F.struct(F.floor(F.lit(n) / 64).alias("node"), F.lit(n % 64).alias("place"))
    asked = spark.range(1).select(F.array_compact(F.array(*outcomes._cover("r", place(5), place(999_000), levels))).alias("r")).first().r
    assert len(asked) <= 2 * (levels + 1)


def test_outcomes_shuffle_trades_once(spark, tmp_path):
    spark.range(1000).selectExpr("'A' as market", "id * 1000000L as ts", "id as seq", "1D as price").write.parquet(str(tmp_path / "t"))
    trades = spark.read.parquet(str(tmp_path / "t"))
    marks = spark.range(9).selectExpr("'A' as market", "id as at", "0 as which", "false as after", "named_struct('id', id) as row")
    plan = outcomes._merged(marks, trades, 60)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange") == 1


# the last entry is 0 / 0, which SQL takes for more than any number
@pytest.mark.parametrize("at,direction,net,hit", [(1, "sell", math.inf, True), (1, "buy", -100.0, False), (0, "buy", math.inf, True), (0, "sell", -100.0, True)])
def test_a_price_of_zero_is_infinitely_far(spark, at, direction, net, hit):
    prices = [0.0 if k == at else 5.0 for k in range(2)]
    trades = spark.createDataFrame([("A", k * MICROS, k, p) for k, p in enumerate(prices)], "market string, ts bigint, seq bigint, price double")
    signal = spark.createDataFrame([("A", 0, 0, "x", "r", direction)], "market string, ts bigint, seq bigint, signal_type string, rule_id string, direction string")
    done = outcomes.outcomes(signal, trades, 1, 1, 10.0)
    assert done.first().reached_target == hit
    assert paper.paper_trades(done, 0, MICROS, 0.0).first().net_pct == net
    held = paper.hold(trades, 0, 2 * MICROS, 0.0)
    assert held.first().hold_pct == (-100.0 if at else math.inf)


def test_a_market_result_that_is_no_number_stays(spark):
    held = spark.createDataFrame([("A", None, None, math.nan), ("B", 1.0, 1.0, 0.0)], "market string, first_price double, last_price double, hold_pct double")
    done = spark.createDataFrame([("B", "market", None, 1, 0, 0, 1, math.inf, math.nan)], "market string, section string, rule_key string, trades bigint, skipped bigint, incomplete bigint, wins bigint, mean_net_pct double, return_pct double")
    got = {r.market: r for r in paper.by_market(done, held).collect()}
    assert got["A"].first_price is None and math.isnan(got["A"].hold_pct) and got["A"].trades == 0
    assert math.isnan(got["B"].return_pct) and got["B"].mean_net_pct == math.inf


def test_blocks_are_dealt_by_rows_not_by_compressed_bytes(spark, monkeypatch):
    monkeypatch.setattr(timeline, "PART_ROWS", 1000)
    trades = spark.range(9_500).selectExpr("'A' as market", "id * 36000000L as ts", "id as seq", "1D as price", "1D as volume", "'buy' as side", "cast(1 as decimal(18,2)) as notional")
    plan = detect.prior_window(trades, 3600)._jdf.queryExecution().executedPlan().toString()
    assert ", 10), REPARTITION_BY_NUM" in plan


def plans_written(monkeypatch, *modules):
    """The plans of all that the modules write to shared tables from now on."""
    plans, write = [], store.shared_table
    for module in modules:
        monkeypatch.setattr(module, "shared_table", lambda df, *a, **k: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, *a, **k))[1], raising=False)
    return plans


def test_signals_sort_no_scan_of_all_trades(trades, monkeypatch):
    # what a scan reads follows the size of files, so a sort there grows with the table
    plans = plans_written(monkeypatch, timeline, detect)
    found = [*detect.trade_signals(trades, [1.5, 2.0], [1.5], 30, 60), detect.wall_drop(trades.selectExpr("*", "1D as ask", "1D as bid", "price as ask_wall", "price as bid_wall"), 5.0, 60)]
    plans += [s._jdf.queryExecution().executedPlan().toString() for s in found]
    assert all(s.count() for s in found) and not any("SortAggregate" in p for p in plans)
    # trades are shuffled once for all rules, by blocks
    assert len([p for p in plans if "Generate" in p and "REPARTITION" in p]) == 1 and max(p.count("REPARTITION") for p in plans) == 1


@pytest.mark.parametrize("block", [1, 7, 50, 10**6])
def test_previous_tells_the_row_before_over_blocks(spark, block):
    rng = random.Random(5)
    rows = [(k, "AB"[k % 3 == 0], rng.choice([0, 1, 2, 60]), rng.choice([None, 1, 2])) for k in range(200)]
    at, want, last = 0, {}, {}
    for k, m, gap, v in rows:
        at += gap * MICROS
        rows[k] = (k, m, at, v)
        want[k] = last.get(m)
        last[m] = v
    df = spark.createDataFrame(rows, "k int, m string, ts bigint, v int").repartition(3)
    got = timeline.previous(df, ["m"], ["ts", "k"], F.col("v"), "before", block, F.lit(True))
    assert {r.k: r.before for r in got.collect()} == want
    got = timeline.previous(df, ["m"], ["ts", "k"], F.col("v"), "before", block, F.col("before") == 2).collect()
    assert sorted(r.k for r in got) == sorted(k for k, v in want.items() if v == 2)


def test_lookups_are_dealt_by_numbers_of_probes(spark, trades, monkeypatch):
    monkeypatch.setattr(timeline, "PART_ROWS", 30)
    plans = plans_written(monkeypatch, outcomes)
    assert outcomes.first_at_or_after(trades.select("market", "ts", "seq").limit(200), trades, "ts", "found", 100).count() == 200
    assert plans[-1].count(", 7), REPARTITION_BY_NUM") == 3  # 200 probes, their spots and their answers


def test_folds_are_dealt_by_rows(trades, rows, monkeypatch):
    monkeypatch.setattr(timeline, "PART_ROWS", 50)
    out = paper.cooldown(trades, ["market"], 45, ["ts", "seq"], 60)
    assert out._jdf.queryExecution().executedPlan().toString().count(f", {len(rows) // 50 + 1}), REPARTITION_BY_NUM") == 2


def test_a_trade_becomes_two_moves_after_it_is_shuffled(trades):
    plan = detect.prior_window(trades, 30, 60)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.split("Exchange")[0].count("Generate") == 1
