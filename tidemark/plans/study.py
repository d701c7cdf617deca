"""Studies over a collected archive: analyze, report, paper, alert replay and coverage.

Data stays in Spark. The driver sees rows per rule, market or date, and alerts one at a time."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.config import Config
from tidemark.functions.timeline import DAY, MICROS, utc_date
from tidemark.operators import coverage, detect, evaluate, journal, outcomes, paper
from tidemark.plans import render
from tidemark.sources import market, store, wire

PAYLOAD = StructType([StructField("payload", StringType())])
#: Fields that a stored record must have.
NEEDED = ["market", "ts_ms", "receive_ns"]


class Blocked(Exception):
    """There is no ruleset that fits the settings and the archive."""


def _records(spark: SparkSession, root: str, dataset: str, schema: str, needed: list[str]) -> DataFrame:
    packed = store.read(spark, root, dataset, PAYLOAD).select("payload")
    return wire.unpack(packed, schema, NEEDED + needed)


def _trade_records(spark: SparkSession, root: str) -> DataFrame:
    return _records(spark, root, "trades", market.TRADE, ["price", "volume", "side"])


def _book_records(spark: SparkSession, root: str) -> DataFrame:
    return _records(spark, root, "orderbooks", market.BOOK, ["ask", "bid", "levels"])


def trades(spark: SparkSession, root: str) -> DataFrame:
    return market.trades_of(_trade_records(spark, root))


def books(spark: SparkSession, root: str) -> DataFrame:
    return market.books_of(_book_records(spark, root))


def connections(spark: SparkSession, config: Config) -> DataFrame:
    """Stored connection events, and those that the records' arrivals and connections show."""
    stored = store.read(spark, config.data_root, "connection_events", StructType.fromDDL(journal.EVENT))
    arrivals = [market.arrivals_of(r(spark, config.data_root)) for r in (_trade_records, _book_records)]
    seen = journal.connections(arrivals[0].unionByName(arrivals[1]), config.stall_timeout_seconds)
    return stored.select("market", "ts", "state", "gap_ms").unionByName(seen.select(F.lit("ALL").alias("market"), "ts", "state", "gap_ms"))


def live_events(spark: SparkSession, root: str) -> DataFrame:
    from tidemark.streaming.live import STORED

    return store.read(spark, root, "live_events", StructType.fromDDL(STORED))


def signals(t: DataFrame, b: DataFrame, config: Config) -> DataFrame:
    """All signals of the whole archive, with their places in the order of events: a filter on dates below the
    detectors would change them."""
    window, c = config.trade_rate_window_seconds, config.candidate
    parts = [
        *detect.trade_signals(t, c.large_trade_multiples, c.trade_rate_multiples, window),
        detect.imbalance(b, c.imbalance_thresholds),
        detect.wall_drop(b, config.wall_min_krw),
    ]
    found = detect.in_event_order(reduce(DataFrame.unionByName, parts), rule_order(config))
    return store.shared_table(detect.checked(found.withColumn("rationale", detect.rationale(window, config.wall_min_krw))), "signals")


def rule_order(config: Config) -> list[str]:
    """Keys of all rules, those of trades and those of books each in the order in which a record is tried."""
    c, n = config.candidate, detect.number
    trade = [f"large_aggressive_trade:large-{n(m)}" for m in c.large_trade_multiples] + [f"trade_rate_acceleration:rate-{n(m)}" for m in c.trade_rate_multiples]
    return [*trade, *(f"orderbook_imbalance:imbalance-{n(t)}" for t in c.imbalance_thresholds), "wall_disappearance:wall-drop"]


def _outcomes(s: DataFrame, t: DataFrame, config: Config) -> DataFrame:
    v, s = config.validation, s.select(detect.SIGNAL)
    return outcomes.outcomes(s, t, v.horizon_minutes * 60, v.entry_max_lag_seconds, v.hit_threshold_pct)


def _rows(df: DataFrame, *order: str) -> list[dict]:
    """A report's rows: per rule, market or date."""
    return [r.asDict() for r in df.orderBy(*order).collect()]


def _window(present: DataFrame, config: Config) -> dict[str, str]:
    v = config.validation
    end = coverage.date_status(present, v.tuning_days + v.validation_days).first().end_date
    if end is None:
        raise ValueError("nothing collected")
    start = end - timedelta(days=v.tuning_days + v.validation_days - 1)
    split = start + timedelta(days=v.tuning_days)
    return {"tuning_start": str(start), "tuning_end": str(split - timedelta(days=1)), "validation_start": str(split), "validation_end": str(end)}


def _day(df: DataFrame) -> DataFrame:
    return df.withColumn("date", utc_date())


def analyze(spark: SparkSession, config: Config) -> dict:
    """Find, select and validate rules; write signals, outcomes, results and the ruleset; return the audit.

    All of it is computed before anything stored is replaced, so a failure leaves the last state."""
    config.check()
    root, v = config.data_root, config.validation
    t, b = store.shared_table(trades(spark, root), "trades"), store.shared_table(books(spark, root), "books")
    present = coverage.dates(t, b)
    coverage.require_dates(present, v.tuning_days + v.validation_days)
    window = _window(present, config)
    found = signals(t, b, config)
    done = _outcomes(found, t, config)
    inside = F.col("ts").between(_stamp(window["tuning_start"]), _stamp(window["validation_end"]) + DAY * MICROS - 1)
    pairs = evaluate.control_pairs(done.where(inside), t, v.horizon_minutes * 60, v.entry_max_lag_seconds, v.hit_threshold_pct, v.bootstrap_seed, window["tuning_end"])
    pairs = store.shared_table(pairs, "pairs")
    # a rule that never fired in the window is no candidate
    tried = store.shared_table(evaluate.candidates(found.where(inside), pairs, window["tuning_end"]), "candidates")
    selected = store.shared_table(evaluate.select_rules(tried), "selected")
    late = pairs.where(F.col("date") >= F.lit(window["validation_start"]).cast("date"))
    results = _rows(evaluate.gate(selected, late, v.bootstrap_iterations, v.bootstrap_seed, v.min_validation_signals, v.family_wise_correction), "signal_type")
    family = sum(r["val_n"] > 0 for r in results)
    audit = {
        "generated_at": datetime.now(UTC).isoformat(), "config_fingerprint": config.fingerprint(), **window, "min_validation_signals": v.min_validation_signals,
        "family_wise_correction": v.family_wise_correction, "family_size": family, "effective_tail_alpha": evaluate.TAIL / max(family, 1) if v.family_wise_correction else evaluate.TAIL,
        "candidates": _rows(tried, "signal_type", "rule_key"), "results": results, "rules": [r["rule_key"] for r in results if r["passed"]], "signal_count": found.count(),
    }
    store.replace(_day(detect.snapshot(found)), root, "signals")
    store.replace(_day(done), root, "signal_outcomes")
    for name, records in (("evaluation_results", results), ("active_rule_sets", [audit])):
        end = date.fromisoformat(window["validation_end"])
        stored = spark.createDataFrame([(json.dumps(r), end, "ALL") for r in records], "payload string, date date, market string")
        store.replace(stored, root, name)
    return audit


def ruleset(spark: SparkSession, config: Config) -> dict:
    """The audit of the last analysis, if it was made with these settings and up to the last dates."""
    root = config.data_root
    last = store.read(spark, root, "active_rule_sets", PAYLOAD).orderBy(F.desc(F.get_json_object("payload", "$.generated_at"))).first()
    if last is None:
        raise Blocked("no ruleset: run analyze first")
    audit = json.loads(last.payload)
    if not {"config_fingerprint", "results", "rules", "validation_end"} <= set(audit):
        raise Blocked("ruleset is from an older format; run analyze")
    if audit["config_fingerprint"] != config.fingerprint():
        raise Blocked("the ruleset was made with other settings: run analyze again")
    # Folder names tell the dates, so no record is read for this.
    days = store.dataset_dates(spark, root, "trades") + store.dataset_dates(spark, root, "orderbooks")
    if not days or str(max(days)) != audit["validation_end"]:
        raise Blocked("the ruleset is older than the archive: run analyze again")
    return audit


def qualified(audit: dict) -> dict[str, dict]:
    """The rules of a ruleset with their validation results; one without a passed result is an error."""
    passed = {r["rule_key"]: r for r in audit["results"] if r["passed"]}
    for rule in audit["rules"]:
        if rule not in passed:
            raise Blocked(f"qualified rule {rule} has no passed validation result")
    return {rule: passed[rule] for rule in audit["rules"]}


def _of_rules(s: DataFrame, keys: list[str]) -> DataFrame:
    return s.where(evaluate.rule_key().isin(keys))


def _stamp(day: str) -> int:
    return int(datetime.fromisoformat(day).replace(tzinfo=UTC).timestamp()) * MICROS


def paper_study(spark: SparkSession, config: Config) -> dict | None:
    """Trade the qualified rules over the validation dates; None (and no stored study) without any."""
    config.check()
    root, audit = config.data_root, ruleset(spark, config)
    rules = qualified(audit)
    if not rules:
        _clear(spark, root, "paper_trades", "paper_summaries")
        return None
    t, b = store.shared_table(trades(spark, root), "trades"), books(spark, root)
    start, end = _stamp(audit["validation_start"]), _stamp(audit["validation_end"]) + DAY * MICROS
    done = _outcomes(_of_rules(signals(t, b, config), list(rules)), t, config)
    held = store.shared_table(paper.hold(t, start, end, config.round_trip_pct), "held")
    filled = store.shared_table(paper.paper_trades(done, start, end, config.round_trip_pct, held), "paper")
    tallied = store.shared_table(paper.tallies(filled), "tallies")
    per_rule = {r["rule_key"]: r for r in _rows(paper.by_rule(tallied), "rule_key")}
    none = {"trades": 0, "skipped": 0, "incomplete": 0, "wins": 0, "mean_net_pct": 0.0, "return_pct": 0.0}
    total = paper.summary(tallied, held).first().asDict() | paper.drawdown(filled, held).first().asDict()
    study = {
        "start": audit["validation_start"], "end": audit["validation_end"], "horizon_minutes": config.validation.horizon_minutes, "fee_bps": config.paper.fee_bps, "slippage_bps": config.paper.slippage_bps,
        "rules": [per_rule.get(k, none | {"rule_key": k}) for k in sorted(rules)], "markets": _rows(paper.by_market(tallied, held), "market"), "total": total,
    }
    store.replace(_day(filled.where("state = 'filled'")), root, "paper_trades")
    stored = spark.createDataFrame([(json.dumps(study), date.fromisoformat(study["end"]), "ALL")], "payload string, date date, market string")
    store.replace(stored, root, "paper_summaries")
    return study


def _clear(spark: SparkSession, root: str, *datasets: str) -> None:
    for name in datasets:
        fs, place = store._fs(spark, f"{root}/{name}")
        fs.delete(place, True)


def alerts(spark: SparkSession, config: Config) -> Iterator[dict]:
    """The alerts that the archive would have given, in the order of events, one at a time; Blocked
    without any qualified rule."""
    config.check()
    root, audit = config.data_root, ruleset(spark, config)
    rules = qualified(audit)
    if not rules:
        raise Blocked("no validation-qualified rules")
    found = _of_rules(signals(trades(spark, root), books(spark, root), config), list(rules))
    sent = paper.cooldown(found, ["market", "rule_id"], config.alert.cooldown_seconds, ["ts", "seq"]).where("emitted")
    for row in sent.orderBy(*detect.EVENT_ORDER).toLocalIterator():
        s = row.asDict()
        key = f"{row.signal_type}:{row.rule_id}"
        yield {"emitted_at": datetime.now(UTC).isoformat(), "rule_key": key, "rationale": row.rationale, "signal": s, "validation": rules[key], "window": {k: audit[k] for k in ("tuning_start", "tuning_end", "validation_start", "validation_end")}}


def collected(spark: SparkSession, config: Config, csv: bool) -> tuple[str, str]:
    """The coverage table, and the summary with dates missing and the projected footprint."""
    root, v = config.data_root, config.validation
    t, b, live = trades(spark, root), books(spark, root), live_events(spark, root)
    links = connections(spark, config)
    days = v.tuning_days + v.validation_days
    rows = _rows(coverage.daily(t, b, live.where("kind = 'signal'"), links), "date")
    present = coverage.dates(t, b)
    status, missing = coverage.date_status(present, days).first(), [str(r["date"]) for r in _rows(coverage.missing_dates(present, days), "date")]
    n_bytes, files = store.footprint(spark, root)
    observed = coverage.observed_seconds(t, b).first().observed_seconds
    summary = f"{status.present} of {days} required contiguous UTC dates present\n" + render.footprint(n_bytes, files, observed, days)
    return render.coverage(rows, csv), summary + (f"Missing UTC dates: {', '.join(missing)}\n" if missing else "")
