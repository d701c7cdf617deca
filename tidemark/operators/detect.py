"""Microstructure detectors over trades and order books."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timeline import MICROS, dealt, edges, fitting_block, fitting_parts, in_blocks, previous, running

ORDER = ["ts", "seq"]
SIGNAL = ["market", "ts", "seq", "signal_type", "rule_id", "direction", "feature_value", "baseline"]
#: Trades that must be in the window before a trade rule can be active.
LEAST = 5
#: A wall has gone when less than this share of it is left.
WALL_LEFT = 0.2


def number(x: float) -> str:
    """3.0 -> 3, 0.25 -> 0.25: the shortest digits that give the same number, without needless zeros."""
    return format(Decimal(repr(float(x))).normalize(), "f")


def prior_window(trades: DataFrame, seconds: int, block: int | None = None) -> DataFrame:
    """Trades with ``n`` and ``total`` (notional) of the trades before in the same market, not older
    than ``seconds``; trades of the same time and lower seq count as before.

    Each trade enters a running sum at its time and leaves it right after time + seconds, so a row
    costs the same however many trades the window holds. Blocks follow the busiest market's rate."""
    block = max(block or fitting_block(trades, ["market"], seconds), seconds)
    return _prior_window(trades, seconds, block).drop("block")


def _prior_window(trades: DataFrame, seconds: int, block: int) -> DataFrame:
    """``prior_window`` with each row's ``block``; none lies in several tasks."""
    parts = fitting_parts(trades)
    # dealt before a trade becomes two rows: a task that shuffles to many parts holds all that it sends
    rows = dealt(in_blocks(trades, block, seconds), parts, "market", "block")
    moves = F.array(F.struct(F.col("ts").alias("at"), F.lit(1).alias("sign")), F.struct((F.col("ts") + seconds * MICROS + 1).alias("at"), F.lit(-1).alias("sign")))
    both = rows.select("*", F.explode(moves).alias("_move")).withColumns({"at": F.col("_move.at"), "sign": F.col("_move.sign")}).drop("_move")
    running_sum = Window.partitionBy("market", "block").orderBy("at", "sign", "seq").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("n", F.coalesce(F.sum("sign").over(running_sum), F.lit(0)))
    both = both.withColumn("total", F.coalesce(F.sum(F.col("notional") * F.col("sign")).over(running_sum), F.lit(0)).cast("decimal(38,2)"))
    return both.where("sign = 1 and own").select(*trades.columns, "block", "n", "total", (F.col("total").cast("double") / F.greatest("n", F.lit(1))).alias("baseline"))


def _rules(kind: str, values: list[float]) -> dict[str, float]:
    """Values by the names of their rules; rules of the same name are one."""
    return {f"{kind}-{number(v)}": float(v) for v in values}


def _signals(df: DataFrame, kind: str, direction, feature, baseline, evidence: Column) -> DataFrame:
    """``evidence``: what the rule saw, as JSON."""
    return df.withColumns({"signal_type": F.lit(kind), "direction": direction, "feature_value": feature.cast("double"), "baseline": baseline.cast("double"), "evidence": F.to_json(evidence)}).select(*SIGNAL, "evidence")


def _trigger() -> Column:
    return F.struct("market", "ts", "seq", "price", "volume", "side").alias("trigger")


def trade_signals(trades: DataFrame, large: list[float], rates: list[float], seconds: int, block: int | None = None) -> list[DataFrame]:
    """Signals of large trades and of the trade rate, with their evidence, from one pass over the prior window."""
    block = max(block or fitting_block(trades, ["market"], seconds), seconds)
    window = _prior_window(trades, seconds, block)
    many, rate, base = F.col("n") >= LEAST, F.col("n") / F.lit(float(seconds)), F.lit(LEAST / seconds)
    big = {rule: many & (F.col("notional").cast("double") > F.col("baseline") * at) for rule, at in _rules("large", large).items()}
    fast = {rule: many & (rate > base * at) for rule, at in _rules("rate", rates).items()}
    fired = edges(window, ["market"], ORDER, big | fast, "rule_id", block, placed=True)
    of = lambda rules: fired.where(F.col("rule_id").isin(list(rules)))
    seen = F.struct(F.lit("trade").alias("source"), _trigger(), F.col("n").alias("rolling_trade_count"), F.col("total").cast("double").alias("rolling_notional_sum"), F.col("baseline").alias("rolling_notional_mean"))
    out = [_signals(of(big), "large_aggressive_trade", F.col("side"), F.col("notional"), F.col("baseline"), seen)]
    seen = F.struct(F.lit("trade").alias("source"), _trigger(), F.col("n").alias("rolling_trade_count"), F.lit(seconds).alias("window_seconds"), rate.alias("rolling_rate_per_second"), base.alias("baseline_rate_per_second"))
    return [*out, _signals(of(fast), "trade_rate_acceleration", F.col("side"), rate, base, seen)]


def large_trades(trades: DataFrame, multiples: list[float], seconds: int, block: int | None = None) -> DataFrame:
    return trade_signals(trades, multiples, [], seconds, block)[0]


def trade_rate(trades: DataFrame, multiples: list[float], seconds: int, block: int | None = None) -> DataFrame:
    return trade_signals(trades, [], multiples, seconds, block)[1]


def _book(*more: Column) -> Column:
    """Evidence of a book rule: the totals, the levels where the books have them, and ``more``."""
    return F.struct(F.lit("orderbook").alias("source"), F.col("bid").alias("total_bid_size"), F.col("ask").alias("total_ask_size"), *more)


def _levels(books: DataFrame) -> list[Column]:
    return [F.col("levels")] if "levels" in books.columns else []


def imbalance(books: DataFrame, thresholds: list[float], block: int | None = None) -> DataFrame:
    block = block or fitting_block(books, ["market"])
    im = F.when(F.col("ask") + F.col("bid") > 0, F.try_divide(F.col("bid") - F.col("ask"), F.col("bid") + F.col("ask")))
    active = {rule: F.abs("im") >= at for rule, at in _rules("imbalance", thresholds).items()}
    fired = edges(books.withColumn("im", im), ["market"], ORDER, active, "rule_id", block)
    return _signals(fired, "orderbook_imbalance", F.when(F.col("im") > 0, "buy").otherwise("sell"), F.col("im"), F.lit(0.0), _book(*_levels(books), F.col("im").alias("imbalance")))


def wall_drop(books: DataFrame, floor: float, block: int | None = None) -> DataFrame:
    """A book whose largest level is below a fifth of the book before's, if that was at least ``floor``.
    Books without levels give nothing and leave nothing to compare with."""
    wall = F.greatest("ask_wall", "bid_wall")
    df = books.withColumn("wall", wall).withColumn("wall_side", F.when(F.col("ask_wall") > F.col("bid_wall"), "sell").otherwise("buy"))
    fell = (F.col("before.wall") >= floor) & (F.col("wall") < F.col("before.wall") * WALL_LEFT)
    gone = previous(df, ["market"], ORDER, F.struct("wall", "wall_side"), "before", block or fitting_block(books, ["market"]), fell).withColumn("rule_id", F.lit("wall-drop"))
    walls = [F.col("before.wall").alias("previous_wall_krw"), F.col("before.wall_side").alias("previous_wall_side"), F.col("wall").alias("current_largest_wall_krw"), F.col("wall_side").alias("current_largest_wall_side")]
    return _signals(gone, "wall_disappearance", F.col("before.wall_side"), F.col("wall"), F.col("before.wall"), _book(*_levels(books), *walls))


def merged(trade_signals: list[DataFrame], book_signals: list[DataFrame]) -> DataFrame:
    """All signals with their place in event order: time, books before trades, then seq and rule."""
    parts = [s.withColumns({"is_trade": F.lit(k), "rule_no": F.lit(i)}) for k, group in enumerate([book_signals, trade_signals]) for i, s in enumerate(group)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def in_event_order(signals: DataFrame, rules: list[str]) -> DataFrame:
    """``signals`` with is_trade and rule_no: what found them goes by time, books before trades, seq, and the
    rules (``rules``, keys in the order in which they are tried)."""
    keys = F.array(*map(F.lit, rules))
    kind = F.col("signal_type").isin("large_aggressive_trade", "trade_rate_acceleration").cast("int")
    return signals.withColumns({"is_trade": kind, "rule_no": F.array_position(keys, F.concat_ws(":", "signal_type", "rule_id")).cast("int") - 1})


#: The order of events that ``in_event_order`` prepares.
EVENT_ORDER = ["ts", "is_trade", "seq", "rule_no"]


def checked(signals: DataFrame) -> DataFrame:
    """``signals``, of which one without a rationale or without evidence is an error when it is read."""
    blank = F.coalesce(F.trim("rationale") == "", F.lit(True))
    evidence = F.coalesce(F.col("evidence"), F.raise_error(F.lit("signal evidence must not be null")).cast("string"))
    return signals.withColumns({"rationale": F.when(blank, F.raise_error(F.lit("signal rationale must not be empty")).cast("string")).otherwise(F.col("rationale")), "evidence": evidence})


def snapshot(signals: DataFrame) -> DataFrame:
    """``signals`` with ``market_snapshot``: market, time, feature, baseline and evidence as JSON."""
    head = F.to_json(F.struct("market", F.col("ts").alias("exchange_ts"), F.col("feature_value").alias("feature"), "baseline"))
    return signals.withColumn("market_snapshot", F.concat(F.rtrim(head, F.lit("}")), F.lit(',"evidence":'), "evidence", F.lit("}")))


def rationale(seconds: int, floor: float) -> Column:
    """Why a signal fired, from its own figures and its evidence. The wording is fixed: stored signals
    and alerts are searched by it."""
    f, b, kind = F.col("feature_value"), F.col("baseline"), F.col("signal_type")
    at = F.regexp_extract("rule_id", "-([0-9.]+)$", 1).try_cast("double")
    times, n = F.bround(F.try_divide(f, b), 1), F.get_json_object("evidence", "$.rolling_trade_count").cast("bigint")
    return (
        F.when(kind == "large_aggressive_trade", F.format_string("aggressive notional %.0f is %.1fx rolling mean (threshold %.1fx over %d trades)", F.bround(f), times, at, n))
        .when(kind == "trade_rate_acceleration", F.format_string("%d trades in %ds window = %.1fx the 5-trade baseline (threshold %.1fx)", n, F.lit(seconds), times, at))
        .when(kind == "orderbook_imbalance", F.format_string("bid/ask size imbalance %.3f (threshold %.2f, %s-heavy)", F.bround(f, 3), at, F.when(f > 0, "bid").otherwise("ask")))
        .when(kind == "wall_disappearance", F.format_string("%.0f KRW %s wall fell to %.0f (%.0f%% drop, qualifying floor %.0f KRW)", F.bround(b), F.initcap("direction"), F.bround(f), F.bround((1 - F.try_divide(f, b)) * 100), F.lit(float(floor))))
    )


def sequence_check(trades: DataFrame, arrival: list[str], block: int | None = None) -> DataFrame:
    """``integrity``: ok, duplicate or out_of_order against the highest id before in the market's
    connection epoch; a null id is ok and gaps upward are fine. ``arrival`` orders the epoch, its
    first column is a time in microseconds."""
    keys, at = ["market", "epoch"], arrival[0]
    block = block or fitting_block(trades, keys, ts=at)
    df = running(trades, keys, arrival, F.max, F.col("sequential_id"), "_top", block, at, before=True)
    top = F.col("_top")
    state = F.when(F.col("sequential_id") == top, "integrity_duplicate").when(F.col("sequential_id") < top, "integrity_out_of_order").otherwise("ok")
    return df.withColumn("integrity", state).drop("_top")
