"""Cooldown of alerts, and the paper-trading study: one position per market at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import quotient
from tidemark.functions.timeline import MICROS, block_of, fitting_block, one_at_a_time
from tidemark.sources.store import shared_table


def cooldown(signals: DataFrame, keys: list[str], seconds: int, order: list[str], block: int | None = None) -> DataFrame:
    """``emitted``: not within ``seconds`` of the last emitted signal of its key; a suppressed one
    does not extend the pause, and 0 seconds suppress nothing."""
    if seconds <= 0:
        return signals.withColumn("emitted", F.lit(True))
    return one_at_a_time(signals, keys, order, F.col("ts") + seconds * MICROS, "emitted", block or fitting_block(signals, keys))


def net_pct(direction: Column, entry: Column, exit_: Column, round_trip: float) -> Column:
    up, down = (quotient(exit_, entry) - 1) * 100, (quotient(entry, exit_) - 1) * 100
    return F.when(direction == "buy", up).otherwise(down) - round_trip


def paper_trades(done: DataFrame, start_ts: int, end_ts: int, round_trip: float, universe: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """Signals of the window in order, each ``filled``, ``skipped`` (its market's position is open)
    or ``incomplete`` (no entry or exit, or a market that ``universe`` does not hold; it holds no
    position). A position ends at its exit trade."""
    columns = ["market", "ts", "signal_type", "rule_id", "seq", "direction", "entry_price", "horizon_price", "complete", "exit_ts"]
    df = done.where(F.col("ts").between(start_ts, end_ts - 1)).select(columns)
    if universe is not None:
        known = universe.select("market", F.lit(True).alias("_in")).distinct()
        df = df.join(known, "market", "left").withColumn("complete", F.col("complete") & F.coalesce("_in", F.lit(False))).select(columns)
    order = ["ts", "signal_type", "rule_id", "seq"]
    out = one_at_a_time(df, ["market"], order, F.when(F.col("complete"), F.col("exit_ts")), "_free", block or fitting_block(df, ["market"]))
    state = F.when(~F.col("_free"), "skipped").when(F.col("complete"), "filled").otherwise("incomplete")
    net = net_pct(F.col("direction"), F.col("entry_price"), F.col("horizon_price"), round_trip)
    return out.withColumn("state", state).drop("_free").withColumn("net_pct", F.when(F.col("state") == "filled", net))


def tallies(trades: DataFrame) -> DataFrame:
    """Counts, wins, mean and compounded net result per rule (``section`` rule, rule_key), per market (market)
    and of all (total), from one pass over ``trades`` by grouping sets."""
    filled = F.col("state") == "filled"
    keyed = trades.select(F.concat_ws(":", "signal_type", "rule_id").alias("rule_key"), "market", "state", "net_pct")
    sets = keyed.groupingSets([[F.col("rule_key")], [F.col("market")], []], F.col("rule_key"), F.col("market"))
    level = F.grouping_id()
    return sets.agg(
        F.when(level == 1, "rule").when(level == 2, "market").otherwise("total").alias("section"),
        F.count(F.when(filled, 1)).alias("trades"),
        F.count(F.when(F.col("state") == "skipped", 1)).alias("skipped"),
        F.count(F.when(F.col("state") == "incomplete", 1)).alias("incomplete"),
        F.count(F.when(filled & (F.col("net_pct") > 0), 1)).alias("wins"),
        F.coalesce(F.round(F.avg("net_pct"), 6), F.lit(0.0)).alias("mean_net_pct"),
        F.coalesce(F.round((F.product(1 + F.col("net_pct") / 100) - 1) * 100, 6), F.lit(0.0)).alias("return_pct"),
    )


def by_rule(tallied: DataFrame) -> DataFrame:
    return tallied.where("section = 'rule'").drop("section", "market")


def hold(trades: DataFrame, start_ts: int, end_ts: int, round_trip: float) -> DataFrame:
    """Buy-and-hold per market of the window: first and last price in trade order."""
    key = F.struct("ts", "seq")
    ends = trades.where(F.col("ts").between(start_ts, end_ts - 1)).groupBy("market").agg(F.min_by("price", key).alias("first_price"), F.max_by("price", key).alias("last_price"))
    return ends.withColumn("hold_pct", F.round((quotient(F.col("last_price"), F.col("first_price")) - 1) * 100 - round_trip, 6))


def by_market(tallied: DataFrame, held: DataFrame) -> DataFrame:
    """Every market of the window's universe; one without trades returned nothing."""
    done = tallied.where("section = 'market'").drop("section", "rule_key")
    joined = held.join(done, "market", "left")  # a result that is not a number stays
    joined = joined.withColumns({f.name: F.coalesce(f.name, F.lit(0).cast(f.dataType)) for f in done.schema.fields if f.name != "market"})
    return joined.withColumn("excess_pct", F.round(F.col("return_pct") - F.col("hold_pct"), 6))


def drawdown(trades: DataFrame, held: DataFrame, block: int | None = None) -> DataFrame:
    """The equally weighted account's largest fall from a peak, in percent (0 or less).

    Sleeves start at 1 and change at closes, in order of exit; a close changes the account by its
    sleeve's change over the number of markets. A block is told by each market's growth in it, which multiplies
    over blocks; that gives every block its sleeves and account to begin with, so closes are walked
    once. A block then leaves its peak, its own largest fall and its low, and these merge: its low falls from
    the peaks before it. A value below 0, which a higher peak makes a smaller fall, is kept with its own peak."""
    closes = trades.where("state = 'filled'").join(held.select("market"), "market", "left_semi").select("exit_ts", "market", "ts", "signal_type", "rule_id", (1 + F.col("net_pct") / 100).alias("factor"))
    block = block or fitting_block(closes, [], ts="exit_ts")
    markets = held.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("markets"))
    closes = closes.withColumn("block", block_of("exit_ts", block))
    earlier = Window.partitionBy("market").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    grown = closes.groupBy("market", "block").agg(F.product("factor").alias("growth")).crossJoin(F.broadcast(markets))  # one row
    grown = shared_table(grown.withColumn("sleeve", F.coalesce(F.product("growth").over(earlier), F.lit(1.0))), "growth")
    change = F.sum(F.col("sleeve") * (F.col("growth") - 1) / F.col("markets"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    starts = grown.groupBy("block").agg(change.alias("change")).withColumn("start", 1 + F.coalesce(F.sum("change").over(before), F.lit(0.0))).drop("change")
    rows = closes.join(grown.drop("growth").join(starts, "block"), ["market", "block"])
    own = ["exit_ts", "ts", "signal_type", "rule_id"]
    up_to = Window.partitionBy("market", "block").orderBy(*own).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_after", F.col("sleeve") * F.product("factor").over(up_to))
    was = F.coalesce(F.lag("_after").over(Window.partitionBy("market", "block").orderBy(*own)), F.col("sleeve"))
    rows = rows.withColumn("_delta", (F.col("_after") - was) / F.col("markets"))
    account = Window.partitionBy("block").orderBy("exit_ts", "market", "ts", "signal_type", "rule_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("value", F.col("start") + F.sum("_delta").over(account)).withColumn("peak", F.greatest(F.lit(1.0), F.max("value").over(account)))
    positive = F.when(F.col("value") >= 0, F.col("value"))
    parts = rows.groupBy("block", F.when(F.col("value") < 0, F.col("peak")).alias("with_peak")).agg(F.max("peak").alias("peak"), F.min(positive / F.col("peak") - 1).alias("fall"), F.min(positive).alias("low"), F.min(F.when(F.col("value") < 0, F.col("value"))).alias("below"))
    return merged_fall(parts)


def merged_fall(parts: DataFrame) -> DataFrame:
    """The one row of ``drawdown`` from blocks' summaries."""
    peaks = parts.groupBy("block").agg(F.max("peak").alias("p")).withColumn("peak_before", F.coalesce(F.max("p").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))).drop("p")
    all_ = parts.join(peaks, "block")
    fall = F.least("fall", F.col("low") / F.col("peak_before") - 1, F.col("below") / F.greatest("peak_before", "with_peak") - 1)
    return all_.agg(F.round(F.least(F.lit(0.0), F.coalesce(F.min(fall) * 100, F.lit(0.0))), 6).alias("max_drawdown_pct"))


def summary(tallied: DataFrame, held: DataFrame) -> DataFrame:
    """The study's one row: counts over all, equally weighted strategy and hold, excess, verdict."""
    both = tallied.where("section <> 'rule'").join(held.select("market", "hold_pct", F.lit(True).alias("_held")), "market", "full")
    both = both.withColumn("return_pct", F.coalesce("return_pct", F.lit(0.0)))
    of_held = lambda c: F.coalesce(F.round(F.avg(F.when(F.col("_held"), c)), 6), F.lit(0.0))
    names = ["trades", "skipped", "incomplete", "wins"]
    total = both.agg(
        F.count("_held").alias("markets"),
        of_held(F.col("return_pct")).alias("strategy_pct"),
        of_held(F.col("hold_pct")).alias("hold_pct"),
        of_held(F.round(F.col("return_pct") - F.col("hold_pct"), 6)).alias("excess_pct"),
        *(F.coalesce(F.sum(F.when(F.col("section") == "total", F.col(c))), F.lit(0)).alias(c) for c in names),
    )
    verdict = F.when(F.round("excess_pct", 3) > 0, "STRATEGY").when(F.round("excess_pct", 3) < 0, "HOLD").otherwise("TIE")
    return total.withColumn("verdict", verdict)
