"""The connection journal and the daily universe, from what was received."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timeline import DAY, MICROS, previous, utc_date


#: A stored connection event.
EVENT = "market string, ts bigint, state string, detail string, gap_ms bigint"


def connections(arrivals: DataFrame, stall_seconds: int, block: int = DAY) -> DataFrame:
    """(ts, epoch, state, gap_ms) of ``arrivals`` (ts of receipt, epoch = number of the connection):
    ``connected`` at an epoch's first arrival with the gap since the epoch before (null for the
    first), ``disconnected`` at the last one unless the epoch is the latest, and ``stalled`` wherever
    an epoch is quiet for ``stall_seconds`` or more, at the moment that is noticed."""
    epochs = arrivals.groupBy("epoch").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    line = Window.partitionBy(F.lit(0)).orderBy("epoch")  # one row per connection, not per record
    epochs = epochs.withColumns({"before": F.lag("last").over(line), "after": F.lead("first").over(line)})
    none = F.lit(None).cast("bigint")
    up = epochs.select(F.col("first").alias("ts"), "epoch", F.lit("connected").alias("state"), F.floor((F.col("first") - F.col("before")) / 1000).alias("gap_ms"))
    down = epochs.where("after is not null").select(F.col("last").alias("ts"), "epoch", F.lit("disconnected").alias("state"), none.alias("gap_ms"))
    quiet = previous(arrivals.select("epoch", "ts"), ["epoch"], ["ts"], F.col("ts"), "before", block, F.col("ts") - F.col("before") >= stall_seconds * MICROS)
    stalled = quiet.select((F.col("before") + stall_seconds * MICROS).alias("ts"), "epoch", F.lit("stalled").alias("state"), none.alias("gap_ms"))
    return up.unionByName(down).unionByName(stalled)


def daily_universe(trades: DataFrame, k: int) -> DataFrame:
    """(date, market, volume, place): each UTC date's k markets of the greatest traded notional; ties
    go by market name. Totals are one row per market and date before they are ranked."""
    total = trades.groupBy(utc_date().alias("date"), "market").agg(F.sum("notional").cast("double").alias("volume"))
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("volume"), "market"))
    return total.withColumn("place", place).where(F.col("place") <= k)


def universe_changes(universes: DataFrame) -> DataFrame:
    """(date, market, change): markets that joined or left against the date before that has a universe."""
    days = universes.select("date").distinct()
    days = days.withColumn("before", F.lag("date").over(Window.partitionBy(F.lit(0)).orderBy("date"))).where("before is not null")  # one row per date
    now = universes.select("date", "market").join(F.broadcast(days), "date").select("date", "market", F.lit(1).alias("here"))
    then = universes.select(F.col("date").alias("before"), "market").join(F.broadcast(days), "before").select("date", "market", F.lit(1).alias("was"))
    both = now.join(then, ["date", "market"], "full").where("here is null or was is null")
    return both.select("date", "market", F.when(F.col("was").isNull(), "joined").otherwise("left").alias("change"))


def refresh_due(last: datetime, now: datetime, hour: int) -> bool:
    """Whether the universe is to be fetched again: on a new UTC date, from ``hour`` on."""
    return now.date() != last.date() and now.hour >= hour
