"""Trades and order books: the data model, and its mapping from the events and orders tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.timeline import micros
from tidemark.sources.wire import LEVELS

#: trades: market, ts (micros), seq, price, volume, side, notional DECIMAL(18,2)
#: books:  market, ts, seq, ask, bid (totals), ask_wall, bid_wall (null without levels)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        F.col("event_type").alias("market"),
        micros("ts").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        F.lit(1.0).alias("volume"),
        F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"),
        F.col("value").cast("decimal(18,2)").alias("notional"),
    )


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_orderdate")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag")
    ask = F.col("l_returnflag") == "N"
    sides = lines.groupBy("l_orderkey").agg(
        F.sum(F.when(ask, F.col("l_quantity").cast("decimal(18,2)"))).alias("ask"),
        F.sum(F.when(~ask, F.col("l_quantity").cast("decimal(18,2)"))).alias("bid"),
        F.max(F.when(ask, F.col("l_extendedprice"))).alias("ask_wall"),
        F.max(F.when(~ask, F.col("l_extendedprice"))).alias("bid_wall"),
        F.lit(True).alias("levels"),
    )
    zero = F.lit(0).cast("decimal(18,2)")
    return orders.join(sides, orders.o_orderkey == sides.l_orderkey, "left").select(
        F.col("o_orderpriority").alias("market"),
        micros("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("seq"),
        F.coalesce("ask", zero).cast("double").alias("ask"),
        F.coalesce("bid", zero).cast("double").alias("bid"),
        F.when(F.col("levels"), F.coalesce("ask_wall", F.lit(0.0))).alias("ask_wall"),
        F.when(F.col("levels"), F.coalesce("bid_wall", F.lit(0.0))).alias("bid_wall"),
    )


#: Fields of stored records, by dataset; what is not required may be missing or null.
TRADE = "market string, ts_ms bigint, receive_ns bigint, price double, volume double, side string, sequential_id decimal(20,0), epoch bigint"
BOOK = f"market string, ts_ms bigint, receive_ns bigint, ask double, bid double, levels {LEVELS}, epoch bigint"


def _numbered(records: DataFrame, order: list[str]) -> DataFrame:
    """``ts`` and ``seq``, unique as long as no millisecond holds a million records, and rising with
    ``order`` among rows of one time, whatever their market; only such rows are sorted together."""
    place = F.row_number().over(Window.partitionBy("ts_ms").orderBy(*order))
    return records.withColumns({"ts": F.col("ts_ms") * 1000, "seq": F.col("ts_ms") * 2**20 + place})


def trades_of(records: DataFrame) -> DataFrame:
    """Trades of stored records, in the order time, receipt, market, sequence id (none first), price,
    volume, side. Notional is kept to a hundredth, so that sums are exact in any order."""
    rows = _numbered(records, ["receive_ns", "market", "sequential_id", "price", "volume", "side"])
    return rows.select("market", "ts", "seq", "price", "volume", "side", (F.col("price") * F.col("volume")).cast("decimal(18,2)").alias("notional"))


def arrivals_of(records: DataFrame) -> DataFrame:
    """Receipt times (micros) with the connection's number; records stored without one are left out."""
    return records.where("epoch is not null").select(F.floor(F.col("receive_ns") / 1000).alias("ts"), "epoch")


def books_of(records: DataFrame) -> DataFrame:
    """Books of stored records, in the order time, receipt, market, total sizes, levels."""
    rows = books_from_levels(_numbered(records, ["receive_ns", "market", "ask", "bid", "levels"]))
    return rows.select("market", "ts", "seq", "ask", "bid", "ask_wall", "bid_wall", "levels")


def books_from_levels(records: DataFrame) -> DataFrame:
    """Books of records with ``levels`` ARRAY<STRUCT<ask_price, bid_price, ask_size, bid_size>>."""
    wall = lambda side: F.when(F.size("levels") > 0, F.greatest(F.lit(0.0), F.array_max(F.transform("levels", lambda x: x[f"{side}_price"] * x[f"{side}_size"]))))
    return records.withColumns({"ask_wall": wall("ask"), "bid_wall": wall("bid")})
