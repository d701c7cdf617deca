"""Wire frames and JSON payloads: strict decoding, normalization and the universe of markets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LEVELS = "array<struct<ask_price double, bid_price double, ask_size double, bid_size double>>"
FRAME = f"type string, code string, timestamp bigint, trade_price double, trade_volume double, ask_bid string, sequential_id decimal(20,0), total_ask_size double, total_bid_size double, orderbook_units {LEVELS}"


def normalize(frames: DataFrame, column: str = "frame") -> DataFrame:
    """One row per JSON frame, with ``error`` naming what is wrong: such rows go to a dead-letter
    table instead of ending the connection. An ``ask_bid`` other than BID is a sell."""
    f = frames.withColumn("f", F.from_json(column, FRAME))
    need = lambda *names: F.array_compact(F.array(*(F.when(F.col(f"f.{n}").isNull(), F.lit(n)) for n in names)))
    missing = F.when(F.col("f.type") == "trade", need("code", "timestamp", "trade_price", "trade_volume", "ask_bid")).when(F.col("f.type") == "orderbook", need("code", "timestamp", "total_ask_size", "total_bid_size", "orderbook_units"))
    error = F.when(missing.isNull(), "unknown type").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
    return f.withColumn("error", error)


def trades(normalized: DataFrame, *more: str) -> DataFrame:
    return normalized.where("error is null and f.type = 'trade'").select(
        F.col("f.code").alias("market"), F.col("f.timestamp").alias("ts_ms"), F.col("f.trade_price").alias("price"), F.col("f.trade_volume").alias("volume"),
        F.when(F.col("f.ask_bid") == "BID", "buy").otherwise("sell").alias("side"), F.col("f.sequential_id").alias("sequential_id"), *more,
    )


def orderbooks(normalized: DataFrame, *more: str) -> DataFrame:
    return normalized.where("error is null and f.type = 'orderbook'").select(
        F.col("f.code").alias("market"), F.col("f.timestamp").alias("ts_ms"), F.col("f.total_ask_size").alias("ask"), F.col("f.total_bid_size").alias("bid"), F.col("f.orderbook_units").alias("levels"), *more
    )


def unpack(packed: DataFrame, schema: StructType | str, required: list[str], column: str = "payload") -> DataFrame:
    """Typed columns of a JSON payload; bad JSON and a missing required field are errors."""
    typed = packed.withColumn("_row", F.from_json(column, schema, {"mode": "FAILFAST"}))
    whole = F.lit(True)
    for name in required:
        whole = whole & F.col(f"_row.{name}").isNotNull()
    checked = F.when(F.assert_true(whole, F.lit("a required field is missing")).isNull(), F.col("_row"))
    others = [c for c in packed.columns if c != column]
    return typed.withColumn("_row", checked).select("_row.*", *others)


def universe(tickers: DataFrame, k: int, prefix: str = "") -> DataFrame:
    """The k markets of the largest ``volume`` among those with the prefix; ties keep ticker order."""
    return tickers.where(F.col("market").startswith(prefix)).orderBy(F.desc("volume"), "ordinal").limit(k)
