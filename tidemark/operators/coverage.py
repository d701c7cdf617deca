"""What has been collected: per day, missing days, observed seconds and the projected footprint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeline import MICROS, utc_date


def daily(trades: DataFrame, books: DataFrame, signals: DataFrame, connections: DataFrame) -> DataFrame:
    """One row per UTC date of any input: counts, distinct markets of trades and books, disconnected
    and stalled states and the gaps of ``connected`` rows."""
    tag = lambda df, kind, **more: df.select(utc_date().alias("date"), F.lit(kind).alias("kind"), "market", more.get("state", F.lit(None).cast("string")).alias("state"), more.get("gap", F.lit(None).cast("bigint")).alias("gap_ms"))
    rows = tag(trades, "trade").unionByName(tag(books, "book")).unionByName(tag(signals, "signal")).unionByName(tag(connections, "event", state=F.col("state"), gap=F.col("gap_ms")))
    is_ = lambda kind: F.col("kind") == kind
    gap = F.when(F.col("state") == "connected", F.col("gap_ms"))
    return rows.groupBy("date").agg(
        F.count(F.when(is_("trade"), 1)).alias("trades"),
        F.count(F.when(is_("book"), 1)).alias("books"),
        F.count(F.when(is_("signal"), 1)).alias("signals"),
        F.count_distinct(F.when(F.col("kind").isin("trade", "book"), F.col("market"))).alias("markets"),
        F.count(F.when(F.col("state") == "disconnected", 1)).alias("disconnected"),
        F.count(F.when(F.col("state") == "stalled", 1)).alias("stalled"),
        F.coalesce(F.sum(gap), F.lit(0)).alias("gap_ms"),
        F.coalesce(F.max(gap), F.lit(0)).alias("max_gap_ms"),
    )


def dates(*parts: DataFrame) -> DataFrame:
    out = parts[0].select(utc_date().alias("date"))
    for p in parts[1:]:
        out = out.unionByName(p.select(utc_date().alias("date")))
    return out.distinct()


def required_dates(present: DataFrame, days: int) -> DataFrame:
    """The ``days`` dates up to the last one present."""
    if days <= 0:
        raise ValueError("tuning and validation need at least one day each")
    last = present.agg(F.max("date").alias("end")).where("end is not null")
    return last.select(F.explode(F.sequence(F.date_sub("end", days - 1), F.col("end"))).alias("date"))


def missing_dates(present: DataFrame, days: int) -> DataFrame:
    return required_dates(present, days).join(present, "date", "left_anti")


def date_status(present: DataFrame, days: int) -> DataFrame:
    marked = required_dates(present, days).join(present.withColumn("here", F.lit(1)), "date", "left")
    return marked.agg(F.lit(days).alias("required"), F.max("date").alias("end_date"), F.count("here").alias("present"), F.count(F.when(F.col("here").isNull(), 1)).alias("missing"))


def require_dates(present: DataFrame, days: int) -> None:
    """The date gate: no data or a missing date is an error."""
    status = date_status(present, days).first()
    if status.end_date is None or status.missing:
        gone = [str(r.date) for r in missing_dates(present, days).orderBy("date").collect()]  # at most ``days`` rows
        raise ValueError(f"need {days} consecutive dates; missing: {', '.join(gone) or 'all'}")


def observed_seconds(*parts: DataFrame) -> DataFrame:
    """Distinct epoch seconds with any row, exactly."""
    seconds = [p.select(F.floor(F.col("ts") / MICROS).alias("s")) for p in parts]
    out = seconds[0]
    for s in seconds[1:]:
        out = out.unionByName(s)
    return out.agg(F.count_distinct("s").alias("observed_seconds"))
