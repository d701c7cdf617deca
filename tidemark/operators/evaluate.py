"""Is a rule credible? Matched random controls, selection on tuning dates, bootstrap and gate."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timeline import MICROS, dealt, fitting_parts, utc_date
from tidemark.operators.outcomes import outcomes
from tidemark.sources.store import shared_table

#: Validation hit rate over tuning hit rate that the gate asks for; two-sided 95 percent in one tail.
RETENTION, TAIL = 0.80, 0.025


def fnv1a64(text: str) -> int:
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


def draw(size: Column, *parts: Column) -> Column:
    """A reproducible index from 0 to size - 1: 60 bits of the md5 of the parts, so that draws whose parts
    differ anywhere are independent, and any SQL engine gives the same."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("bigint") % size


def rule_key() -> Column:
    return F.concat_ws(":", "signal_type", "rule_id")


def control_pool(trades: DataFrame, horizon: int) -> DataFrame:
    """(market, date, pool_n): trades of each market's day that are followed by a whole horizon."""
    last = trades.groupBy("market").agg(F.max("ts").alias("last_ts"))
    full = trades.join(last, "market").where(F.col("ts") <= F.col("last_ts") - horizon * MICROS)
    return full.groupBy("market", utc_date().alias("date")).agg(F.count(F.lit(1)).alias("pool_n"))


def control_pairs(done: DataFrame, trades: DataFrame, horizon: int, max_lag: int, target_pct: float, seed: int, tuning_end: str, step: int = 3600) -> DataFrame:
    """Each complete outcome with that of one trade drawn from its market's and day's pool, taken in
    the signal's direction: hit and control per (market, ts, seq, rule). Draws differ by split (train up
    to ``tuning_end``, validation after it) and by rule.

    A day's trades are numbered within steps of ``step`` seconds, and a drawn number is looked up in the
    counts of steps first, so no market's day is one task."""
    day = trades.withColumn("date", utc_date()).withColumn("step", F.floor(F.col("ts") / (step * MICROS)))
    counts = shared_table(day.groupBy("market", "date", "step").agg(F.count(F.lit(1)).alias("in_step")), "steps")
    before = Window.partitionBy("market", "date").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("first", F.coalesce(F.sum("in_step").over(before), F.lit(0)))
    rank = Window.partitionBy("market", "date", "step").orderBy("ts", "seq")
    numbered = dealt(day.select("market", "date", "step", "ts", "seq"), fitting_parts(trades), "market", "date", "step").withColumn("place", F.row_number().over(rank) - 1).select("market", "date", "step", "place", F.col("ts").alias("control_ts"))
    signals = done.where("complete").withColumn("date", utc_date()).join(control_pool(trades, horizon), ["market", "date"])
    split = F.when(F.col("date") <= F.lit(tuning_end).cast("date"), "train").otherwise("validation")
    signals = signals.withColumn("nth", draw(F.col("pool_n"), F.lit(seed), split, rule_key(), F.col("market"), F.col("ts"), F.col("seq")))
    within = (F.col("nth") >= F.col("first")) & (F.col("nth") < F.col("first") + F.col("in_step"))
    signals = signals.join(counts, ["market", "date"]).where(within).withColumn("place", F.col("nth") - F.col("first"))
    signals = shared_table(signals.join(numbered, ["market", "date", "step", "place"]).withColumnRenamed("ts", "signal_ts").withColumnRenamed("control_ts", "ts"), "controls")
    columns = ["market", "ts", "seq", "signal_type", "rule_id", "direction", "signal_ts", "date", "reached_target"]
    control = outcomes(signals.select(*columns).withColumnRenamed("reached_target", "hit"), trades, horizon, max_lag, target_pct)
    return control.select("market", F.col("signal_ts").alias("ts"), "seq", "signal_type", "rule_id", "date", "hit", F.coalesce("reached_target", F.lit(False)).alias("control"))


def candidates(signals: DataFrame, pairs: DataFrame, tuning_end: str) -> DataFrame:
    """Per rule, also one without pairs: tuning pairs, hit rates of signals and controls, and lift."""
    keys = signals.select("signal_type", rule_key().alias("rule_key")).distinct()
    train = pairs.where(F.col("date") <= F.lit(tuning_end).cast("date")).groupBy(rule_key().alias("rule_key")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("hit").cast("int")).alias("hits"), F.sum(F.col("control").cast("int")).alias("control_hits")
    )
    out = keys.join(train, "rule_key", "left").na.fill(0, ["n", "hits", "control_hits"])
    rate = lambda c: F.col(c) / F.greatest("n", F.lit(1))
    return out.withColumns({"hit_rate": rate("hits"), "control_rate": rate("control_hits"), "lift": rate("hits") - rate("control_hits")})


def select_rules(summary: DataFrame) -> DataFrame:
    """Of each signal type the rule of the greatest lift, then most pairs, then smallest key."""
    best = Window.partitionBy("signal_type").orderBy(F.desc("lift"), F.desc("n"), "rule_key")
    return summary.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def cumulative(n: int, plus: int, minus: int) -> tuple[int, np.ndarray]:
    """The least value d0 and P(D <= d0 + k) of D, the sum of ``n`` draws from n pairs of which ``plus`` count
    1, ``minus`` count -1 and the others 0.

    The characteristic function of one draw to the n-th power is turned back by one FFT. Only some twelve
    standard deviations to either side are kept, outside of which no resample of any number falls."""
    p, m, mean = plus / n, minus / n, plus - minus
    half = math.ceil(12 * math.sqrt(max(0.0, n * (p + m - (p - m) ** 2)))) + 30
    low, high = max(-n, mean - half), min(n, mean + half)
    size = 1 << (2 * half + 1).bit_length()
    t = 2 * np.pi * np.arange(size) / size
    away = -2 * np.sin(t / 2) ** 2  # cos t - 1 without cancellation
    with np.errstate(divide="ignore"):
        powers = np.exp(n * np.log1p((p + m) * away + 1j * (p - m) * np.sin(t)) - 1j * t * mean)
    mass = np.maximum(np.fft.fft(powers).real / size, 0)
    total = np.cumsum(mass[np.arange(low - mean, high - mean + 1)])
    return low, total / total[-1]


def bootstrap(counts: DataFrame, iterations: int, seed: int) -> DataFrame:
    """(rule_key, ci_low, ci_high) of mean(hit) - mean(control) over resampled pairs: the exact order
    statistics floor((B - 1) a) and floor((B - 1) (1 - a)) of B resamples.

    ``counts`` has per rule n pairs, plus (hit, control not), minus (control hit, signal not) and tail.
    A resample's statistic is the sum of its n draws over n, so one number is drawn for it, by inverting the
    sum's distribution: draws are merged with its cumulative table, which has some sqrt(n) rows, and take
    the value that they fall on. The work is B + sqrt(n) rows a rule."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                low, shares = cumulative(r["n"], r["plus"], r["minus"])
                yield pa.RecordBatch.from_arrays([pa.array([r["rule_key"]] * len(shares)), pa.array(np.arange(low, low + len(shares))), pa.array(shares)], ["rule_key", "d", "v"])

    steps = counts.select("rule_key", "n", "plus", "minus").mapInArrow(tables, "rule_key string, d bigint, v double")
    rows = counts.select("rule_key", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("b"))
    uniform = (draw(F.lit(2**60), F.lit(seed), F.lit("bootstrap"), F.col("rule_key"), F.col("b")) + 0.5) / 2.0**60
    merged = steps.unionByName(rows.withColumn("v", uniform), allowMissingColumns=True)
    # downwards, the last step at or above a draw is the one it falls on
    down = Window.partitionBy("rule_key").orderBy(F.desc("v"), F.col("b").isNotNull(), F.desc("d")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    drawn = merged.withColumn("at", F.last("d", ignorenulls=True).over(down)).where("b is not null")
    stats = drawn.join(F.broadcast(counts.select("rule_key", "n", "tail")), "rule_key").withColumn("stat", F.col("at") / F.col("n"))
    place = F.row_number().over(Window.partitionBy("rule_key").orderBy("stat", "b")) - 1  # one row per resample
    low, high = F.floor((iterations - 1) * F.col("tail")), F.floor((iterations - 1) * (1 - F.col("tail")))
    return stats.withColumn("k", place).groupBy("rule_key").agg(F.max(F.when(F.col("k") == low, F.col("stat"))).alias("ci_low"), F.max(F.when(F.col("k") == high, F.col("stat"))).alias("ci_high"))


def gate(selected: DataFrame, validation: DataFrame, iterations: int, seed: int, least: int, corrected: bool = True) -> DataFrame:
    """Selected rules with their validation figures and whether they pass: enough signals, a lower
    bound above 0 and at least 80 percent of the tuning hit rate kept. With ``corrected`` the tail is
    divided by the number of selected rules that have validation pairs."""
    pairs = validation.withColumn("rule_key", rule_key()).join(F.broadcast(selected.select("rule_key")), "rule_key")  # a rule per signal type
    hit, control = F.col("hit").cast("int"), F.col("control").cast("int")
    stats = pairs.groupBy("rule_key").agg(F.count(F.lit(1)).alias("val_n"), F.avg(hit).alias("val_rate"), F.avg(control).alias("val_control"), F.count(F.when(hit > control, 1)).alias("plus"), F.count(F.when(hit < control, 1)).alias("minus"))
    stats = shared_table(stats.withColumn("family", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))), "validation")  # one row per signal type
    tail = TAIL / F.col("family") if corrected else F.lit(TAIL)
    ci = bootstrap(stats.select("rule_key", F.col("val_n").alias("n"), "plus", "minus", tail.alias("tail")), iterations, seed)
    out = selected.select("signal_type", "rule_key", "hit_rate").join(stats, "rule_key", "left").join(ci, "rule_key", "left")
    out = out.na.fill(0, ["val_n", "val_rate", "val_control", "ci_low", "ci_high"])
    retention = F.when(F.col("hit_rate") > 0, F.col("val_rate") / F.col("hit_rate")).otherwise(F.lit(0.0))
    out = out.withColumn("retention", retention)
    return out.select("signal_type", "rule_key", "val_n", "val_rate", "val_control", "retention", "ci_low", "ci_high", ((F.col("val_n") >= least) & (F.col("ci_low") > 0) & (F.col("retention") >= RETENTION)).alias("passed"))

