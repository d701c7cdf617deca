"""Windows over long timelines, cut into blocks so that one busy market is many tasks.

Times are microseconds since 1970 (BIGINT). A window over all of a market would put the market into
one task; here windows are per (market, block), rows that a block needs from its neighbours are
copied into it, and what must pass over whole blocks is carried by a table of one row per block.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from tidemark.functions.batches import groups
from tidemark.sources.store import shared_table

DAY = 86_400
MICROS = 1_000_000
#: The time until which a key is busy that is free.
FREE = -(2**63)


def micros(ntz: str) -> Column:
    """Microseconds of a TIMESTAMP_NTZ column, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ntz})")


def utc_date(ts: str = "ts") -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(ts) / (DAY * MICROS)).cast("int"))


def block_of(ts: str, seconds: int) -> Column:
    return F.floor(F.col(ts) / (seconds * MICROS))


#: Rows of one key that a block may hold, and rows of all keys for each part that blocks are dealt into.
BLOCK_ROWS = PART_ROWS = 50_000


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in so many parts. Left to itself Spark fits parts to the bytes they have when
    compressed, which says little of the rows that a task then sorts in memory."""
    return df.repartition(parts, *keys) if parts else df


def fitting_parts(df: DataFrame) -> int:
    return df.count() // PART_ROWS + 1


def fitting_block(df: DataFrame, keys: list[str], least: int = 1, ts: str = "ts") -> int:
    """Seconds of a block of which no key's holds many more than BLOCK_ROWS rows: ten days, or as much
    less as the busiest hour of any key asks for, but at least ``least``. One row reaches the driver."""
    hours = df.groupBy(*keys, F.floor(F.col(ts) / (3600 * MICROS)).alias("_hour")).agg(F.count(F.lit(1)).alias("_n"))
    most = hours.agg(F.max("_n")).first()[0] or 1
    return max(least, 60, min(10 * DAY, 3600 * BLOCK_ROWS // most))


def running(df: DataFrame, keys: list[str], order: list[str], aggregate, value: Column, name: str, seconds: int, ts: str = "ts", before: bool = False) -> DataFrame:
    """``aggregate`` (F.sum or F.max) of ``value`` over the rows up to this one, within ``keys`` in the
    given order, over all blocks; with ``before`` without this row. ``ts`` leads the order.

    A block's own total is one row, and only these are passed on from block to block."""
    df = df.withColumn("block", block_of(ts, seconds)).withColumn("_v", value)
    inside = Window.partitionBy(*keys, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    totals = df.groupBy(*keys, "block").agg(aggregate("_v").alias("_total"))
    blocks_before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_carry", aggregate("_total").over(blocks_before)).drop("_total")
    out = df.withColumn("_own", aggregate("_v").over(inside)).join(totals, [*keys, "block"])
    both = F.greatest("_own", "_carry") if aggregate is F.max else F.coalesce(F.col("_own") + F.col("_carry"), "_own", "_carry")
    return out.withColumn(name, both).drop("_v", "_own", "_carry", "block")


def _exits(ts: np.ndarray, takes: np.ndarray, until: np.ndarray) -> list[int]:
    """For each row of a block, in order: when its key is free again after the block if this is the first
    row that finds it free. ``takes`` tells which rows then keep the key busy."""
    after, ends, taking = np.searchsorted(ts, until).tolist(), until.tolist(), takes.tolist()
    out = [FREE] * (len(ts) + 1)
    for k in range(len(ts) - 1, -1, -1):
        out[k] = out[k + 1] if not taking[k] else out[after[k]] if after[k] < len(ts) else ends[k]
    return out[:-1]


def one_at_a_time(df: DataFrame, keys: list[str], order: list[str], until: Column, name: str, seconds: int) -> DataFrame:
    """``name``: whether the row finds its key free. A row that does and has ``until`` (micros, not
    before its own time) keeps the key busy for rows before that time; ``ts`` leads the order.

    Each block is folded once for every state it may begin with: a step function of the time until
    which the key is busy, with few steps. These alone are passed on from block to block, and then
    each block is folded with its own state. A key that never pauses is as many tasks as it has
    blocks, and the work is linear in its rows."""
    df = df.withColumns({"_block": block_of("ts", seconds), "_takes": until.isNotNull(), "_until": F.coalesce(until, F.lit(0)).cast("bigint")})
    place, parts = [*keys, "_block"], fitting_parts(df)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in groups(batches, place):
            ts = rows.column("ts").to_numpy()
            exits = _exits(ts, rows.column("_takes").to_numpy(zero_copy_only=False), rows.column("_until").to_numpy())
            times, firsts = np.unique(ts, return_index=True)
            exits = np.array(exits, np.int64)[firsts]
            last = np.append(exits[1:] != exits[:-1], True)
            yield pa.RecordBatch.from_pylist([dict(zip(place, key)) | {"upto": times[last].tolist(), "exit": exits[last].tolist()}], schema=steps_schema)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in groups(batches, keys):
            state, out = FREE, []
            for block, upto, exits in zip(*(rows.column(c).to_pylist() for c in ("_block", "upto", "exit"))):
                out.append(dict(zip(keys, key)) | {"_block": block, "_state": state})
                k = bisect_left(upto, state)
                state = exits[k] if k < len(upto) else state
            yield pa.RecordBatch.from_pylist(out, schema=carry_schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, busy = None, FREE
        for batch in batches:
            out = []
            keyed = zip(*(batch.column(c).to_pylist() for c in [*place, "ts", "_takes", "_until", "_state"]))
            for *key, ts, takes, until, state in keyed:
                if key != now:
                    now, busy = key, state
                out.append(ts >= busy)
                if takes and out[-1]:
                    busy = until
            kept = batch.drop_columns(["_block", "_takes", "_until", "_state"])
            yield kept.append_column(name, pa.array(out, pa.bool_()))

    key_fields = [df.schema[k] for k in place]
    array = ArrayType(LongType())
    steps_type = StructType([*key_fields, StructField("upto", array), StructField("exit", array)])
    carry_type = StructType([*key_fields, StructField("_state", LongType())])
    steps_schema, carry_schema = to_arrow_schema(steps_type), to_arrow_schema(carry_type)
    lean = df.select(*place, "ts", "_takes", "_until", *(c for c in order if c != "ts"))
    per_block = dealt(lean, parts, *place).sortWithinPartitions(*place, *order).mapInArrow(steps, steps_type)
    states = per_block.repartition(*keys).sortWithinPartitions(*place).mapInArrow(carry, carry_type)
    same = [df[c].eqNullSafe(F.col(f"_s.{c}")) for c in place]
    known = df.join(states.alias("_s"), reduce(lambda a, b: a & b, same)).select(*(df[c] for c in df.columns), "_state")
    kind = StructType([f for f in df.schema.fields if f.name not in ("_block", "_takes", "_until")] + [StructField(name, BooleanType())])
    return dealt(known, parts, *place).sortWithinPartitions(*place, *order).mapInArrow(fold, kind)


def in_blocks(df: DataFrame, seconds: int, before: int = 0, ts: str = "ts") -> DataFrame:
    """Each row in its own block (``own``), and as context in the next one if it lies within
    ``before`` seconds of it; ``before`` may not exceed the block."""
    if before > seconds:
        raise ValueError("a block must be as long as what looks back over it")
    b = block_of(ts, seconds)
    blocks = F.array(b, F.when(F.col(ts) + before * MICROS >= (b + 1) * (seconds * MICROS), b + 1))
    return df.withColumn("block", F.explode(F.array_compact(blocks) if before else F.array(b))).withColumn("own", F.col("block") == b)


def previous(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, seconds: int, where: Column, ts: str = "ts", parts: int | None = None, placed: bool = False) -> DataFrame:
    """Rows for which ``where`` holds, with ``name``: ``value`` of the row before, within ``keys`` in the given order,
    over all blocks; null at the start. ``placed`` tells that ``df`` has ``block`` and no block lies in several tasks.

    A block is sorted once, in parts dealt by rows. Its first row alone does not know what is before: this one, the last one
    and those that ``where`` holds for are written, and blocks hand on from there."""
    if not placed:
        df = dealt(df.withColumn("block", block_of(ts, seconds)), parts or fitting_parts(df), *keys, "block")
    inside = Window.partitionBy(*keys, "block").orderBy(*order)
    rows = df.withColumn("_box", F.struct(value.alias("v")))
    rows = rows.withColumns({"_prev": F.lag("_box").over(inside), "_last": F.lead(F.lit(True)).over(inside).isNull()})
    rows = rows.withColumns({"_first": F.col("_prev").isNull(), name: F.col("_prev.v")}).drop("_prev")
    kept = shared_table(rows.where(F.col("_first") | F.col("_last") | where), "previous")
    carry = kept.where("_last").select(*keys, "block", F.lag("_box").over(Window.partitionBy(*keys).orderBy("block")).alias("_carry"))
    known = kept.join(carry, [*keys, "block"]).withColumn(name, F.when(F.col("_first"), F.col("_carry.v")).otherwise(F.col(name)))
    return known.where(where).drop("_box", "_carry", "_first", "_last", "block")


def edges(df: DataFrame, keys: list[str], order: list[str], active: dict[str, Column], name: str, seconds: int, parts: int | None = None, placed: bool = False) -> DataFrame:
    """A row for each flag of ``active`` that turns true in a row of ``df``, with the flag's key in ``name``; any row
    where it is not true re-arms it. All flags share one pass over the rows."""
    flags = F.array(*(F.coalesce(a, F.lit(False)) for a in active.values())).cast("array<boolean>")
    turned = [F.col("_active")[k] & ~F.coalesce(F.col("_was")[k], F.lit(False)) for k in range(len(active))]
    any_ = reduce(lambda a, b: a | b, turned, F.lit(False))
    df = previous(df.withColumn("_active", flags), keys, order, F.col("_active"), "_was", seconds, any_, parts=parts, placed=placed)
    names = F.array_compact(F.array(*(F.when(t, F.lit(key)) for key, t in zip(active, turned))).cast("array<string>"))
    return df.withColumn(name, F.explode(names)).drop("_active", "_was")
