"""Helpers the training-data operators share: shared scratch tables and bounded broadcasts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.store import discard, scratch, shared_root
from tidemark.sources.store import shared_table as materialize

__all__ = ["arrow_batches", "broadcast_if_small", "discard", "materialize", "scratch", "shared_root", "table"]

#: Small tables of up to this many rows may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when ``small`` (already materialized) has at most ``rows`` rows; else leave
    the join to be shuffled."""
    return F.broadcast(small) if len(small.select(F.lit(1)).take(rows + 1)) <= rows else small


@contextmanager
def arrow_batches(spark: SparkSession, size: str) -> Iterator[None]:
    """Tasks that are started inside hand Python batches of at most about ``size`` (or one row), which both sides hold
    beside the heap; Spark's own limit is 64 MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)
