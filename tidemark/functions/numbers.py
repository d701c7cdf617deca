"""Arithmetic of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quotient(a: Column, b: Column) -> Column:
    """``a / b`` by the rules of floating point: what is divided by 0 is infinite, 0 / 0 is not a number."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))
