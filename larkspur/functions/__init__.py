"""Scalar functions that Spark lacks or names differently, as built-in expressions where these are fast."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

__all__ = ["date_bin", "gcd", "iszero", "lcm", "safe_divide", "trunc", "whole_number"]


@F.pandas_udf(LongType())
def _gcd(x: pd.Series, y: pd.Series) -> pd.Series:
    return np.gcd(x, y)


def gcd(a: Column, b: Column) -> Column:
    """The greatest common divisor; gcd(0, 0) is 0.

    Arrow batches through numpy: Euclid's steps as built-in expressions are a higher-order function, which Spark
    interprets by row, several times slower.
    """
    a, b = a.cast("bigint"), b.cast("bigint")
    # pandas would hold a column with nulls as doubles, so none goes there
    return F.when(a.isNotNull() & b.isNotNull(), _gcd(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))))


def lcm(a: Column, b: Column) -> Column:
    """The least common multiple; 0 if either is 0."""
    return F.when((a == 0) | (b == 0), F.lit(0).cast("bigint")).otherwise(F.abs((a.cast("bigint") / gcd(a, b)).cast("bigint") * b))


def trunc(x: Column, digits: int = 0) -> Column:
    """Cuts a number off towards zero after so many digits."""
    scale = 10.0**digits
    return F.when(x < 0, F.ceil(x * scale)).otherwise(F.floor(x * scale)) / scale


def iszero(x: Column) -> Column:
    return x == 0


def safe_divide(a: Column, b: Column) -> Column:
    """Null where the divisor is zero."""
    return F.try_divide(a, b)


def whole_number(text: Column, kind: str = "int") -> Column:
    """A text's whole number, null where it is none. Only texts of digits are cast, as a failing cast is costly."""
    return F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), text.try_cast(kind))


def date_bin(size: str, at: Column) -> Column:
    """The start of the bin of a fixed size that a time falls in."""
    return F.window(at.cast("timestamp"), size)["start"]
