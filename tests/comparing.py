"""Comparing two tables, whatever the order of their rows and columns."""

import datetime
import decimal
import math


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
        return datetime.datetime(value.year, value.month, value.day)
    return value


def same_rows(columns, rows, other_columns, other_rows):
    """Both tables in one order of columns and rows."""
    names = sorted(columns)
    assert names == sorted(other_columns)

    def ordered(cols, found):
        at = [cols.index(c) for c in names]
        return sorted((tuple(plain(r[i]) for i in at) for r in found), key=repr)

    assert ordered(list(columns), rows) == ordered(list(other_columns), other_rows)
