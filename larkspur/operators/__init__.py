"""Relational operators as functions on DataFrames, for use by themselves or in ``pipeline.Pipeline``."""

from larkspur.operators.relational import (
    aggregate,
    as_of_join,
    cross_join,
    deal,
    distinct,
    filter_rows,
    gather,
    join,
    limit,
    offset,
    project,
    range_join,
    set_operation,
    sort,
    top_k,
    window,
)

__all__ = ["aggregate", "as_of_join", "cross_join", "deal", "distinct", "filter_rows", "gather", "join", "limit", "offset", "project", "range_join", "set_operation", "sort", "top_k", "window"]
