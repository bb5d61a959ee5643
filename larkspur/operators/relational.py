"""The operators. Each only adds to the logical plan; Catalyst chooses how it runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A side that is sent to all tasks on demand is estimated at no more.
SENT_BYTES = 64 << 20

SET_OPERATIONS = {
    "union_all": lambda a, b: a.unionByName(b),
    "union": lambda a, b: a.unionByName(b).distinct(),
    "intersect": lambda a, b: a.intersect(b),
    "intersect_all": lambda a, b: a.intersectAll(b),
    "except": lambda a, b: a.subtract(b),
    "except_all": lambda a, b: a.exceptAll(b),
}


def filter_rows(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows for which the condition is true; null counts as false."""
    return df.where(condition)


def project(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Named expressions; a string is SQL."""
    return df.select(*((F.expr(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()))


def aggregate(df: DataFrame, keys: Sequence[Column | str] = (), *, having: Column | str | None = None, by: str = "group", **aggregates: Column) -> DataFrame:
    """Groups by keys (none: one row, even for no input) with partial sums before the shuffle. Null keys are a group.

    ``by``: group, rollup or cube. Without aggregates, the distinct keys.
    """
    if not aggregates:
        return df.select(*keys).distinct()
    grouped = {"group": df.groupBy, "rollup": df.rollup, "cube": df.cube}[by](*keys)
    found = grouped.agg(*(a.alias(name) for name, a in aggregates.items()))
    return found.where(having) if having is not None else found


def distinct(df: DataFrame, *columns: str) -> DataFrame:
    return (df.select(*columns) if columns else df).distinct()


def join(left: DataFrame, right: DataFrame, on, how: str = "inner", *, small: bool = False) -> DataFrame:
    """A join by names, or by a condition that may hold more than equalities. Null keys match nothing.

    ``small`` expects a right side of fixed size (a dimension), which is sent to all tasks if its estimate is at most
    ``SENT_BYTES``; otherwise the sizes decide, at run time too.
    """
    return left.join(F.broadcast(right) if small and estimate(right) <= SENT_BYTES else right, on, how)


def estimate(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size in bytes; an upper bound for plain scans, filters and projections."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def cross_join(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.crossJoin(right)


def sort(df: DataFrame, *keys: str, nulls: str = "last") -> DataFrame:
    """A total order; ``-name`` is descending. Nulls stand where they are told to, in either direction."""

    def order(key: str) -> Column:
        column, down = F.col(key.lstrip("-")), key.startswith("-")
        return getattr(column, f"{'desc' if down else 'asc'}_nulls_{nulls}")()

    return df.orderBy(*map(order, keys))


def limit(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def offset(df: DataFrame, n: int) -> DataFrame:
    return df.offset(n)


def top_k(df: DataFrame, k: int, *keys: str, nulls: str = "last") -> DataFrame:
    """The first k in an order: each task keeps k rows, so nothing is sorted whole."""
    return sort(df, *keys, nulls=nulls).limit(k)


def deal(df: DataFrame, partitions: int | None = None, *keys: str, by_range: bool = False) -> DataFrame:
    """Deals rows out anew, by hash or ranges of keys; without a number, adaptive execution sizes the partitions."""
    run = df.repartitionByRange if by_range else df.repartition
    return run(*([partitions] if partitions else []), *keys)


def gather(df: DataFrame, partitions: int) -> DataFrame:
    """Fewer partitions without a shuffle."""
    return df.coalesce(partitions)


def set_operation(kind: str, left: DataFrame, right: DataFrame) -> DataFrame:
    return SET_OPERATIONS[kind](left, right)


def window(df: DataFrame, partition: Sequence[str], order: Sequence[Column | str], rows: tuple[int, int] | None = None, values: tuple[int, int] | None = None, **columns: Column) -> DataFrame:
    """Adds window expressions over partitions in an order, with a frame of rows or of values."""
    over = Window.partitionBy(*partition).orderBy(*order)
    if rows:
        over = over.rowsBetween(*rows)
    elif values:
        over = over.rangeBetween(*values)
    return df.withColumns({name: c.over(over) for name, c in columns.items()})


def range_join(points: DataFrame, spans: DataFrame, point: str, low: str, high: str, width: int, on: Sequence[str] = ()) -> DataFrame:
    """Rows of ``points`` with low <= point < high, by numeric bins of ``width`` in place of comparing all pairs.

    A span goes to each bin that it touches, its end's too, so ``width`` should be near the usual span.
    """
    bin_ = "_bin"
    while bin_ in points.columns or bin_ in spans.columns:
        bin_ += "_"
    first, last = F.floor(F.col(low) / width), F.floor(F.col(high) / width)  # the same rounding as a point's, so no bin is missed
    binned = spans.where(F.col(high) > F.col(low)).withColumn(bin_, F.explode(F.sequence(first, last)))
    keyed = points.withColumn(bin_, F.floor(F.col(point) / width))
    return keyed.join(binned, [*on, bin_]).where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop(bin_)


def as_of_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, columns: Sequence[str]) -> DataFrame:
    """Each left row with ``columns`` of the latest right row at or before it: one union, one shuffle, one window."""
    a = left.withColumns({"_time": F.col(left_time), "_side": F.lit(1)} | {f"_{c}": F.lit(None).cast(dict(right.dtypes)[c]) for c in columns})
    b = right.select(*on, F.col(right_time).alias("_time"), F.lit(0).alias("_side"), *(F.col(c).alias(f"_{c}") for c in columns))
    over = Window.partitionBy(*on).orderBy("_time", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    latest = F.last(F.when(F.col("_side") == 0, F.struct(*(F.col(f"_{c}").alias(c) for c in columns))), ignorenulls=True).over(over)
    found = both.withColumn("_latest", latest).where("_side = 1")
    return found.select(*left.columns, *(F.col("_latest")[c].alias(c) for c in columns))
