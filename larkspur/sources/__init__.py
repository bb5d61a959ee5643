"""Reading and writing tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession

__all__ = ["one_row", "scan", "scratch", "values", "write"]


def scan(spark: SparkSession, path: str | list[str], *, schema: str | None = None, columns: Sequence[str] | None = None, where: Column | str | None = None, kind: str = "parquet", **options) -> DataFrame:
    """A table of one or many files. Columns and filter reach the reader: only named columns are read, and row
    groups that the filter rules out are skipped. With a declared schema, columns that a file lacks are null."""
    reader = spark.read.format(kind).options(**options)
    found = (reader.schema(schema) if schema else reader).load(path)
    if where is not None:
        found = found.where(where)
    return found.select(*columns) if columns else found


def one_row(spark: SparkSession, **columns: Column) -> DataFrame:
    """A row without a table: SELECT without FROM."""
    row = spark.sql("SELECT 1 AS `_`")
    return row.select(*(c.alias(name) for name, c in columns.items()))


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from literals."""
    return spark.createDataFrame(rows, schema)


def write(df: DataFrame, path: str, *, kind: str = "parquet", partition_by: Sequence[str] = (), mode: str = "errorifexists", **options) -> None:
    """Writes a table, in folders by the values of some columns if wanted."""
    df.write.format(kind).mode(mode).options(**options).partitionBy(*partition_by).save(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in a folder that driver and executors share: ``spark.checkpoint.dir``, else the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
