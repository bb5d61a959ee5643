"""A chain from a source over operators to a sink, built up step by step and run as one Spark plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from larkspur.operators import relational


class Pipeline:
    """``Pipeline(df).then("filter_rows", "x > 1").then("sort", "x")``: any operator by name, or a function."""

    def __init__(self, source: DataFrame, steps: tuple[str, ...] = ("source",)):
        self.frame, self.steps = source, steps

    def then(self, step: str | Callable[..., DataFrame], *args, **named) -> Pipeline:
        run = getattr(relational, step) if isinstance(step, str) else step
        return Pipeline(run(self.frame, *args, **named), (*self.steps, getattr(run, "__name__", "step")))

    def save_as(self, name: str) -> Pipeline:
        """Makes the rows so far known to SQL under a name."""
        self.frame.createOrReplaceTempView(name)
        return self

    def explain(self) -> str:
        """The steps, and the plan that Spark made of them."""
        return " -> ".join(self.steps) + "\n" + self.frame._jdf.queryExecution().explainString(self.frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def show(self, n: int = 20) -> None:
        self.frame.show(n, truncate=False)

    def collect(self) -> list:
        return self.frame.collect()
