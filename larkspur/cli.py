"""A prompt for SQL: ``python -m larkspur.cli [table folder]``.

``tpchN`` runs a named query; a leading ``native`` is accepted; ``quit`` ends. Errors are told and the prompt goes on.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from larkspur import catalog, session
from larkspur.plans import registry


def frame_of(spark: SparkSession, sf_dir: str, line: str) -> DataFrame | None:
    """What a line asks for; None for an empty one."""
    text = line.strip().rstrip(";").strip()
    if text.lower().startswith("native "):
        text = text[7:].strip()
    if not text:
        return None
    name = text.lower()
    if name.startswith("tpch") and name[4:].isdigit():
        name = f"tpch{int(name[4:]):02d}"
    return registry.QUERIES[name](spark, sf_dir) if name in registry.QUERIES else spark.sql(text)


def loop(spark: SparkSession, sf_dir: str, read: Callable[[str], str] = input, say: Callable[[str], None] = print) -> None:
    catalog.register(spark, sf_dir)
    while True:
        try:
            line = read(">>> ")
        except EOFError:
            return
        if line.strip().rstrip(";").lower() in ("quit", "exit"):
            return
        began = time.time()
        try:
            found = frame_of(spark, sf_dir, line)
            if found is not None:
                say(found._show_string(1000, False))
                say(f"{time.time() - began:.3f} s")
        except PySparkException as error:
            say(f"Error occurred. Try again: {str(error).splitlines()[0]}")


if __name__ == "__main__":
    loop(session.build(), sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001")
