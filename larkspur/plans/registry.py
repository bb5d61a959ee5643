"""All named queries of the engine and their DuckDB twins."""

from __future__ import annotations

from larkspur.plans import relational, tpch

QUERIES = {**tpch.QUERIES, **relational.QUERIES}
ORACLES = {**tpch.ORACLES, **relational.ORACLES}
