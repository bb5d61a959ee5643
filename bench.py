"""Times the queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query runs once to warm up and then BENCH_RUNS times into a sink that drops the rows; its time is the median,
planning included. BENCH_ONLY names queries to run alone.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from larkspur import session
from larkspur.plans import registry

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
ONLY = [x for x in os.environ.get("BENCH_ONLY", "").split(",") if x]


def once(run, spark) -> float:
    began = time.perf_counter()
    run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    with tempfile.TemporaryDirectory() as shared:
        spark = session.build(f"local[{CPUS}]", CPUS, **{"spark.driver.memory": "8g", "spark.checkpoint.dir": f"file://{shared}", "spark.log.level": "ERROR"})
        took = {}
        for name, run in registry.QUERIES.items():
            if ONLY and name not in ONLY:
                continue
            try:
                once(run, spark)
                took[name] = round(statistics.median(once(run, spark) for _ in range(RUNS)), 4)
            except Exception as error:  # noqa: BLE001  one failure shouldn't hide the other times
                print(f"{name}: {error}", file=sys.stderr)
        spark.stop()
    head = {k: v for k, v in took.items() if k.startswith("tpch")}
    print(json.dumps({"metric": "tpch_total_seconds", "value": round(sum(head.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
