"""List plan nodes that do not scale, per registered query, and time each query.

    python tools/plans.py [folder] [--time] [name-prefix ...]
"""

from __future__ import annotations

import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sparkwitness.catalog import core  # noqa: E402
from sparkwitness.plans.session import build_session  # noqa: E402

SUSPECTS = {
    "nested loop": r"BroadcastNestedLoopJoin",
    "product": r"CartesianProduct",
    "single partition": r"Exchange SinglePartition",
    "python": r"PythonUDF|BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups",
    "unbounded window": r"(?<!WindowGroupLimit )\bWindow \[",
    "gather": r"collect_list|collect_set",
}


def flags(df) -> dict[str, int]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = {name: len(re.findall(pattern, plan)) for name, pattern in SUSPECTS.items()}
    found["shuffles"] = len(re.findall(r"Exchange hashpartitioning", plan))
    return {k: v for k, v in found.items() if v}


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    timed = "--time" in sys.argv
    prefixes = tuple(a for a in sys.argv[2:] if not a.startswith("--"))
    spark = build_session(
        "plans", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    total = 0.0
    for name, build in core.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        df = build(spark, folder)
        note = flags(df)
        if timed:
            df.write.format("noop").mode("overwrite").save()
        seconds = time.time() - start
        total += seconds
        print(f"{name:34} {seconds:6.2f}s {note}", flush=True)
    print(f"total {total:.1f}s")


if __name__ == "__main__":
    main()
