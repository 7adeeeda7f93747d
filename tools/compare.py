"""Run registered queries and compare them with their SQL on the same tables.

    python tools/compare.py [folder] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from sparkwitness.catalog import core  # noqa: E402
from sparkwitness.plans.session import build_session  # noqa: E402


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return f"{value}"
    return str(value)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(cell(r[i]) for i in order) for r in rows)


def connect(folder: str):
    con = duckdb.connect()
    for name in core.BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(spark, con, folder, name, build, sql):
    """Returns (rows, problem or None)."""
    df = build(spark, folder)
    columns, got = bag(df.columns, df.collect())
    rows = sum(got.values())
    if sql is None:
        return rows, None
    cursor = con.execute(sql)
    wanted_columns, wanted = bag([d[0] for d in cursor.description], cursor.fetchall())
    if columns != wanted_columns:
        return rows, f"columns {columns} vs {wanted_columns}"
    if got != wanted:
        extra, lost = got - wanted, wanted - got
        return rows, (
            f"{rows} vs {sum(wanted.values())} rows, {columns}\n   only spark {list(extra.items())[:3]}"
            f"\n   only sql   {list(lost.items())[:3]}"
        )
    return rows, None


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = build_session(
        "compare", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(folder), core.oracle_sql(), 0
    for name, build in core.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            rows, problem = compare(spark, con, folder, name, build, sqls.get(name))
        except Exception as error:  # report and go on with the next query
            rows, problem = 0, f"{type(error).__name__}: {str(error)[:900]}"
        bad += problem is not None
        state = "FAIL" if problem else ("ok" if name in sqls else "ok (no sql)")
        print(f"{state:12} {name:34} rows={rows:<8} {time.time() - start:5.1f}s {problem or ''}", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
