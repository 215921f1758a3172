"""Run registered queries against their SQL: python tests/check.py [sf] [name-prefix ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import differences, duck  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    sql = entry.oracle_sql()
    bad, slow = [], []
    names = [n for n in entry.queries() if not wanted or any(n.startswith(w) for w in wanted)]
    for name in names:
        t0 = time.time()
        try:
            df = entry.queries()[name](spark, folder)
            if name in sql:
                diff = differences(df, con, sql[name])
            else:
                diff = []
                n = len(df.collect())
                print(f"{name}: rows only, {n}")
        except Exception as e:  # report and go on
            diff = [f"{type(e).__name__}: {str(e)[:900]}"]
        took = time.time() - t0
        slow.append((took, name))
        if diff:
            bad.append(name)
            print(f"BAD {name} ({took:.1f}s)", *diff, sep="\n  ", flush=True)
        else:
            print(f"ok {name} {took:.1f}s", flush=True)
    print(f"{len(names) - len(bad)}/{len(names)} ok; bad: {bad}")
    print("slowest:", sorted(slow, reverse=True)[:8], "total", sum(s for s, _ in slow))


if __name__ == "__main__":
    main()
