"""Developer check: run queries against their oracles. Usage: check.py SF [name ...]"""

import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from pyspark.sql import SparkSession  # noqa: E402

from basisflow.queries.registry import ORACLES, QUERIES  # noqa: E402
import basisflow.queries  # noqa: E402,F401
from tests.harness import diff, duck, rows_of_spark, rows_of_sql  # noqa: E402


def main():
    sf = sys.argv[1]
    names = sys.argv[2:] or list(QUERIES)
    names = [n for q in names for n in QUERIES if n == q or (q.endswith("*") and n.startswith(q[:-1]))]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = duck(sf_dir)
    bad = []
    for n in names:
        t = time.time()
        try:
            cols, a = rows_of_spark(QUERIES[n](spark, sf_dir))
            t1 = time.time()
            if n not in ORACLES:
                print(f"rows  {n}: {len(a)} rows, {t1 - t:.1f}s")
                continue
            ocols, b = rows_of_sql(con, ORACLES[n])
            t2 = time.time()
            ok = cols == ocols and a == b
            print(f"{'ok   ' if ok else 'FAIL '} {n}: {len(a)}/{len(b)} rows, {t1 - t:.1f}s / sql {t2 - t1:.1f}s", flush=True)
            if not ok:
                bad.append(n)
                print("   cols", cols if cols == ocols else (cols, ocols))
                x, y = diff(a, b)
                for r in x:
                    print("   spark", r)
                for r in y:
                    print("   sql  ", r)
        except Exception as e:  # noqa: BLE001
            bad.append(n)
            print(f"ERROR {n}: {str(e)[:1500]}", flush=True)
    print(f"{len(names) - len(bad)}/{len(names)} good; bad: {bad}")


main()
