"""Run registered queries against DuckDB: python tests/check_queries.py [folder] [name part ...]"""

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]

from compare import duck, mismatch  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from cellsight import session  # noqa: E402

folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
spark = session.build("local[8]", 8, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
spark.sparkContext.setLogLevel("OFF")
con = duck(folder)
sql = entry.oracle_sql()
bad = 0
for name, fn in entry.queries().items():
    if sys.argv[2:] and not any(p in name for p in sys.argv[2:]):
        continue
    start = time.time()
    try:
        found = mismatch(fn(spark, folder), con, sql[name]) if name in sql else f"(no SQL) rows {fn(spark, folder).count()}"
    except Exception as error:  # report and go on with the next query
        found = f"{type(error).__name__}: {str(error)[:400]}"
    bad += found is not None and not found.startswith("(no SQL)")
    print(f"{name:32s} {time.time() - start:6.2f}s {'ok' if found is None else found}", flush=True)
print("failures:", bad)
