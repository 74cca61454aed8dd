"""Compare result types of the queries and their SQL twins: python tests/check_types.py [folder]"""

import sys
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]

from compare import duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from cellsight import session  # noqa: E402

GROUPS = {"tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "int", "double": "float", "float": "float", "string": "text", "varchar": "text"}


def group(kind):
    return GROUPS.get(kind.lower(), kind.lower())


folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
spark = session.build("local[4]", 4, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
spark.sparkContext.setLogLevel("OFF")
con = duck(folder)
for name, sql in entry.oracle_sql().items():
    if name.startswith("stream"):
        continue
    ours = {c: group(k) for c, k in entry.queries()[name](spark, folder).dtypes}
    theirs = {c: group(str(k)) for c, k in zip(*[[r[i] for r in con.execute("DESCRIBE " + sql).fetchall()] for i in (0, 1)])}
    wrong = {c: (ours[c], theirs.get(c)) for c in ours if ours[c] != theirs.get(c)}
    if wrong:
        print(name, wrong, flush=True)
print("checked")
