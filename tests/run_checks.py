"""Run registered queries against their SQL: ``run_checks.py FOLDER [NAME ...]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from compare import connect, differences  # noqa: E402
from postloom.session import build_session  # noqa: E402

spark = build_session("checks", "local[8]", os.environ.get("SHUFFLE", 8), spark__ui__enabled="false",
                      spark__driver__memory="12g")
spark.sparkContext.setLogLevel("ERROR")
folder, names = sys.argv[1], sys.argv[2:]
connection, sqls = connect(folder), oracle_sql()
for name, function in queries().items():
    if names and name not in names:
        continue
    start = time.time()
    try:
        frame = function(spark, folder)
        if name in sqls:
            extra, missing = differences(frame, connection, sqls[name])
            state = "ok" if not extra and not missing else (
                f"DIFF +{sum(extra.values())} -{sum(missing.values())}\n"
                f"   spark {str(sorted(extra.items(), key=str)[:3])[:600]}\n"
                f"   sql   {str(sorted(missing.items(), key=str)[:3])[:600]}")
            rows = "-"
        else:
            rows, state = frame.count(), "rows"
    except Exception as error:  # noqa: BLE001
        state, rows = f"FAIL {type(error).__name__} {str(error)[:900]}", "-"
    print(f"{name:28s} {time.time() - start:6.1f}s {rows} {state}", flush=True)
