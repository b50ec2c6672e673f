"""Run registered queries against their SQL: python tests/check.py SF_DIR [name-part ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import connect, difference  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from chainlake.session import get_spark  # noqa: E402

if __name__ == "__main__":
    sf_dir, parts = sys.argv[1], sys.argv[2:]
    spark = get_spark(
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                problem = difference(df, con, sqls[name])
            else:
                n = len(df.collect())
                problem = None if n else "no rows"
        except Exception as exc:  # report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += problem is not None
        kind = "sql" if name in sqls else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failures:", bad)
