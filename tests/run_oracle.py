"""python tests/run_oracle.py [sf] [name ...]: compare registered queries with their SQL."""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry  # noqa: E402
import oracle  # noqa: E402
from creditmill.session import build_session  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    con = oracle.connect(sf)
    bad = 0
    for name in names:
        started = time.time()
        try:
            df = queries[name](spark, f"{oracle.TESTDATA}/sf{sf}")
            if name in sqls:
                problem = oracle.compare(df, con, sqls[name])
            else:
                problem = None if df.count() > 0 else "no rows"
        except Exception as exc:  # noqa: BLE001
            problem = "".join(traceback.format_exception_only(exc))[:900]
        bad += problem is not None
        kind = "sql " if name in sqls else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {time.time() - started:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
