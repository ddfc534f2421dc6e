"""Compare registered queries with their oracles: python -m tests.check <sf_dir> [name ...]"""

from __future__ import annotations

import sys
import tempfile
import time
import traceback

from tests.oracle import compare, connect
from tidewatch.session import build_session


def main() -> int:
    import __spark_entry__

    QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    sf_dir, only = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="tidewatch-check-"), "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if only and not any(o in name for o in only):
            continue
        start = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, con, fn, ORACLES[name], sf_dir)
            else:
                df = fn(spark, sf_dir)
                problem = None if df.count() >= 0 else "?"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
            if only:
                traceback.print_exc()
        bad += problem is not None
        kind = "ok  " if name in ORACLES else "rows"
        print(f"{kind if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
