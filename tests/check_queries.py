"""Compare registered queries with their SQL: python tests/check_queries.py [scale] [name part ...]."""

from __future__ import annotations

import sys
import tempfile
import time
import traceback

sys.path.insert(0, __file__.rsplit("/", 2)[0])

import __spark_entry__ as entry  # noqa: E402
from recordforge.session import build_session  # noqa: E402
from tests.compare import compare, connect  # noqa: E402


def main() -> None:
    sf_dir = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    parts = sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"), "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, fn, oracles[name], sf_dir)
            else:
                problem = None if fn(spark, sf_dir).count() else "no rows"
        except Exception as e:
            problem = "".join(traceback.format_exception_only(e))[:900]
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok':4} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
