"""Run every registered query against its DuckDB oracle at sf0.01.

usage: python tests/run_oracle.py [name-substring ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from cohortlens.session import local_session  # noqa: E402
from oracle import compare, duck  # noqa: E402

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def main(filters):
    spark = local_session()
    con = duck(SF)
    qs, sql = E.queries(), E.oracle_sql()
    ok = bad = rows_only = 0
    for name, fn in sorted(qs.items()):
        if filters and not any(f in name for f in filters):
            continue
        t = time.time()
        try:
            if name in sql:
                problems = compare(spark, con, name, fn, sql[name], SF)
            else:
                n = fn(spark, SF).count()
                problems = [] if n >= 0 else ["no rows"]
                rows_only += 1
        except Exception as exc:  # report and continue
            problems = [f"error {type(exc).__name__}: {str(exc)[:400]}"]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        dt = time.time() - t
        tag = "ok " if not problems else "BAD"
        if problems:
            bad += 1
        else:
            ok += 1
        print(f"{tag} {name:45s} {dt:6.2f}s {'(rows-only)' if name not in sql else ''} {'; '.join(problems)}", flush=True)
    print(f"ok={ok} bad={bad} rows_only={rows_only}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
