"""Compare registered queries with their SQL: ``python tools/check_queries.py FOLDER [name ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from assayer.plans import registry
from assayer.plans.check import compare, duckdb_tables
from assayer.session import local_session


def main(folder: str, names: list[str]) -> int:
    spark = local_session()
    con = duckdb_tables(folder)
    bad = 0
    for name, (query, sql) in registry().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if sql:
                found = compare(spark, con, folder, query, sql)
            else:
                found = None if query(spark, folder).count() else "no rows"
        except Exception as error:  # a broken query must not hide the others
            found = f"{type(error).__name__}: {str(error)[:700]}"
        bad += found is not None
        print(f"{'ok ' if found is None else 'BAD'} {name} {time.time() - start:.1f}s{'' if sql else ' (no SQL)'} {found or ''}"[:1200], flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
