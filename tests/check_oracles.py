"""Compare every registered query with its SQL on a data folder and print the outcome."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from compare import compare, duckdb_over  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from diamondframe.session import local_session  # noqa: E402


def main(sf_dir: str, names: list[str]) -> int:
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = duckdb_over(sf_dir), oracle_sql(), 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        try:
            if name in sql:
                found = compare(spark, con, query, sql[name], sf_dir)
                good = found["equal"] and found["types"] is True
                print("ok  " if good else "BAD ", name, found if not good else
                      (found["rows"][0], found["seconds"]), flush=True)
                bad += not good
            else:
                begin = time.time()
                frame = query(spark, sf_dir)
                print("rows", name, frame.count(), round(time.time() - begin, 2), flush=True)
        except Exception:
            bad += 1
            print("FAIL", name, traceback.format_exc(limit=-4)[-1500:], flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
