"""python tests/run_oracle.py [folder] [name part ...]: compares the catalogue with its SQL."""

import sys
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry
from offerlake.session import build_session
from tests.oracle import compare, duck


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = build_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = duck(folder), entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            ok, message, rows, took = compare(con, spark, folder, name, build, sql.get(name))
        except Exception as error:
            ok, rows, took = False, 0, 0.0
            message = "".join(traceback.format_exception_only(error))[:1500]
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:40s} {rows:8d} {took:6.2f}s {'' if ok and message == 'equal' else message}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
