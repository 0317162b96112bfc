"""python -m corvane.cli: audit, experiment, check-metrics and calibrate over a folder of tables."""

from __future__ import annotations

import argparse
import sys


def _show(df, top: int) -> None:
    cols = df.columns
    print("\t".join(cols))
    for r in df.limit(top).collect():
        print("\t".join(str(v) for v in r))


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="corvane")
    p.add_argument("command", choices=["audit", "experiment", "compare", "check-metrics", "calibrate"])
    p.add_argument("folder")
    p.add_argument("--top", type=int, default=20)
    p.add_argument("--out", help="also write the whole result as parquet")
    try:
        a = p.parse_args(args)
    except SystemExit as e:
        return int(e.code or 0)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from corvane.queries import queries
    from corvane.runtime import session

    spark = SparkSession.getActiveSession() or session()
    q = queries()
    name = {"audit": "sc_run_audit", "experiment": "hx_report", "compare": "hx_compare", "check-metrics": "eq_verify", "calibrate": "cal_fit"}[a.command]
    df = q[name](spark, a.folder)
    if a.out:
        df.write.mode("overwrite").parquet(a.out)
    _show(df.orderBy(F.desc("score")) if a.command == "audit" else df, a.top)
    return 0


if __name__ == "__main__":
    sys.exit(main())
