"""Compare a registered Spark query with its DuckDB counterpart.

``python -m tests.compare [folder] [name ...]`` runs them from the shell.
"""

from __future__ import annotations

import math
import sys
import tempfile
import time

import duckdb

from tablescout.sources.tables import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def rows_of(columns: list[str], rows: list) -> list[str]:
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(_value(r[i]) for i in at) for r in rows)


def difference(spark, con, folder: str, fn, sql: str | None) -> str:
    """Empty when both agree and the plan has no cross join and no row-wise Python."""
    df = fn(spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        if bad in plan:
            return f"plan has {bad}"
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if left else "no rows"
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    right = rows_of(cols, rel.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(cols)}"
    if not right:
        return "no rows"
    if left != right:
        only_l, only_r = sorted(set(left) - set(right)), sorted(set(right) - set(left))
        return f"rows {len(left)} / {len(right)}; spark only {len(only_l)}: {only_l[:2]}; duckdb only {len(only_r)}: {only_r[:2]}"
    return ""


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("compare")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="compare-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def main(args: list[str]) -> int:
    import __spark_entry__ as entry

    folder = args[0] if args else "/root/testdata/sf0.001"
    names = args[1:] or list(entry.queries())
    spark, con, oracle, bad = session(), connect(folder), entry.oracle_sql(), 0
    for name in names:
        t = time.time()
        try:
            diff = difference(spark, con, folder, entry.queries()[name], oracle.get(name))
        except Exception as e:
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(diff)
        print(f"{name:24s} {time.time() - t:6.2f}s {'ok' if not diff else 'BAD ' + diff}", flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
