"""Append sink of run records, partitioned by date."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablescout.operators.logs import log_rows


def append_runs(runs: DataFrame, path: str) -> None:
    """Append run records; list columns become JSON, history reads prune on ``log_date``."""
    log_rows(runs).write.mode("append").partitionBy("log_date").parquet(path)
