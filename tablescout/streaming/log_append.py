"""Continuous append of run records to the partitioned log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tablescout.operators.logs import log_rows


def append_stream(runs: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Exactly-once parquet append of a stream of runs."""
    writer = (
        log_rows(runs).writeStream.format("parquet").partitionBy("log_date")
        .option("checkpointLocation", checkpoint).outputMode("append")
    )
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
