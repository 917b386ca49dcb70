"""Times as whole microseconds, free of the session's time zone for zone-less columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ZERO = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_micros(c: Column, kind: T.DataType) -> Column:
    """Microseconds since 1970 of a timestamp column of the given type."""
    if isinstance(kind, T.TimestampNTZType):
        seconds = (c - F.expr(_ZERO)).cast("interval second").cast("decimal(20,6)")
        return (seconds * 1_000_000).cast("long")
    return F.unix_micros(c.cast("timestamp"))


def from_micros(us: Column, kind: T.DataType) -> Column:
    """The timestamp of the given type at these microseconds."""
    if isinstance(kind, T.TimestampNTZType):
        zero = F.lit(0)
        seconds = us.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(10,0)")
        return F.expr(_ZERO) + F.make_dt_interval(zero, zero, zero, seconds.cast("decimal(18,6)"))
    return F.timestamp_micros(us)
