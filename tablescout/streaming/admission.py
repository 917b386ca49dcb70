"""Sliding-window admission on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tablescout.functions import constants as K


def admit_stream(
    events: DataFrame,
    key: str,
    time: str,
    tie: str,
    limit: int = K.ADMIT_MAX,
    seconds: int = K.ADMIT_SECONDS,
) -> DataFrame:
    """Decision per event of a stream: ``key, us, tie, admitted``.

    The state of a key is its admitted times inside the window, at most ``limit`` numbers, and
    is dropped once the watermark passes them. A trigger's rows of a key are put in time
    order first; limit the trigger size at the source.
    """
    window = seconds * 1_000_000
    ktype = events.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["us", "id"])
        flags = []
        for us in rows["us"]:
            held = [t for t in held if us - t < window]
            ok = len(held) < limit
            if ok:
                held.append(int(us))
            flags.append(ok)
        state.update((held,))
        if held:
            expiry = held[-1] // 1000 + seconds * 1000 + 1
            state.setTimeoutTimestamp(max(expiry, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"k": k[0], "us": rows["us"], "id": rows["id"], "admitted": flags})

    at = F.col(time).cast("timestamp")
    timed = events.select(
        F.col(key).alias("k"), at.alias("at"), F.unix_micros(at).alias("us"), F.col(tie).cast("long").alias("id")
    ).withWatermark("at", f"{seconds} seconds")
    out = timed.groupBy("k").applyInPandasWithState(
        step,
        outputStructType=f"k {ktype}, us long, id long, admitted boolean",
        stateStructType="held array<long>",
        outputMode="append",
        timeoutConf=GroupStateTimeout.EventTimeTimeout,
    )
    return out.select(F.col("k").alias(key), "us", F.col("id").alias(tie), "admitted")
