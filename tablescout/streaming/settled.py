"""Admission on a stream in event time: decisions that do not depend on the order of arrival.

An event waits until the watermark has passed its slot, one window of time; then the slot's events
are folded in time order, so the decisions equal the batch form's. ``streaming.admission`` decides
at once instead, in the order in which triggers bring the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tablescout.functions import constants as K
from tablescout.operators.admission import admit_times

#: The state store that list and map state with timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Settled(StatefulProcessor):
    """State of a key: waiting events by slot and part, parts per slot, and the admitted times that still count.

    A slot's timer folds it, and every earlier one, whatever the order in which timers fire. The last
    timer of a key drops the admitted times once their window is over, so a quiet key has no state.
    """

    def __init__(self, limit: int, seconds: int):
        self.limit, self.seconds, self.window = limit, seconds, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "us long")
        self.parts = handle.getMapState("parts", "slot long", "n int")
        self.waiting = handle.getMapState("waiting", "slot long, part int", "us array<long>, id array<long>")

    def _timer(self, slot: int) -> None:
        self.handle.registerTimer((slot + 1) * self.seconds * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Each batch becomes its own part, so nothing is read back while rows arrive.
        for batch in rows:
            for slot, own in batch.groupby(batch["us"] // self.window):
                slot = int(slot)
                n = self.parts.getValue((slot,))[0] if self.parts.containsKey((slot,)) else 0
                if not n:
                    self._timer(slot)
                self.waiting.updateValue((slot, n), (own["us"].tolist(), own["id"].tolist()))
                self.parts.updateValue((slot,), (n + 1,))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs() * 1000
        slots = sorted(k[0] for k in self.parts.keys())
        due = [s for s in slots if (s + 1) * self.window <= end]
        held = [int(r[0]) for r in self.held.get()] if self.held.exists() else []
        for slot in due:
            parts = [self.waiting.getValue((slot, i)) for i in range(self.parts.getValue((slot,))[0])]
            us = np.concatenate([np.array(p[0], dtype=np.int64) for p in parts])
            ids = np.concatenate([np.array(p[1], dtype=np.int64) for p in parts])
            order = np.lexsort((ids, us))
            flags, held = admit_times(held, us[order], self.limit, self.window)
            for i in range(len(parts)):
                self.waiting.removeKey((slot, i))
            self.parts.removeKey((slot,))
            yield pd.DataFrame({"k": key[0], "us": us[order], "id": ids[order], "admitted": flags})
        held = [int(t) for t in held if t + self.window > end]
        if held:
            self.held.put([(t,) for t in held])
            if len(slots) == len(due):
                self._timer(held[-1] // self.window + 1)
        elif self.held.exists():
            self.held.clear()


def admit_settled(
    events: DataFrame,
    key: str,
    time: str,
    tie: str,
    limit: int = K.ADMIT_MAX,
    seconds: int = K.ADMIT_SECONDS,
    delay: str | None = None,
) -> DataFrame:
    """Decision per event of a stream: ``key, us, tie, admitted``, the same as of ``admit_events``.

    ``delay`` is how late an event may come, by default one window; later ones are dropped, as are
    events without a time. An event is decided once the watermark passes the end of its slot. Null keys
    are one key. A task holds one slot of a key at a time. The session's state store must be ``STORE``.
    """
    at, typ = F.col(time).cast("timestamp"), events.schema[key].dataType
    timed = (
        events.where(F.col(time).isNotNull())
        # A mark before the value keeps null apart from any text.
        .select(
            F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("k"),
            at.alias("at"), F.unix_micros(at).alias("us"), F.col(tie).cast("long").alias("id"),
        )
        .withWatermark("at", delay or f"{seconds} seconds")
    )
    out = timed.groupBy("k").transformWithStateInPandas(
        _Settled(limit, seconds), "k string, us long, id long, admitted boolean", "Append", "EventTime"
    )
    return out.select(
        F.when(F.col("k") != "", F.substring("k", 2, 2**31 - 1)).cast(typ).alias(key), "us", F.col("id").alias(tie), "admitted"
    )
