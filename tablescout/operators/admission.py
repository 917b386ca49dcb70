"""Sliding-window admission over whole event tables.

An event passes when fewer than ``limit`` admitted events of its key lie less than ``seconds``
before it. The decision depends on earlier decisions, so it is a fold in time order. Rows go
into range partitions by key and time (see ``operators.ordered``), so a hot key is cut by its
rows, and each partition is folded as a stream with ``limit`` times of state:

* A partition's first key starts from an empty state, which is a guess where the key goes on from the
  partition before. Every partition reports the state that its last key ends with.
* A head whose true state, the end of the partition before, is not the one that it used is folded
  again from there, until all agree. The result is exact for any data.

A pause of one window ends a state, and folds from different states mostly meet while a key stays
over its limit, so few heads change the end of their partition, and one more pass over the heads is
the rule. The worst case, a key whose folds never meet, needs one pass for each of its partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.functions import constants as K
from tablescout.functions.times import epoch_micros, from_micros
from tablescout.operators import ordered
from tablescout.operators.ordered import Edge
from tablescout.sources.lineage import cut_lineage

_ROW = f"k string, us long, id long, admitted boolean, piece int, {ordered.EDGE}"
_FEW = 16  # rows that are cheaper to walk than to count


def admit_times(held: list[int], us: np.ndarray, limit: int, window: int) -> tuple[np.ndarray, list[int]]:
    """Decisions for a key's times in order, and the admitted times that may still count."""
    if len(us) >= _FEW:
        # Where no window holds as many events as the limit, all pass.
        every = np.append(np.array(held, dtype=np.int64), us)
        mine = np.arange(len(held), len(every))
        if (mine - np.searchsorted(every, us - window, side="right") < limit).all():
            return np.ones(len(us), dtype=bool), [t for t in every[-limit:].tolist() if us[-1] - t < window]
    flags = np.zeros(len(us), dtype=bool)
    for i, t in enumerate(us.tolist()):
        while held and t - held[0] >= window:
            held = held[1:]
        if len(held) < limit:
            held = [*held, t]
            flags[i] = True
    return flags, held


def _fold(limit: int, window: int):
    """Stream of sorted rows (k, us, id) to decisions, and the partition's edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = ordered.this_piece()
        first, key, at, held = None, None, None, []
        for b in batches:
            if not b.num_rows:
                continue
            us, flags = b.column(1).to_numpy(), np.zeros(b.num_rows, dtype=bool)
            for k, lo, hi in ordered.segments(b.column(0)):
                if first is None:
                    first, at = k, int(us[lo])
                if k != key:
                    key, held = k, []
                flags[lo:hi], held = admit_times(held, us[lo:hi], limit, window)
            yield _decided(b, flags, piece)
        if first is not None:
            yield _edge(Edge(piece, first, key, at, held))

    return run


def _refold(limit: int, window: int):
    """Heads (k, us, id, piece, entry, whole) folded again from their entry; an edge where a head is all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, whole = None, [], False
        for b in batches:
            us, flags = b.column(1).to_numpy(), np.zeros(b.num_rows, dtype=bool)
            pieces = b.column(3).to_numpy()
            begin = np.flatnonzero(np.diff(pieces, prepend=-1)) if len(pieces) else []
            for lo, hi in zip(begin, np.append(begin[1:], len(pieces))):
                if pieces[lo] != now:
                    if whole:
                        yield _edge(Edge(int(now), key, key, 0, held))
                    now, key, held, whole = pieces[lo], b.column(0)[lo].as_py(), b.column(4)[lo].as_py(), b.column(5)[lo].as_py()
                flags[lo:hi], held = admit_times(held, us[lo:hi], limit, window)
            if b.num_rows:
                yield _decided(b, flags, b.column(3))
        if whole:
            yield _edge(Edge(int(now), key, key, 0, held))

    return run


def _decided(b: pa.RecordBatch, flags: np.ndarray, piece) -> pa.RecordBatch:
    n = b.num_rows
    pieces = pa.array(np.full(n, piece, dtype=np.int32)) if isinstance(piece, int) else piece
    return ordered.batch_of(
        [None] * n, k=b.column(0), us=b.column(1), id=b.column(2), admitted=pa.array(flags), piece=pieces
    )


def _edge(edge: Edge) -> pa.RecordBatch:
    none = lambda t: pa.nulls(1, t)
    return ordered.batch_of(
        [edge], k=none(pa.string()), us=none(pa.int64()), id=none(pa.int64()), admitted=none(pa.bool_()),
        piece=none(pa.int32()),
    )


def admit_events(
    events: DataFrame,
    key: str,
    time: str,
    tie: str,
    limit: int = K.ADMIT_MAX,
    seconds: int = K.ADMIT_SECONDS,
    pieces: int | None = None,
) -> DataFrame:
    """Decision per event: ``key, time, tie, admitted``. ``tie`` is a unique integer id.

    Events with a null key share one key of their own. An event without a time lies in no window and
    is not admitted. ``pieces`` is the number of range partitions, by default the session's.
    """
    spark, window = events.sparkSession, seconds * 1_000_000
    base = events.select(
        # A mark before the value keeps null apart from any text.
        F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("k"),
        epoch_micros(F.col(time), events.schema[time].dataType).alias("us"),
        F.col(tie).cast("long").alias("id"),
    )
    timeless = events.where(F.col(time).isNull()).select(
        key, time, F.col(tie).cast("long").alias(tie), F.lit(False).alias("admitted")
    )
    rows = ordered.ranged(base.where(F.col("us").isNotNull()), "k", "us", "id", pieces=pieces)
    first = cut_lineage(rows.mapInArrow(_fold(limit, window), _ROW))
    edges = ordered.edges_of(first)
    used: dict[int, list[int]] = {}
    last_run: dict[int, int] = {}
    runs = []
    while True:
        wrong = []
        for before, after in ordered.crossings(edges):
            entry = [t for t in before.state if after.at - t < window]
            if entry != used.get(after.piece, []):
                used[after.piece] = entry
                wrong.append((after.piece, after.first, entry, after.first == after.last))
        if not wrong:
            break
        last_run |= {w[0]: len(runs) for w in wrong}
        # At most one small row for each partition.
        heads = F.broadcast(spark.createDataFrame(wrong, "piece int, k string, entry array<long>, whole boolean"))
        again = (
            first.where("edge IS NULL").join(heads, ["piece", "k"]).select("k", "us", "id", "piece", "entry", "whole")
            .repartition("piece").sortWithinPartitions("piece", "us", "id")
        )
        done = cut_lineage(again.mapInArrow(_refold(limit, window), _ROW))
        runs.append(done)
        ends = {e.piece: e.state for e in ordered.edges_of(done)}
        edges = [e._replace(state=ends.get(e.piece, e.state)) for e in edges]
    decided = first.where("edge IS NULL")
    if runs:
        # A head keeps the rows of its last run.
        keys = {e.piece: e.first for e in edges}
        heads = F.broadcast(spark.createDataFrame([(p, keys[p], r) for p, r in last_run.items()], "piece int, k string, run int"))
        decided = decided.join(heads, ["piece", "k"], "left_anti")
        for i, done in enumerate(runs):
            mine = done.where("edge IS NULL").join(heads.where(F.col("run") == i), ["piece", "k"], "left_semi")
            decided = decided.unionByName(mine)
    typ = events.schema[key].dataType
    return decided.select(
        F.when(F.col("k") != "", F.substring("k", 2, 2**31 - 1)).cast(typ).alias(key),
        from_micros(F.col("us"), events.schema[time].dataType).alias(time),
        F.col("id").alias(tie),
        "admitted",
    ).unionByName(timeless)
