"""Folds over the rows of each key in time order, cut into ranges of equally many rows.

``ranged`` sorts rows by key and time into range partitions whose borders Spark samples from the rows
themselves. So a key with a third of all rows covers a third of the partitions, whatever its times, and a
partition is folded as a stream. Only a partition's first key may have begun in the one before it: its
*head*. What crosses a border is a small state, one for each partition, so the driver can chain them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Edge(NamedTuple):
    """A partition's first and last key, the first key's first time, and the state that its last key ends with."""

    piece: int
    first: str
    last: str
    at: int
    state: list[int]


EDGE = "edge struct<piece:int,first:string,last:string,at:bigint,state:array<bigint>>"
_EDGE_TYPE = pa.struct([
    ("piece", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("at", pa.int64()),
    ("state", pa.list_(pa.int64())),
])


def ranged(rows: DataFrame, key: str, *order: str, pieces: int | None = None) -> DataFrame:
    """The rows in range partitions by key and order, sorted within them.

    Without ``pieces`` the session's number of shuffle partitions holds, and adaptive execution may
    join small neighbours.
    """
    columns = [key, *order]
    dealt = rows.repartitionByRange(pieces, *columns) if pieces else rows.repartitionByRange(*columns)
    return dealt.sortWithinPartitions(*columns)


def this_piece() -> int:
    return TaskContext.get().partitionId()


def segments(keys: pa.Array) -> Iterator[tuple[str, int, int]]:
    """``(key, begin, end)`` of the runs of equal values."""
    if not len(keys):
        return
    if isinstance(keys, pa.ChunkedArray):
        keys = keys.combine_chunks()
    coded = keys.dictionary_encode()
    code = coded.indices.to_numpy()
    begin = np.append(0, np.flatnonzero(np.diff(code)) + 1)
    names = coded.dictionary
    for lo, hi in zip(begin.tolist(), np.append(begin[1:], len(code)).tolist()):
        yield names[int(code[lo])].as_py(), lo, hi


def batch_of(edges: list[Edge | None], **columns: pa.Array) -> pa.RecordBatch:
    """Columns with an edge for each row; null columns where only edges are given."""
    edge = pa.array([e and e._asdict() for e in edges], _EDGE_TYPE)
    return pa.RecordBatch.from_arrays([*columns.values(), edge], names=[*columns, "edge"])


def edges_of(written: DataFrame) -> list[Edge]:
    """The edges of all partitions in order: one small row each, as many as there are partitions."""
    rows = written.where("edge IS NOT NULL").select("edge.*").collect()
    return sorted(Edge(r["piece"], r["first"], r["last"], r["at"], list(r["state"])) for r in rows)


def crossings(edges: list[Edge]) -> Iterator[tuple[Edge, Edge]]:
    """Neighbouring partitions between which a key goes on."""
    for before, after in zip(edges, edges[1:]):
        if before.last == after.first:
            yield before, after
