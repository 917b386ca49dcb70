"""Packing documents into training sequences by vector best fit.

A document becomes the ids of its text and an end id; what is longer than a sequence is cut into
full pieces, of which the first may be shorter. A sequence has three capacities: tokens, documents
and attention cost (the sum of squared piece lengths). Pieces go in by falling length, each to the
open sequence that scores best among those where it fits under every capacity:

* ``dot``: the largest weighted dot product of the piece's needs with what is left, or
* ``norm``: the smallest weighted norm of what would be left after it.

All three needs follow from a piece's length, so pieces of one length are alike, and so are
sequences with the same fill. The driver therefore packs counts per length (a table of at most
``capacity`` rows, whatever the size of the corpus) and gets *runs*: the next ``n`` pieces of
a length go to consecutive sequences, ``q`` to each, from a given offset. Tasks then look up the run
of each piece by its number among the pieces of its length. Numbers come from counts per (length,
block of the id's hash), so that a length which a third of all pieces have is spread over many
blocks; no texts or ids are shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescout.llm import textbytes as B
from tablescout.llm.common import folds, stored
from tablescout.llm.tokens import encoder

#: Pieces numbered in one block.
BLOCK_ROWS = 1024
#: Bytes of text whose ids and pieces a task holds at a time.
_CHUNK = 512 * 1024


class Limits(NamedTuple):
    """Capacities of a sequence, their weights in the score, and the score."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"


class Run(NamedTuple):
    """``n`` pieces of a length: the i-th goes to sequence ``first + i // each``."""

    length: int
    start: int  # number of the first piece among those of its length
    n: int
    first: int
    each: int
    offset: int  # of a sequence's first piece of this run


def best_fit(counts: dict[int, int], limits: Limits = Limits()) -> list[Run]:
    """Pack counts per length; sequences get the numbers from 0."""
    cap = np.array([limits.tokens, limits.documents, limits.attention], dtype=float)
    weight = np.array(limits.weights, dtype=float)
    runs: list[Run] = []
    # A group of alike sequences: first number, how many, what is left.
    first, many = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    left = np.empty((0, 3))
    made = 0
    for length in sorted((k for k, c in counts.items() if c), reverse=True):
        need = np.array([length, 1, length * length], dtype=float)
        todo, number = counts[length], 0
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        room = np.floor(np.min(left / need, axis=1) + 1e-9).astype(np.int64) if len(left) else np.empty(0, dtype=np.int64)
        fits = np.flatnonzero(room > 0)
        if limits.rule == "dot":
            score = -((left[fits] / cap) * (need / cap) * weight).sum(axis=1)
        else:
            score = (weight * ((left[fits] - need) / cap) ** 2).sum(axis=1)
        news = []
        # Once a sequence has one such piece it scores best for the next, until it is full.
        for g in fits[np.lexsort((first[fits], score))].tolist():
            if not todo:
                break
            each = int(room[g])
            whole = min(int(many[g]), todo // each)
            for n_seq, q in ((whole, each), (int(whole < many[g] and todo - whole * each > 0), todo - whole * each)):
                if n_seq:
                    runs.append(Run(length, number, n_seq * q, int(first[g]), q, int(cap[0] - left[g][0])))
                    news.append((int(first[g]), n_seq, left[g] - q * need))
                    number, todo = number + n_seq * q, todo - n_seq * q
                    first[g] += n_seq
                    many[g] -= n_seq
        each = int(np.floor(np.min(cap / need) + 1e-9))
        for n_seq, q in ((todo // each, each), (int(todo % each > 0), todo % each)):
            if n_seq:
                runs.append(Run(length, number, n_seq * q, made, q, 0))
                news.append((made, n_seq, cap - q * need))
                number, made = number + n_seq * q, made + n_seq
        if news:
            first = np.append(first, [x[0] for x in news])
            many = np.append(many, [x[1] for x in news])
            left = np.vstack([left, [x[2] for x in news]])
        # Full sequences and emptied groups take nothing more.
        live = (many > 0) & (left.min(axis=1) > 0) if len(left) else np.empty(0, dtype=bool)
        first, many, left = first[live], many[live], left[live]
    return runs


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(
    docs: DataFrame, tokenizer: str, end_id: int, tokens: int = 1024, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of every document: ``doc_id, piece, start, length, ids_crc32`` and ``ids``.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit numbers. Null and empty texts are
    one piece with the end id. Rows with equal ids stay separate rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        # A part of a batch at a time, so that its ids and pieces stay small.
        parts = ((b.column(0).slice(at, len(some)), some) for b in batches for at, some in B.chunks(b.column(1), _CHUNK))
        for keys, some in parts:
            ids, at = encode.ids(some)
            rows: list = []
            for k, lo, hi in zip(keys.to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                own = np.append(ids[lo:hi], np.uint32(end_id)).astype("<u4")
                n = len(own)
                start, stop, piece = 0, n - (n - 1) // tokens * tokens, 0
                while start < n:
                    part = own[start:stop]
                    rows.append((k, piece, start, stop - start, zlib.crc32(part.tobytes()), part if with_ids else None))
                    start, stop, piece = stop, stop + tokens, piece + 1
            if rows:
                cols = list(zip(*rows))
                arrays = [
                    pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
                    *[pa.array(c, pa.int64()) for c in cols[2:5]],
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    sizes = np.append(0, np.cumsum(cols[3]))
                    flat = pa.array(np.concatenate(cols[5]).astype(np.int32))
                    arrays.append(pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, _PIECE + (", ids array<int>" if with_ids else ""))


def pack(cut: DataFrame, limits: Limits = Limits(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; other columns travel along.

    Offsets in a sequence run from 0 without gaps. Sequence numbers are consecutive. Pieces that are
    alike (id, piece, length, checksum) may change places with each other, nothing else depends on
    how rows are split. No pieces give no rows.
    """
    spark = cut.sparkSession
    per_length = [tuple(r) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()]
    if not per_length:
        return cut.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    counts = {int(k): int(n) for k, n in per_length}
    runs = best_fit(counts, limits)
    # As many runs as there are pairs of a length and a kind of fill, however many pieces there are.
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 6)
    table = spark.sparkContext.broadcast(table)
    blocks = folds(max(counts.values()), block_rows)
    block = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).cast("int")
    placed = cut.withColumn("_block", block)
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        placed.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n"))
        .select("length", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    within = Window.partitionBy("length", "_block").orderBy("doc_id", "piece", "ids_crc32", "start")
    numbered = placed.withColumn("_nth", F.row_number().over(within) - 1).join(sizes, ["length", "_block"])
    numbered = numbered.withColumn("_number", F.col("_before") + F.col("_nth")).drop("_block", "_before", "_nth")
    names = numbered.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in numbered.dtypes if n != "_number")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        # Rows are sorted by length and start, so one search finds the run of a piece.
        shift = int(known[:, 1].max()) + int(known[:, 2].max()) + 1
        keys = known[:, 0] * shift + known[:, 1]
        for b in batches:
            if not b.num_rows:
                continue
            length = b.column(names.index("length")).to_numpy()
            number = b.column(names.index("_number")).to_numpy()
            run = known[np.searchsorted(keys, length * shift + number, side="right") - 1]
            nth = number - run[:, 1]
            kept = [(n, c) for n, c in zip(b.schema.names, b.columns) if n != "_number"]
            sequence = pa.array(run[:, 3] + nth // run[:, 4])
            offset = pa.array(run[:, 5] + nth % run[:, 4] * length)
            yield pa.RecordBatch.from_arrays(
                [c for _, c in kept] + [sequence, offset], names=[n for n, _ in kept] + ["sequence_id", "offset"]
            )

    return numbered.mapInArrow(place, schema + ", sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int, limits: Limits = Limits(), id_col: str = "doc_id",
    text_col: str = "text", with_ids: bool = True,
) -> DataFrame:
    """Tokenise, cut and pack whole documents; see ``pieces`` and ``pack``.

    Texts are tokenised once; the pieces are kept in the shared folder. An empty table gives no
    rows; columns other than the two named ones are not read.
    """
    return pack(stored(pieces(docs, tokenizer, end_id, limits.tokens, id_col, text_col, with_ids), "pieces"), limits)
