"""Packing by powers of two: no sequence holds more than one document, and none is padded.

A document is the ids of its text and an end id. Its length is written in binary: whole sequences of the
largest length first, then one piece for every bit of the rest, from the longest to the shortest.
A piece is a sequence of its own, and equal lengths share a bucket, so a training step takes its batch from
one bucket and neither pads nor attends across documents.

Sequences are numbered bucket by bucket, without gaps. Alike pieces are counted first, so copies are one
row; classes are dealt into blocks by their hash, and sums over blocks, and over groups of blocks,
give every class its first number. No task holds a bucket, and nothing but the counts of the buckets
(one for each power of two) reaches the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescout.llm.common import folds, stored
from tablescout.llm.tokens import encoder

#: Classes of pieces that are numbered in one block, and blocks whose sums are added in one group.
BLOCK_ROWS, GROUP_BLOCKS = 1024, 1024


def binary_lengths(n: int, most: int) -> list[int]:
    """``n`` as whole pieces of ``most`` and the powers of two of the rest, from the largest."""
    rest = n % most
    return [most] * (n // most) + [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]


def binary_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, tokens: int = 2048, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of every document: ``doc_id, start, length, ids_crc32, doc_tokens`` and ``ids``.

    ``tokens``, a power of two, is the longest piece. Null and empty texts are one piece with the end id.
    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit numbers. Rows of one id, or of none, stay
    documents of their own. An empty table gives no rows.
    """
    if tokens < 1 or tokens & (tokens - 1):
        raise ValueError("the longest piece must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            if not b.num_rows:
                continue
            ids, at = encode.ids(b.column(1))
            # The end ids go in behind each text's ids.
            flat = np.insert(ids.astype("<u4"), at[1:], np.uint32(end_id))
            at = at + np.arange(len(at))
            raw = memoryview(flat.tobytes())
            each = [binary_lengths(n, tokens) for n in np.diff(at).tolist()]
            length = np.array([x for e in each for x in e], dtype=np.int64)
            row = np.repeat(np.arange(len(each)), [len(e) for e in each])
            begin = np.cumsum(length) - length
            crc = [zlib.crc32(raw[4 * lo : 4 * (lo + n)]) for lo, n in zip(begin.tolist(), length.tolist())]
            arrays = [
                b.column(0).take(pa.array(row)), pa.array(begin - at[row]), pa.array(length), pa.array(crc, pa.int64()),
                pa.array(np.diff(at)[row]),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                ends = pa.array(np.append(begin, len(flat)).astype(np.int32))
                arrays.append(pa.ListArray.from_arrays(ends, pa.array(flat.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return chosen.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def number_sequences(cut: DataFrame, block_rows: int = BLOCK_ROWS, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: every piece is a sequence, so offsets are 0.

    Numbers run from 0 without gaps, the longest bucket first; within a bucket they follow from the rows
    alone, whatever the partitions. Pieces equal in all columns take consecutive numbers.
    """
    spark, columns = cut.sparkSession, cut.columns
    classes = stored(cut.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies")), "piece-classes")
    # One row for each power of two.
    buckets = classes.groupBy("length").agg(F.sum("_copies").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    starts, at = [], 0
    for r in sorted(buckets, key=lambda r: -r["length"]):
        starts.append((r["length"], at, folds(r["rows"], block_rows)))
        at += r["n"]
    bounds = spark.createDataFrame(starts, "length long, _first long, _blocks int")
    block = F.pmod(F.xxhash64(*[c for c in columns if c != "ids"]), F.col("_blocks")).cast("int")
    dealt = classes.join(F.broadcast(bounds), "length").withColumn("_block", block)
    dealt = dealt.withColumn("_group", F.floor(F.col("_block") / group_blocks).cast("int"))
    upto = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("length", "_group", "_block").agg(F.sum("_copies").alias("_n"))
    groups = sums.groupBy("length", "_group").agg(F.sum("_n").alias("_n")).select(
        "length", "_group", F.coalesce(F.sum("_n").over(upto("length").orderBy("_group")), F.lit(0)).alias("_of_group")
    )
    blocks = sums.withColumn(
        "_of_block", F.coalesce(F.sum("_n").over(upto("length", "_group").orderBy("_block")), F.lit(0))
    ).drop("_n").join(groups, ["length", "_group"]).drop("_group")
    order = ["doc_id", "start", "ids_crc32", *[c for c in columns if c not in ("doc_id", "start", "ids_crc32", "length")]]
    within = upto("length", "_block").orderBy(*order)
    placed = dealt.withColumn("_within", F.coalesce(F.sum("_copies").over(within), F.lit(0)))
    placed = placed.join(blocks, ["length", "_block"])
    first = F.col("_first") + F.col("_of_group") + F.col("_of_block") + F.col("_within")
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1))
    return placed.select(*columns, first.alias("_start"), copy.alias("_copy")).select(
        *columns, (F.col("_start") + F.col("_copy")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )


def pack_binary(
    docs: DataFrame, tokenizer: str, end_id: int, tokens: int = 2048, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Sequences of whole documents by powers of two; see ``binary_pieces`` and ``number_sequences``.

    Columns other than the two named ones are not read. A bucket is the rows of one ``length``.
    """
    return number_sequences(stored(binary_pieces(docs, tokenizer, end_id, tokens, id_col, text_col, with_ids), "pieces"))
