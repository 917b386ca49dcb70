"""Greedy packing of text blocks into batches of bounded length.

The packing of a group is a fold over its blocks in order, yet a block only matters through
its length, and what a run of blocks does to an open batch depends on one number (the
length so far) in a few steps. So the fold is a parallel scan over short tables:

1. Pieces of consecutive positions, in parallel: each gives a table of how an open batch leaves
   the piece. It has about as many entries as blocks fit in one batch.
2. Tables of neighbours compose to one table of the same kind and size. Up a tree, ``FAN``
   neighbours at a time become one; down again, the state at the start of every node gives that
   of its children. So a group with n pieces takes log n steps, and no task holds more than
   ``FAN`` tables of it.
3. Pieces again, in parallel: every block gets its batch number.

A group of any size is thus spread over all tasks, and lengths, not texts, are shuffled.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescout.functions import constants as K
from tablescout.sources.lineage import cut_lineage

GAP = 2  # characters between two blocks
FAN = 64  # tables that compose to one


def is_block(block: Column, header: str = K.CARD_HEADER) -> Column:
    """Only blocks that start with the card header are packed."""
    return block.rlike(rf"(?U)^\s*{header.strip()}")


def _starts(ends: np.ndarray, cap: int, least: int) -> np.ndarray:
    """Start of the next batch for a batch that starts at each block (n = still open)."""
    n = len(ends) - 1
    s = np.arange(n)
    stop = np.maximum(np.searchsorted(ends, ends[:-1] + cap + GAP, side="right") - 1, s + 1)
    closes = stop < n
    return np.where(closes, np.where(stop - s >= least, stop, stop + 1), n + 1)


class Passage(NamedTuple):
    """How a run of blocks passes an open batch on, by the block where the first new batch begins.

    ``head`` has the ends of the first blocks up to the first one that no batch can hold. Batches closed
    behind the entry and the open batch's blocks and characters at the end are by that block.
    """

    n: int
    total: int
    head: np.ndarray
    closed: np.ndarray
    count: np.ndarray
    length: np.ndarray

    def enter(self, count: np.ndarray, length: np.ndarray, cap: int, least: int) -> np.ndarray:
        """Start of the first new batch for open batches that enter; n + 1 where one stays open."""
        stop = np.maximum(np.searchsorted(self.head, cap - length, side="right") - 1, 0)
        closes = np.where(count + stop >= least, stop, stop + 1)
        return np.where(count == 0, 0, np.where(stop >= self.n, self.n + 1, closes))

    def leave(self, count: np.ndarray, length: np.ndarray, cap: int, least: int) -> tuple[np.ndarray, ...]:
        """Batches closed, and the open batch behind the run, for open batches that enter."""
        at = self.enter(count, length, cap, least)
        stays = at > self.n
        at = np.where(stays, 0, at)
        return (
            np.where(stays, 0, self.closed[at] + (count > 0)), np.where(stays, count + self.n, self.count[at]),
            np.where(stays, length + self.total, self.length[at]),
        )

    def then(self, after: Passage, cap: int, least: int) -> Passage:
        """This run and the one behind it as one."""
        more, count, length = after.leave(self.count, self.length, cap, least)
        columns = [self.closed + more, count, length]
        head = self.head
        if len(head) == self.n + 1:
            # A batch may pass all of this run, so the next one's blocks are entries too.
            head = np.append(head, self.total + after.head[1:])
            columns = [np.append(x[: self.n], y) for x, y in zip(columns, (after.closed, after.count, after.length))]
        last = min(int(np.searchsorted(head, cap, side="right")), len(head) - 1)
        return Passage(
            self.n + after.n, self.total + after.total, head[: last + 1], *(x[: last + 1] for x in columns)
        )


_PASSAGE = "n long, total long, head array<long>, closed array<long>, count array<long>, length array<long>"


def _passages(pdf: pd.DataFrame) -> list[Passage]:
    columns = [pdf[c] for c in Passage._fields]
    return [Passage(int(n), int(t), *(np.asarray(x, dtype=np.int64) for x in rest)) for n, t, *rest in zip(*columns)]


def _ends(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths.astype(np.int64) + GAP)])


def _summary(cap: int, least: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ends = _ends(pdf.sort_values("pos")["chars"].to_numpy())
        n = len(ends) - 1
        nxt = _starts(ends, cap, least)
        closed = np.zeros(n + 1, dtype=np.int64)
        count = np.zeros(n + 1, dtype=np.int64)
        length = np.zeros(n + 1, dtype=np.int64)
        for s in range(n - 1, -1, -1):
            t = nxt[s]
            if t > n:
                count[s], length[s] = n - s, ends[n] - ends[s] - GAP
            else:
                closed[s], count[s], length[s] = closed[t] + 1, count[t], length[t]
        top = min(int(np.searchsorted(ends, cap, side="right")), n) + 1
        return _frame(pdf, "piece", Passage(n, int(ends[n]), ends[:top], closed[:top], count[:top], length[:top]))

    return run


def _frame(pdf: pd.DataFrame, node: str, passage: Passage) -> pd.DataFrame:
    lists = {c: [x.tolist()] for c, x in passage._asdict().items() if c not in ("n", "total")}
    return pd.DataFrame({
        "g": pdf["g"].iloc[:1].to_numpy(), "node": pdf[node].iloc[:1].to_numpy(), "n": [passage.n],
        "total": [passage.total], **lists,
    })


def _compose(cap: int, least: int):
    """The tables of the neighbours below a node as one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        first, *rest = _passages(pdf)
        for passage in rest:
            first = first.then(passage, cap, least)
        return _frame(pdf, "parent", first)

    return run


_ENTRY = "node long, in_count long, in_length long, in_batch long"


def _descend(cap: int, least: int):
    """The state at the start of every child, from the state at the start of the node."""

    def run(children: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        children = children.sort_values("node")
        count, length, batch = (np.int64(entry[c].iloc[0]) for c in ("in_count", "in_length", "in_batch"))
        rows = []
        for node, passage in zip(children["node"], _passages(children)):
            rows.append((node, count, length, batch))
            closed, count, length = (x[()] for x in passage.leave(count, length, cap, least))
            batch = batch + closed
        out = pd.DataFrame(rows, columns=["node", "in_count", "in_length", "in_batch"])
        out.insert(0, "g", children["g"].to_numpy())
        return out

    return run


def _assign(cap: int, least: int):
    def run(blocks: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("pos")
        ends = _ends(blocks["chars"].to_numpy())
        n = len(ends) - 1
        e = entry.iloc[0]
        count, batch = int(e["in_count"]), int(e["in_batch"])
        whole = Passage(n, int(ends[n]), ends, *([np.empty(0)] * 3))
        s = int(whole.enter(np.int64(count), np.int64(e["in_length"]), cap, least))
        number = np.full(n, batch, dtype=np.int64)
        if count:
            batch += 1
        nxt = _starts(ends, cap, least)
        while s < n:
            t = min(int(nxt[s]), n)
            number[s:t] = batch
            batch += 1
            s = t if nxt[s] <= n else n
        return pd.DataFrame({"g": blocks["g"], "pos": blocks["pos"], "chars": blocks["chars"], "batch_no": number})

    return run


def pack_blocks(
    blocks: DataFrame,
    group: str,
    pos: str,
    block: str,
    max_chars: int = K.MAX_BATCH_CHARS,
    least: int = K.MIN_BLOCKS_PER_BATCH,
    piece_rows: int = 4096,
    fan: int = FAN,
) -> DataFrame:
    """Batch number (from 0) of each block: ``group, pos, chars, batch_no``.

    ``pos`` is a unique integer order inside the group. A batch holds at most ``max_chars``
    characters with two between blocks. When a block does not fit and the batch has fewer
    than ``least`` blocks, the block is added anyway and the batch is closed. Blocks without a
    header are not packed; ``headerless_parts`` takes the groups that have no other.
    """
    gtype = blocks.schema[group].dataType.simpleString()
    lengths = blocks.where(is_block(F.col(block))).select(
        F.col(group).alias("g"),
        F.col(pos).cast("long").alias("pos"),
        F.char_length(block).cast("long").alias("chars"),
        F.floor(F.col(pos) / piece_rows).cast("long").alias("piece"),
    )
    # The lengths and the tables are small and read several times, so they are written once.
    lengths = cut_lineage(lengths)
    span = lengths.agg(F.min("piece").alias("least"), F.max("piece").alias("most")).first()
    first, width = span["least"] or 0, (span["most"] or 0) - (span["least"] or 0) + 1
    nodes = lengths.groupBy("g", "piece").applyInPandas(_summary(max_chars, least), f"g {gtype}, node long, {_PASSAGE}")
    nodes = nodes.withColumn("node", F.col("node") - first)
    parent = F.floor(F.col("node") / fan).cast("long")
    levels = [cut_lineage(nodes.withColumn("parent", parent))]
    while width > fan:
        above = levels[-1].groupBy("g", "parent").applyInPandas(_compose(max_chars, least), f"g {gtype}, node long, {_PASSAGE}")
        levels.append(cut_lineage(above.withColumn("parent", parent)))
        width = -(-width // fan)
    # No batch is open before the first node.
    zero = F.lit(0).cast("long")
    entries = levels[-1].select("g", F.col("parent").alias("node")).distinct().select(
        "g", "node", zero.alias("in_count"), zero.alias("in_length"), zero.alias("in_batch")
    )
    for level in reversed(levels):
        entries = level.groupBy("g", "parent").cogroup(entries.groupBy("g", "node")).applyInPandas(
            _descend(max_chars, least), f"g {gtype}, {_ENTRY}"
        )
    out = (
        lengths.withColumn("node", F.col("piece") - first).groupBy("g", "node")
        .cogroup(entries.groupBy("g", "node"))
        .applyInPandas(_assign(max_chars, least), f"g {gtype}, pos long, chars long, batch_no long")
    )
    return out.select(F.col("g").alias(group), F.col("pos").alias(pos), "chars", "batch_no")


def headerless_parts(
    blocks: DataFrame, group: str, pos: str, block: str, max_chars: int = K.MAX_BATCH_CHARS, piece_rows: int = 4096
) -> DataFrame:
    """Groups without any headed block, cut by length: ``group, batch_no, pos, fragment``.

    The blocks of such a group, two line ends between them, are one text that is cut every
    ``max_chars`` characters; a block that lies across a cut gives a fragment to each side. Places
    are sums over pieces of ``piece_rows`` positions and within them, so no task holds a group. Null
    blocks count as empty.
    """
    text = F.coalesce(F.col(block), F.lit(""))
    plain = blocks.groupBy(F.col(group).alias("_g")).agg(
        F.max(F.coalesce(is_block(F.col(block)), F.lit(False))).alias("_headed"), F.max(pos).alias("_last")
    ).where("NOT _headed")
    rows = blocks.join(plain, blocks[group].eqNullSafe(F.col("_g"))).select(
        F.col(group), F.col(pos).cast("long").alias("_pos"), F.floor(F.col(pos) / piece_rows).cast("long").alias("_piece"),
        F.when(F.col(pos) < F.col("_last"), F.concat(text, F.lit("\n" * GAP))).otherwise(text).alias("_text"),
    )
    size = F.char_length("_text").cast("long")
    sums = rows.groupBy(F.col(group).alias("_g"), "_piece").agg(F.sum(size).alias("_n"))
    earlier = Window.partitionBy("_g").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n").withColumnRenamed("_piece", "_p")
    within = Window.partitionBy(group, "_piece").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_in", F.coalesce(F.sum(size).over(within), F.lit(0))).join(
        starts, rows[group].eqNullSafe(F.col("_g")) & (F.col("_piece") == F.col("_p"))
    ).withColumn("_start", F.col("_before") + F.col("_in")).withColumn("_end", F.col("_start") + size)
    cut = placed.where("_end > _start").withColumn(
        "batch_no", F.explode(F.sequence(F.floor(F.col("_start") / max_chars), F.floor((F.col("_end") - 1) / max_chars)))
    )
    lo = F.greatest(F.col("batch_no") * max_chars, F.col("_start"))
    hi = F.least((F.col("batch_no") + 1) * max_chars, F.col("_end"))
    fragment = F.substring("_text", (lo - F.col("_start") + 1).cast("int"), (hi - lo).cast("int"))
    return cut.select(group, "batch_no", F.col("_pos").alias(pos), fragment.alias("fragment"))


def headerless_texts(parts: DataFrame, group: str, pos: str) -> DataFrame:
    """Text of every batch of ``headerless_parts``; its length is bounded by the cuts."""
    return parts.groupBy(group, "batch_no").agg(
        F.expr(f"listagg(fragment, '') within group (order by `{pos}`)").alias("batch_text")
    )


def batch_sizes(packed: DataFrame, group: str) -> DataFrame:
    """Blocks and characters of every batch."""
    return packed.groupBy(group, "batch_no").agg(
        F.count(F.lit(1)).alias("blocks"),
        (F.sum("chars") + GAP * (F.count(F.lit(1)) - 1)).alias("batch_chars"),
    )


def batch_texts(blocks: DataFrame, packed: DataFrame, group: str, pos: str, block: str) -> DataFrame:
    """Text of every batch; its length is bounded by the packing."""
    joined = blocks.join(packed, [group, pos])
    return joined.groupBy(group, "batch_no").agg(
        F.expr(f"listagg(`{block}`, '\n\n') within group (order by `{pos}`)").alias("batch_text")
    )


def merge_batches(batches: DataFrame, group: str, target: int = K.MAX_BATCHES) -> DataFrame:
    """Merge the batches of a group down to ``target``: floor size, the rest to the last.

    A merged batch may be of any size, so the result is the mapping ``batch_no -> merged_no``;
    the batch rows stay whole.
    """
    counts = batches.groupBy(group).agg((F.max("batch_no") + 1).alias("_n"))
    size = F.floor(F.col("_n") / target)
    merged = F.when(
        F.col("_n") > target, F.least(F.floor(F.col("batch_no") / size), F.lit(target - 1))
    ).otherwise(F.col("batch_no"))
    return batches.join(counts, group).withColumn("merged_no", merged.cast("long")).drop("_n")


def split_by_length(texts: DataFrame, keep: list[str], text: str, max_chars: int = K.MAX_BATCH_CHARS) -> DataFrame:
    """Consecutive parts of a text without card headers."""
    return texts.where(F.char_length(text) > 0).select(
        *keep, F.posexplode(_pieces(F.col(text), max_chars)).alias("batch_no", "part")
    )


def chunk_text(
    texts: DataFrame,
    keep: list[str],
    text: str,
    size: int = K.CHUNK_CHARS,
    overlap: int = K.CHUNK_OVERLAP,
) -> DataFrame:
    """Overlapping chunks of whole texts: ``keep, chunk_no, chunk``.

    A chunk is one piece of ``size - overlap`` characters and the head of the next piece, so the
    work grows with the length of the text.
    """
    step = size - overlap
    if overlap > step:
        raise ValueError("the overlap may be at most half of the chunk")
    pieces = texts.where(F.char_length(text) > 0).select(*keep, _pieces(F.col(text), step).alias("_pieces"))
    chunks = F.transform(
        "_pieces",
        lambda p, i: F.concat(p, F.coalesce(F.left(F.get("_pieces", i + 1), F.lit(overlap)), F.lit(""))),
    )
    return pieces.select(*keep, F.posexplode(chunks).alias("chunk_no", "chunk"))


def _pieces(text: Column, size: int) -> Column:
    """Consecutive pieces of ``size`` characters, in one scan of the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))
