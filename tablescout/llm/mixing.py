"""Mixing sources to target weights by balanced sampling with the cube method.

Every source gets a target number of words by its weight; no target is more than three times its
source. A document is taken ``floor(target / size of source)`` times, and once more with the
remaining fraction as its inclusion probability. The extra copies are drawn by the cube method: the
probabilities of the open documents of a source move along a direction that leaves the sums of
words and of documents as they are, until one of them reaches 0 or 1. Three open documents always
have such a direction for the two sums, so a walk needs only three of them in memory and leaves
at most two open.

The walks run in groups of bounded size, (source, block of the id's hash). What each group leaves
open is walked again in fewer groups, until a source has one group; the last few documents of a
source, at most 14, are rounded together so that the sums come nearest to those expected. Rows are never collected by key
in one task: a source of any size is spread over its blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescout.llm.common import folds, fresh, stored

#: Words as the contract counts them.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Documents of one walk; a walk leaves at most two of them open.
BLOCK_ROWS = 1024
#: Documents of a source that skip its last walk, so that the landing has choices.
LANDING = 12
_EDGE = 1e-9


def words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple], weights=WEIGHTS, most: float = 3.0, share: float = 1.0) -> dict:
    """Target per source from ``(source, size)`` rows: one small number per source.

    Weights repeat over the sources by code point, null last. Sources stop at ``most`` times their
    size, and what they leave goes to the others by weight until none is above.
    """
    order = sorted(sizes, key=lambda r: (r[0] is None, r[0] or ""))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, open_, out = share * sum(size.values()), [s for s, _ in order], {}
    while open_:
        total = math.fsum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * size[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        out |= {s: most * size[s] for s in full}
        left -= math.fsum(most * size[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return {s: out.get(s, 0.0) for s, _ in order}


def _walk(state: list, size: float, p: float, row: int, draw: np.random.Generator, done: list) -> None:
    """Add one open document to a walk and move until at most two are open."""
    state.append([size, p, row])
    while len(state) > 2:
        (a, pa_, _), (b, pb, _), (c, pc, _) = state
        # The direction that keeps the documents (sum u) and the words (sum size * u).
        u = (b - c, c - a, a - b)
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up, down = math.inf, math.inf
        for x, d in zip((pa_, pb, pc), u):
            if d > 0:
                up, down = min(up, (1.0 - x) / d), min(down, x / d)
            elif d < 0:
                up, down = min(up, -x / d), min(down, (x - 1.0) / d)
        # The mean of the move is zero, so every document keeps its probability.
        step = up if draw.random() * (up + down) < down else -down
        for s, d in zip(state, u):
            s[1] += step * d
        rest = []
        for s in state:
            if s[1] <= _EDGE or s[1] >= 1.0 - _EDGE:
                done.append((s[2], 1 if s[1] > 0.5 else 0))
            else:
                rest.append(s)
        state[:] = rest


def _land(state: list, done: list) -> None:
    """Round the last open documents of a source to the sums nearest to those expected.

    At most ``LANDING + 2`` documents, so every choice can be tried.
    """
    if not state:
        return
    size, p = np.array([s[0] for s in state]), np.array([s[1] for s in state])
    choice = (np.arange(1 << len(state))[:, None] >> np.arange(len(state))) & 1
    off = np.abs(choice @ size - p @ size) + np.abs(choice.sum(axis=1) - p.sum())
    best = choice[np.argmin(off)]
    done.extend((s[2], int(taken)) for s, taken in zip(state, best))


def _walks(seed: int):
    """Task function over rows sorted by group: the group's columns, size, chance and a key.

    A source that is down to one block lands in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # ``kept`` has the rows of the open documents, three and the saved ones at most.
        group, state, kept, draw, n, last = None, [], {}, None, 0, False
        saved: list = []  # the first documents of a last walk wait for the landing

        def flush(done: list, out: list) -> None:
            for row, taken in done:
                out.append(kept.pop(row) + (float(taken), True))

        def close(out: list) -> None:
            done: list = []
            if last:
                _land(state + saved, done)
                saved.clear()
                flush(done, out)
            else:
                out.extend(kept.pop(s[2])[:-1] + (s[1], s[1], False) for s in state)
            state.clear()

        for b in batches:
            out: list = []
            for g, blk, key, tie, size, blocks, p in zip(*(c.to_pylist() for c in b.columns)):
                if (g, blk) != group:
                    close(out)
                    group, last, draw = (g, blk), blocks == 1, np.random.default_rng([seed, g & 0x7FFFFFFF, blk])
                n += 1
                kept[n] = (g, key, tie, size, blocks, p)
                done: list = []
                if p <= _EDGE or p >= 1.0 - _EDGE:
                    done.append((n, 1 if p > 0.5 else 0))
                elif last and len(saved) < LANDING:
                    saved.append([float(size), p, n])
                else:
                    _walk(state, float(size), p, n, draw, done)
                flush(done, out)
            if out:
                yield _rows(out)
        out = []
        close(out)
        if out:
            yield _rows(out)

    return run


_OPEN = "g int, key long, tie int, size long, blocks int, p double, p2 double, fixed boolean"


def _rows(out: list) -> pa.RecordBatch:
    g, key, tie, size, blocks, p, p2, fixed = zip(*out)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(g, pa.int32()), pa.array(key, pa.int64()), pa.array(tie, pa.int32()), pa.array(size, pa.int64()),
            pa.array(blocks, pa.int32()), pa.array(p, pa.float64()), pa.array(p2, pa.float64()), pa.array(fixed, pa.bool_()),
        ],
        names=["g", "key", "tie", "size", "blocks", "p", "p2", "fixed"],
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    most: float = 3.0,
    share: float = 1.0,
    block_rows: int = BLOCK_ROWS,
    seed: int = 11,
) -> DataFrame:
    """One row per document: ``doc_id, source, text_hash, size, source_size, target, copies, taken``.

    ``copies`` is how often the mix takes the document, ``taken`` its words times that. The draw
    depends on the ids, texts and the seed only, so reruns agree however rows are split, and every source
    lands with the same number of open documents whatever the sizes of the others.

    Null texts have no words and are taken 0 times. A null source is a source of its own, last in
    the order. Rows with the same id are separate documents; those alike in id, source and text
    are numbered and interchangeable. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"),
        F.xxhash64(text_col).alias("text_hash"),
    )
    sized = stored(rows, "mix-sizes")
    # One row per source comes to the driver; sources are names of data sets, not keys of rows.
    per_source = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    goal = targets([(r["source"], r["n"]) for r in per_source], weights, most, share)
    order = sorted(per_source, key=lambda r: (r["source"] is None, r["source"] or ""))
    spark = docs.sparkSession
    # An Arrow table is read by the JVM alone; a list would start Python workers of another kind, which stay.
    plan = spark.createDataFrame(
        pa.table(
            {
                "g": pa.array(range(len(order)), pa.int32()),
                "source": pa.array([r["source"] for r in order], pa.string()),
                "source_size": pa.array([int(r["n"]) for r in order], pa.int64()),
                "target": pa.array([float(goal[r["source"]]) for r in order], pa.float64()),
                "blocks": pa.array([folds(r["rows"], block_rows) for r in order], pa.int32()),
                "rate": pa.array([goal[r["source"]] / r["n"] if r["n"] else 0.0 for r in order], pa.float64()),
            }
        )
    )
    # One row per source, so this side is small by its nature.
    placed = sized.join(F.broadcast(plan), sized["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    base = F.floor(F.col("rate") + F.lit(_EDGE)).cast("long")
    chance = F.greatest(F.col("rate") - base, F.lit(0.0))
    keyed = placed.select(
        "id", "source", "text_hash", "g", "size", "source_size", "target", "blocks", base.alias("base"),
        F.when(F.col("size") > 0, chance).otherwise(F.lit(0.0)).alias("p"),
        # Rows of one key are alike in all that matters here.
        F.xxhash64("id", "g", "size", "text_hash").alias("key"),
    )
    alike = Window.partitionBy("g", "key", "size").orderBy("text_hash")
    # Documents without words are never taken and need no number, however many share an id.
    keyed = stored(
        keyed.where("size > 0").withColumn("tie", F.row_number().over(alike).cast("int"))
        .unionByName(keyed.where("size = 0").withColumn("tie", F.lit(0))),
        "mix-keys",
    )
    open_rows = keyed.where((F.col("p") > _EDGE)).select(
        "g", F.pmod("key", F.col("blocks")).cast("int").alias("blk"), "key", "tie", "size", "blocks", "p"
    )
    picked, level = None, 0
    blocks = max([1, *(folds(r["rows"], block_rows) for r in per_source)])
    while True:
        tasks = max(1, min(4 * blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        walked = (
            open_rows.repartition(tasks, "g", "blk")
            .sortWithinPartitions("g", "blk", "key", "tie")
            .mapInArrow(_walks(seed + level), _OPEN)
        )
        walked = stored(walked, f"mix-walk{level}")
        fixed = walked.where("fixed and p2 > 0.5").select("g", "key", "tie", "size")
        picked = fixed if picked is None else picked.unionByName(fixed)
        if blocks == 1:
            break
        # The largest source goes on longest; each has as many blocks as its own open documents need.
        blocks, level = folds(2 * blocks, block_rows), level + 1
        fewer = F.ceil(2 * F.col("blocks") / F.lit(block_rows)).cast("int")
        open_rows = walked.where(~F.col("fixed")).withColumn("blocks", fewer).select(
            "g", F.pmod(F.xxhash64("key", F.lit(level)), F.col("blocks")).cast("int").alias("blk"), "key", "tie", "size",
            "blocks", F.col("p2").alias("p"),
        )
    extra = picked.withColumn("extra", F.lit(1))
    copies = F.when(F.col("size") > 0, F.col("base") + F.coalesce("extra", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return keyed.join(extra, ["g", "key", "tie", "size"], "left").select(
        F.col("id").alias("doc_id"), "source", "text_hash", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """The documents of the mix: a document that is taken n times comes as n rows, others go."""
    copies = mix(docs, id_col, text_col, source_col, **options)
    key, size, nth, total, alike_n, each = fresh(
        docs, "_mix_key", "_mix_size", "_mix_nth", "_mix_total", "_mix_alike", "_mix_each"
    )
    # Documents alike in id, source and text are numbered on both sides and paired by the number.
    alike = Window.partitionBy(key, size).orderBy(F.xxhash64(*docs.columns))
    mine = docs.withColumn(size, words(F.col(text_col))).where(F.col(size) > 0).withColumn(
        key, F.xxhash64(F.col(id_col), F.col(source_col).cast("string"), F.xxhash64(text_col))
    )
    theirs = (
        copies.where("size > 0")
        .select(F.xxhash64("doc_id", "source", "text_hash").alias(key), F.col("size").alias(size), "copies")
        .groupBy(key, size).agg(F.sum("copies").alias(total), F.count(F.lit(1)).alias(alike_n))
    )
    numbered = mine.withColumn(nth, F.row_number().over(alike))
    times = F.floor(F.col(total) / F.col(alike_n)) + F.when(F.col(nth) <= F.col(total) % F.col(alike_n), 1).otherwise(0)
    out = numbered.join(theirs, [key, size]).withColumn(
        each, F.explode(F.array_repeat(F.lit(1), times.cast("int")))
    )
    return out.select(*docs.columns)
