"""Approximate nearest neighbours by cosine with an inverted multi-index.

Vectors of length 1 are split in two halves, and each half is quantised by its own centroids. A cell
is a pair of centroids, so ``K`` centroids per half give ``K * K`` cells. A query walks the cells by
the sum of its two distances: a heap starts at the nearest pair and each step adds the next pairs in
either half. It stops when the cells walked hold the wanted share of all vectors; the vectors in them
are ranked again by exact cosine in double precision.

The share is measured, not fixed: vectors of the sample ask the sample, and the share that holds the wanted
part of their true neighbours is taken (``RECALL``). Vectors without clusters need a larger share.

Neighbouring cells are put together into blocks of bounded size, and a crowded cell is split into several.
A query goes to the blocks of its cells with a list of these cells, is compared with their vectors only, and
returns its best few of each block, so a task holds one block and one block of queries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescout.llm.common import empty_frame, folds, stored

#: Vectors that the centroids are fitted on, taken by the hash of their ids; every vector is indexed.
FITTED = 8192
#: Vectors per cell that the number of centroids aims at.
CELL_ROWS = 512
#: Fewest and most centroids per half.
LEAST_CENTROIDS, MOST_CENTROIDS = 128, 256
#: Part of the true nearest that the share is chosen to hold, the nearest it looks at, and the vectors that ask.
RECALL, RECALL_AT, PROBES = 0.95, 5, 256
#: Vectors and queries of one task.
BLOCK_ROWS, QUERY_ROWS = 4096, 4096
ROUNDS = 8


def finite_vector(v: Column) -> Column:
    """A vector that takes part: not null, no null or non-finite component, not zero."""
    ok = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(ok & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as doubles; lists must have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not len(column) or len(flat) % len(column) or len(set(np.diff(column.offsets.to_numpy()).tolist())) > 1:
        if len(column):
            raise ValueError("vectors differ in length")
        return flat.reshape(0, 1)
    return flat.reshape(len(column), -1)


def unit_rows(m: np.ndarray) -> np.ndarray:
    # Scaled first, so that very large or small components neither overflow nor vanish.
    m = m / np.maximum(np.abs(m).max(axis=1, keepdims=True), np.finfo(float).tiny)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def vectors_of(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows ``id, v`` that take part; vectors keep their type, so that floats travel as floats."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(
        finite_vector(F.col("v"))
    )


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def sample_of(rows: DataFrame, bound: int = FITTED) -> np.ndarray:
    """At most ``bound`` vectors of length 1, those with the least hashes of their ids."""
    got = rows.orderBy(F.xxhash64("id"), "id").limit(bound).toArrow()
    return unit_rows(matrix(got.column("v"))) if got.num_rows else np.empty((0, 1))


def centroids(points: np.ndarray, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """Plain k-means of a bounded sample; empty centroids stay where they are."""
    rng = np.random.default_rng(seed)
    centre = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(points, centre)
        for c in range(len(centre)):
            own = points[near == c]
            if len(own):
                centre[c] = own.mean(axis=0)
    return centre


def distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    d = (points * points).sum(axis=1)[:, None] + (centre * centre).sum(axis=1)[None, :] - 2.0 * points @ centre.T
    return np.maximum(d, 0.0)


def nearest(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return distances(points, centre).argmin(axis=1)


def walk(first: np.ndarray, second: np.ndarray, rows: list[int], wanted: int) -> list[int]:
    """Cells by falling nearness until they hold ``wanted`` vectors; empty ones are left out.

    ``first`` and ``second`` are the distances to the centroids of the halves, ``rows`` the vectors per
    cell, by ``i * len(second) + j``. The next of a row of pairs enters the heap when its last one leaves, and
    a new row when the first of the row before leaves, so each pair enters once.
    """
    order, other = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    # Plain numbers, as the loop takes one at a time.
    x, y, base, col = first[order].tolist(), second[other].tolist(), (order * len(second)).tolist(), other.tolist()
    heap, out, held = [(x[0] + y[0], 0, 0)], [], 0
    while heap and held < wanted:
        _, i, j = heap[0]
        cell = base[i] + col[j]
        if rows[cell]:
            out.append(cell)
            held += rows[cell]
        if j + 1 < len(y):
            heapq.heapreplace(heap, (x[i] + y[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if not j and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return out


def share_for(sample: np.ndarray, first: np.ndarray, second: np.ndarray, recall: float = RECALL, k: int = RECALL_AT) -> float:
    """Share of the vectors that the walk must cover to hold ``recall`` of the k nearest in the sample.

    A neighbour is held once its cell is reached, so its place is the share of vectors in cells no further
    than its own. The sample is sparser than the table, so its neighbours lie further away, if anything.
    """
    half, n = first.shape[1], len(sample)
    a, b = nearest(sample[:, :half], first), nearest(sample[:, half:], second)
    places = []
    for i in range(min(PROBES, n)):
        near = sample @ sample[i]
        near[i] = -np.inf
        top = np.argsort(-near, kind="stable")[: min(k, n - 1)]
        one = sample[i : i + 1]
        away = distances(one[:, :half], first)[0][a] + distances(one[:, half:], second)[0][b]
        places.extend(np.searchsorted(np.sort(away), away[top], side="right") / n)
    return float(np.quantile(places, recall, method="higher")) if places else 1.0


def blocks_of(rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of every cell: small cells share one, crowded ones have several."""
    low, count = np.zeros(len(rows), dtype=np.int32), np.ones(len(rows), dtype=np.int32)
    block = held = 0
    for c, n in enumerate(rows.tolist()):
        if held and held + n > most:
            block, held = block + 1, 0
        low[c], count[c] = block, max(1, -(-n // most))
        if count[c] > 1:
            block, held = block + int(count[c]), 0
        else:
            held += n
    return low, count


class MultiIndex:
    """An index over the vectors of a table, and its search."""

    def __init__(self, df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cell_rows: int = CELL_ROWS):
        self.spark = df.sparkSession
        rows = vectors_of(df, id_col, vector_col)
        sample = sample_of(rows)
        self.n = rows.count()
        if not self.n:
            return
        k = int(min(MOST_CENTROIDS, max(LEAST_CENTROIDS, round((self.n / cell_rows) ** 0.5)), len(sample)))
        half = max(1, sample.shape[1] // 2)
        # Two centroid tables of at most 256 rows travel with the tasks.
        self.first, self.second = centroids(sample[:, :half], k, 1), centroids(sample[:, half:], k, 2)
        first, second, half_ = self.first, self.second, half
        self.half = half
        #: Share of the vectors that a search covers.
        self.share = share_for(sample, self.first, self.second)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    m = unit_rows(matrix(b.column(1)))
                    cell = nearest(m[:, :half_], first) * len(second) + nearest(m[:, half_:], second)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0), b.column(1), pa.array(cell.astype(np.int32))], names=["id", "v", "cell"]
                    )

        placed = rows.mapInArrow(assign, f"id long, v {type_of(rows, 'v')}, cell int")
        placed = stored(placed, "multi-index")
        # At most 256 * 256 cells, on the driver and in the broadcast.
        sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        self.rows = np.zeros(len(first) * len(second), dtype=np.int64)
        for r in sizes.collect():
            self.rows[r["cell"]] = r["n"]
        self.low, self.count = blocks_of(self.rows, BLOCK_ROWS)
        used = np.flatnonzero(self.rows)
        places = self.spark.createDataFrame(
            [(int(c), int(self.low[c]), int(self.count[c])) for c in used], "cell int, low int, count int"
        )
        block = (F.col("low") + F.pmod(F.xxhash64("id", "v"), F.col("count"))).cast("int")
        self.placed = placed.join(F.broadcast(places), "cell").select("id", "v", "cell", block.alias("block"))

    def walked(
        self, queries: DataFrame, k: int = 5, share: float | None = None, id_col: str = "vec_id",
        vector_col: str = "embedding",
    ) -> DataFrame:
        """``query_id, compared``: how many vectors a search compares with every query."""
        schema = "query_id long, compared long"
        if not self.n:
            return empty_frame(self.spark, schema)
        first, second, rows, half = self.first, self.second, self.rows, self.half
        wanted, held = self._wanted(k, share), rows.tolist()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    m = unit_rows(matrix(b.column(1)))
                    d1, d2 = distances(m[:, :half], first), distances(m[:, half:], second)
                    seen = [int(rows[walk(x, y, held, wanted)].sum()) for x, y in zip(d1, d2)]
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(seen, pa.int64())], names=["query_id", "compared"])

        return vectors_of(queries, id_col, vector_col).mapInArrow(run, schema)

    def _wanted(self, k: int, share: float | None) -> int:
        # One more than k, as the query itself may be among them.
        return max(int(np.ceil((self.share if share is None else share) * self.n)), min(self.n, k + 1))

    def search(
        self, queries: DataFrame, k: int = 5, share: float | None = None, id_col: str = "vec_id",
        vector_col: str = "embedding",
    ) -> DataFrame:
        """``query_id, rank, vec_id, score``: the k nearest found of every query, other than itself.

        ``share`` is the part of all vectors that the walk covers, by default the index's own. It is chosen for
        few neighbours (``RECALL_AT``); give a larger one for a much larger k.
        Equal cosines go by the smaller id. Vectors that are null, zero or hold a null or non-finite
        component take no part on either side. Rows of one id are one query each, but a query never
        finds its own id. Empty tables give no rows.
        """
        schema = "query_id long, rank int, vec_id long, score double"
        if not self.n:
            return empty_frame(self.spark, schema)
        first, second, rows, half = self.first, self.second, self.rows.tolist(), self.half
        low, count, wanted = self.low, self.count, self._wanted(k, share)

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                # A query repeats for each of its blocks, so few go out at a time.
                for at in range(0, b.num_rows, 64):
                    yield routed_to(b.slice(at, 64))

        def routed_to(b: pa.RecordBatch) -> pa.RecordBatch:
            m = unit_rows(matrix(b.column(1)))
            d1, d2 = distances(m[:, :half], first), distances(m[:, half:], second)
            who, blocks, lists = [], [], []
            for q, (x, y) in enumerate(zip(d1, d2)):
                cells = np.array(walk(x, y, rows, wanted), dtype=np.int32)
                own = np.repeat(cells, count[cells])
                nth = np.arange(len(own)) - np.repeat(np.cumsum(count[cells]) - count[cells], count[cells])
                block = low[own] + nth
                order = np.lexsort((own, block))
                block, own = block[order], own[order]
                begin = np.flatnonzero(np.diff(block, prepend=-1))
                who.extend([q] * len(begin))
                blocks.extend(block[begin].tolist())
                lists.extend(np.split(own, begin[1:]))
            at = pa.array(who, pa.int32())
            sizes = np.cumsum([0] + [len(c) for c in lists]).astype(np.int32)
            cells = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(lists)))
            return pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), cells, pa.array(blocks, pa.int32())],
                names=["id", "v", "cells", "block"],
            )

        asked = vectors_of(queries, id_col, vector_col)
        routed = asked.mapInArrow(route, f"id long, v {type_of(asked, 'v')}, cells array<int>, block int")
        parts = folds(asked.count(), QUERY_ROWS)
        part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
        routed = routed.withColumn("part", part)
        # Every block meets every part of the queries.
        mine = self.placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))) if parts > 1 else (
            self.placed.withColumn("part", F.lit(0))
        )
        keys = ["block", "part"]
        found = mine.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInArrow(
            _best(k), "query_id long, vec_id long, score double"
        )
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return (
            found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score")
        )


def _best(k: int):
    """Group function: the k best vectors of a block for each query of a part, of the query's cells only."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            ids, cells = left.column("id").to_numpy(), left.column("cell").to_numpy()
            order = np.lexsort((ids, cells))
            ids, cells = ids[order], cells[order]
            m, q = unit_rows(matrix(left.column("v")))[order], unit_rows(matrix(right.column("v")))
            asked = right.column("id").to_numpy()
            lists = right.column("cells").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            sizes = np.diff(lists.offsets.to_numpy())
            for at in range(0, len(asked), 256):
                part = slice(at, at + 256)
                # Visits of this part's queries, by cell.
                seen = lists.slice(at, 256).flatten().to_numpy()
                who = np.repeat(np.arange(len(sizes[part])), sizes[part])
                by = np.argsort(seen, kind="stable")
                seen, who = seen[by], who[by]
                near = np.full((len(sizes[part]), len(ids)), -np.inf)
                begin = np.flatnonzero(np.diff(seen, prepend=-1))
                for lo, hi in zip(begin, np.append(begin[1:], len(seen))):
                    a, b = np.searchsorted(cells, [seen[lo], seen[lo] + 1])
                    near[who[lo:hi], a:b] = q[at + who[lo:hi]] @ m[a:b].T
                near[asked[part, None] == ids[None, :]] = -np.inf
                # Products differ in their last digits by the shape of the blocks, so all close to the k-th are
                # taken and scored again one by one; then the smaller id settles ties.
                cut = np.partition(near, -min(k, len(ids)), axis=1)[:, -min(k, len(ids)), None]
                row, col = np.nonzero((near >= cut - 1e-12) & np.isfinite(near))
                score = np.empty(len(row))
                for i in range(0, len(row), 65_536):
                    some = slice(i, i + 65_536)
                    score[some] = np.einsum("ij,ij->i", q[at + row[some]], m[col[some]])
                score = np.clip(score, -1.0, 1.0)
                best = np.lexsort((ids[col], -score, row))
                row, col, score = row[best], col[best], score[best]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                out["query_id"].append(asked[at + row[keep]])
                out["vec_id"].append(ids[col[keep]])
                out["score"].append(score[keep])
        types = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        return pa.table({c: pa.array(np.concatenate(v) if v else [], types[c]) for c, v in out.items()})

    return run
