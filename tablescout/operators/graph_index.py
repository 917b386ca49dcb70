"""Approximate nearest rows by a neighbour graph, built and walked as joins.

Building: equal vectors are one node. Nodes are dealt around random pivots several times, and in each
block of bounded size every node finds its nearest; the best of all dealings are its neighbours. Then
neighbours of neighbours are tried in a join, which links what the blocks kept apart. Each node also
gets the nearest of those that named it, so that walks lead to it.

Searching: a query starts at the nearest of a bounded set of entry nodes and keeps the best nodes that
it has met. Each step opens some of them for all queries at once: a join brings their neighbours, and
another one the vectors of those not met before. It ends once the best of all queries are open, so
the number of steps follows the length of the walks, not the number of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescout.functions import vectors as V
from tablescout.operators.nearest import _matrix as matrix
from tablescout.sources.lineage import cut_lineage

#: Nodes of a block, most pivots of a dealing, and entry nodes; pivots and entries are broadcast.
BLOCK_ROWS, PIVOTS, ENTRIES = 1024, 1024, 128
#: Neighbours of a node, dealings, rounds of neighbours of neighbours, and how many each node looks through.
DEGREE, DEALINGS, ROUNDS, LOOK = 16, 4, 1, 8


class Graph(NamedTuple):
    """``nodes`` (id, v), ``links`` (id, near), ``copies`` (id, vec_id), and the entry nodes."""

    nodes: DataFrame
    links: DataFrame
    copies: DataFrame
    entries: list


def _sampled(nodes: DataFrame, bound: int, seed: int) -> list:
    """At most ``bound`` nodes, those with the least hashes."""
    return nodes.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(bound).collect()


def _dealt(nodes: DataFrame, pivots: np.ndarray, seed: int) -> DataFrame:
    """Nodes with the block they fall into: by nearest pivot, a crowded one split by hash."""
    norms = np.einsum("ij,ij->i", pivots, pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = norms[None, :] - 2.0 * matrix(b.column(1)) @ pivots.T
                cell = pa.array(d.argmin(axis=1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*b.columns, cell], names=["id", "v", "cell"])

    kind = nodes.schema["v"].dataType.simpleString()
    placed = nodes.mapInArrow(assign, f"id long, v {kind}, cell int")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("parts"))
    part = F.pmod(F.xxhash64("id", F.lit(seed)), F.col("parts"))
    # One small row for each pivot.
    return placed.join(F.broadcast(sizes), "cell").select("id", "v", "cell", part.alias("part"))


def _near_in_block(degree: int):
    def run(t: pa.Table) -> pa.Table:
        ids, m = t.column("id").to_numpy(), matrix(t.column("v"))
        norms = np.einsum("ij,ij->i", m, m)
        k = min(degree, len(ids) - 1)
        if k < 1:
            return pa.table({c: pa.array([], kind) for c, kind in (("id", pa.int64()), ("other", pa.int64()), ("score", pa.float64()))})
        d = np.maximum(norms[:, None] + norms[None, :] - 2.0 * m @ m.T, 0.0)
        np.fill_diagonal(d, np.inf)
        top = np.argpartition(d, k - 1, axis=1)[:, :k]
        return pa.table({
            "id": np.repeat(ids, k), "other": ids[top].ravel(), "score": np.take_along_axis(d, top, axis=1).ravel(),
        })

    return run


def _best(links: DataFrame, by: str, other: str, degree: int) -> DataFrame:
    """The nearest ``degree`` of every node; the window drops the rest before the shuffle."""
    order = Window.partitionBy(by).orderBy("score", other)
    return links.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= degree).drop("_n")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two ids and the squared distance of their two vectors."""
    for b in batches:
        if b.num_rows:
            gap = matrix(b.column(2)) - matrix(b.column(3))
            score = np.einsum("ij,ij->i", gap, gap).round(V.DISTANCE_DECIMALS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], names=["id", "other", "score"])


def _through_neighbours(nodes: DataFrame, links: DataFrame, degree: int) -> DataFrame:
    """The links after one look at the neighbours of neighbours, both the named and the naming."""
    both = links.unionByName(_best(links.select(F.col("other").alias("id"), F.col("id").alias("other"), "score"), "id", "other", degree))
    few = _best(both.distinct(), "id", "other", LOOK).select("id", "other")
    tried = (
        few.join(few.select(F.col("id").alias("other"), F.col("other").alias("next")), "other")
        .select("id", F.col("next").alias("other")).where("id <> other").distinct()
        .join(links.select("id", "other"), ["id", "other"], "left_anti")
    )
    pairs = (
        tried.join(nodes.select("id", F.col("v").alias("a")), "id")
        .join(nodes.select(F.col("id").alias("other"), F.col("v").alias("b")), "other")
        .select("id", "other", "a", "b")
    )
    scored = pairs.mapInArrow(_measured, "id long, other long, score double")
    return _best(links.unionByName(scored), "id", "other", degree)


def build_graph(
    corpus: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    degree: int = DEGREE,
    dealings: int = DEALINGS,
    rounds: int = ROUNDS,
) -> Graph:
    """A graph over all rows with a vector; null vectors take no part, lengths must agree.

    Every distinct vector is a node, named by the least id of its rows, which are its copies.
    """
    rows = corpus.where(F.col(vector_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")
    )
    nodes = cut_lineage(rows.groupBy("v").agg(F.min("vec_id").alias("id")).select("id", "v"))
    copies = cut_lineage(rows.join(nodes, "v").select("id", "vec_id"))
    n = nodes.count()
    found = None
    blocks = -(-n // BLOCK_ROWS)
    for seed in range(dealings if blocks > 1 else min(blocks, 1)):
        # A pivot for half a block, as cells differ in size.
        pivots = np.array([r["v"] for r in _sampled(nodes, min(PIVOTS, 2 * blocks), seed)], dtype=np.float64)
        near = _dealt(nodes, pivots if blocks > 1 else pivots[:1], seed).groupBy("cell", "part").applyInArrow(
            _near_in_block(degree), "id long, other long, score double"
        )
        found = near if found is None else found.unionByName(near)
    if found is None:
        found = nodes.select("id", F.col("id").alias("other"), F.lit(0.0).alias("score")).where("false")
    one = found.groupBy("id", "other").agg(F.min("score").alias("score"))
    links = cut_lineage(_best(one, "id", "other", degree))
    for _ in range(rounds if blocks > 1 else 0):
        links = cut_lineage(_through_neighbours(nodes, links, degree))
    naming = _best(links.select(F.col("other").alias("id"), F.col("id").alias("other"), "score"), "id", "other", degree)
    near = links.unionByName(naming).groupBy("id").agg(F.collect_set("other").alias("near"))
    return Graph(nodes, cut_lineage(near), copies, _sampled(nodes, ENTRIES, -1))


_BEST = "array<struct<score:double,id:bigint>>"


def _entered(entries: list):
    """Queries with their distances to the entry nodes, a bounded table that travels with the tasks."""
    ids, m = np.array([r["id"] for r in entries], dtype=np.int64), np.array([r["v"] for r in entries], dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            d = np.stack([((q[None, :] - m) ** 2).sum(axis=1) for q in matrix(b.column(1))]).round(V.DISTANCE_DECIMALS)
            pairs = pa.StructArray.from_arrays([pa.array(d.ravel()), pa.array(np.tile(ids, len(d)))], names=["score", "id"])
            best = pa.ListArray.from_arrays(pa.array(np.arange(0, len(pairs) + 1, len(ids), dtype=np.int32)), pairs)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), best], names=["query_id", "qv", "best"])

    return run


def _ordered(best: Column, most: int) -> Column:
    return F.slice(F.array_sort(best), 1, most)


def search_graph(
    graph: Graph,
    queries: DataFrame,
    k: int = 10,
    beam: int = 64,
    width: int = 16,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    compared: bool = False,
) -> DataFrame:
    """Approximate k nearest rows of every query: ``query_id, vec_id, score, rank``, copies by id.

    ``beam`` nodes are kept for each query, at least k, and ``width`` of them are opened in a step. With
    ``compared`` a column says how many vectors the query was compared with. Query ids must be unique.
    """
    spark, beam = queries.sparkSession, max(beam, k)
    asked = queries.where(F.col(query_vector).isNotNull()).select(
        F.col(query_id).cast("long").alias("query_id"), F.col(query_vector).cast("array<double>").alias("qv")
    )
    if not graph.entries:
        return spark.createDataFrame([], "query_id long, vec_id long, score double, rank int" + ", compared long" * compared)
    state = asked.mapInArrow(_entered(graph.entries), f"query_id long, qv array<double>, best {_BEST}")
    state = cut_lineage(
        state.select(
            "query_id", "qv", _ordered(F.col("best"), beam).alias("best"), F.transform("best", lambda b: b["id"]).alias("seen"),
            F.array().cast("array<long>").alias("opened"),
        )
    )
    while True:
        closed = F.filter("best", lambda b: ~F.array_contains("opened", b["id"]))
        state = state.withColumn("next", F.transform(F.slice(closed, 1, width), lambda b: b["id"]))
        front = state.where(F.size("next") > 0)
        if front.isEmpty():
            break
        around = front.select("query_id", F.explode("next").alias("id")).join(graph.links, "id")
        new = around.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
        fresh = (
            front.join(new, "query_id").select("query_id", "qv", F.explode(F.array_except("near", "seen")).alias("id"))
            .join(graph.nodes, "id").select(F.col("query_id").alias("id"), F.col("id").alias("other"), "v", "qv")
            .mapInArrow(_measured, "id long, other long, score double")
            .groupBy(F.col("id").alias("query_id")).agg(F.collect_list(F.struct("score", F.col("other").alias("id"))).alias("more"))
        )
        more = F.coalesce("more", F.array().cast(_BEST))
        state = cut_lineage(
            state.join(fresh, "query_id", "left").select(
                "query_id", "qv", _ordered(F.concat("best", more), beam).alias("best"),
                F.concat("seen", F.transform(more, lambda m: m["id"])).alias("seen"),
                F.concat("opened", "next").alias("opened"),
            )
        )
    hits = state.select("query_id", F.size("seen").cast("long").alias("compared"), F.explode(F.slice("best", 1, k)).alias("b"))
    hits = cut_lineage(hits.select("query_id", "compared", "b.id", "b.score"))
    # No more than k copies of a node can be among the k nearest; the window drops the others before the shuffle.
    nth = F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))
    few = graph.copies.join(hits.select("id").distinct(), "id", "left_semi").withColumn("nth", nth).where(F.col("nth") <= k)
    hits = hits.join(few, "id")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", "vec_id", "score", "rank", *(["compared"] if compared else []))
