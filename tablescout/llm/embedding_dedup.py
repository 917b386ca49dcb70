"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one kept per group.

Centres of length 1 are fitted on a bounded sample; every vector goes to the cell of its nearest
centre, its home. The partners of a vector near a border may live in another cell, so it is also sent
as a guest to the cells of smaller number whose border is near. Near means: no further than a partner
at the threshold can lie, whatever the dimensions, so no link is missed. Neighbouring numbers share a
bin of bounded size, and a vector goes to a bin once. A pair meets in one bin only, the one where one
or both are at home.

The residents and guests of a bin are cut into blocks of bounded size and compared block by block
as matrix products in double precision; only counts per vector and a spanning forest per block leave
a task. Equal vectors are one class with a count, so copies are not compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import empty_frame, folds, stored
from tablescout.llm.graph import components
from tablescout.llm.neighbours import matrix, sample_of, type_of, unit_rows, vectors_of

SIMILARITY = 0.95
#: Vectors per cell that the number of centres aims at; most centres; residents and guests in a block.
CELL_ROWS, MOST_CELLS, BLOCK_ROWS, GUEST_ROWS = 512, 4096, 2048, 4096
ROUNDS = 6


def spherical_centres(points: np.ndarray, k: int, seed: int = 1, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means of a bounded sample: centres are means scaled to length 1."""
    rng = np.random.default_rng(seed)
    # One of each, so that copies do not take up centres.
    points = np.unique(points.round(3), axis=0)
    points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    centre = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near = (points @ centre.T).argmax(axis=1)
        for c in range(len(centre)):
            mean = points[near == c].sum(axis=0)
            size = np.linalg.norm(mean)
            if size > 1e-9:
                centre[c] = mean / size
    return np.unique(centre, axis=0)


def guest_cells(near: np.ndarray, own: np.ndarray, centre: np.ndarray, similarity: float) -> np.ndarray:
    """Which cells each vector visits as a guest: ``rows x cells``.

    The border of two cells is where both centres are equally near; a vector's distance from it is the
    difference of its two cosines over the distance of the centres. A vector ``a`` from the border and
    one beyond it, both of length 1, have a cosine of at most ``sqrt(1 - a * a)``.
    """
    at = np.arange(len(near))
    apart = np.sqrt(np.maximum(2.0 - 2.0 * centre @ centre.T, 1e-18))
    from_border = (near[at, own][:, None] - near) / apart[own]
    reach = np.sqrt(max(0.0, 1.0 - similarity**2)) + 1e-7 if similarity > 0 else np.inf
    return (from_border <= reach) & (np.arange(len(centre))[None, :] < own[:, None])


def bins_of(rows: np.ndarray, most: int) -> np.ndarray:
    """Bin of each cell: consecutive cells together hold at most ``most`` rows, a larger cell is alone."""
    out, at, held = np.zeros(len(rows), dtype=np.int32), 0, 0
    for cell, n in enumerate(rows):
        if held and held + n > most:
            at, held = at + 1, 0
        out[cell], held = at, held + n
    return out


def _place(centre: np.ndarray, similarity: float):
    """Rows ``node, v, n`` with their home cell and the cells that they visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                some = b.slice(lo, 1024)
                near = unit_rows(matrix(some.column(1))) @ centre.T
                own = near.argmax(axis=1)
                row, cell = np.nonzero(guest_cells(near, own, centre, similarity))
                ends = np.concatenate([[0], np.bincount(row, minlength=len(own)).cumsum()]).astype(np.int32)
                visits = pa.ListArray.from_arrays(pa.array(ends), pa.array(cell.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(i) for i in range(3)), pa.array(own.astype(np.int32)), visits],
                    names=["node", "v", "n", "own", "visits"],
                )

    return run


def _deal(bin_of: np.ndarray):
    """Placed rows, once for their home bin and once for every other bin that they visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                some = b.slice(lo, 1024)
                mine = bin_of[some.column(3).to_numpy()]
                visits = some.column(4)
                row = np.repeat(np.arange(len(mine)), np.diff(visits.offsets.to_numpy()))
                met = np.unique(np.stack([row, bin_of[visits.flatten().to_numpy()]], axis=1), axis=0)
                met = met[met[:, 1] != mine[met[:, 0]]]
                at = pa.array(np.concatenate([np.arange(len(mine)), met[:, 0]]))
                cells = pa.array(np.concatenate([mine, met[:, 1]]).astype(np.int32))
                home = pa.array(np.arange(len(at)) < len(mine))
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(i).take(at) for i in range(3)), cells, home], names=["node", "v", "n", "cell", "home"]
                )

    return run


_LINK = "node long, links long, other long"


def _join(label: np.ndarray, linked: np.ndarray, mine: np.ndarray, others: np.ndarray) -> None:
    """Give linked rows one label."""
    for i, row in zip(mine, linked):
        if row.any():
            labels = np.unique(label[np.append(others[row], i)])
            if len(labels) > 1:
                label[np.isin(label, labels)] = labels[0]


def _compare(similarity: float):
    """Group function over rows ``node, v, n, home, side``: links of side 0 with side 1, or within side 0.

    Gives per linked vector how many other vectors it links with here, and the least node that it
    reaches here.
    """

    def run(rows: pa.Table) -> pa.Table:
        node, n = rows.column("node").to_numpy(), rows.column("n").to_numpy()
        m = unit_rows(matrix(rows.column("v")))
        side, home = rows.column("side").to_numpy(), rows.column("home").to_numpy(zero_copy_only=False).astype(bool)
        a = np.flatnonzero(side == 0)
        b = np.flatnonzero(side == 1) if (side == 1).any() else a
        links, label = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
        for at in range(0, len(a), 256):
            mine = a[at : at + 256]
            linked = m[mine] @ m[b].T >= similarity
            # Two guests meet elsewhere.
            linked &= home[mine][:, None] | home[b][None, :]
            linked &= mine[:, None] != b[None, :]
            links[mine] += linked @ n[b]
            if b is not a:
                links[b] += linked.T @ n[mine]
            _join(label, linked, mine, b)
        least = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(least, label, node)
        hit = np.flatnonzero(links > 0)
        return pa.table({"node": node[hit], "links": links[hit], "other": least[label[hit]]})

    return run


def near_duplicate_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", similarity: float = SIMILARITY,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors link at a cosine at or over the threshold. ``n_links`` counts the other rows linked directly,
    ``component_id`` is the least id reachable by links, ``kept`` marks the row that bears it.

    Null, zero and non-finite vectors link with nothing and are kept. Rows with equal ids are
    separate vectors. An empty table gives no rows; vectors of different lengths raise an error.
    """
    spark = df.sparkSession
    rows = vectors_of(df, id_col, vector_col)
    # Equal vectors are one node, named by its least id; where vectors share an id, by a hash.
    found = stored(rows.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "vector-classes")
    shared = found.groupBy("id").agg(F.count(F.lit(1)).alias("_many")).where("_many > 1")
    name = F.when(F.col("id").isNull() | F.col("_many").isNotNull(), F.xxhash64("id", "v")).otherwise(F.col("id"))
    classes = found.join(shared, "id", "left").select("v", "id", "n", name.alias("node"))
    sample = sample_of(rows)
    links = empty_frame(spark, _LINK)
    if len(sample):
        total = found.count()
        centre = spherical_centres(sample, min(MOST_CELLS, folds(total, cell_rows)))
        vector = type_of(rows, "v")
        placed = stored(
            classes.select("node", "v", "n").mapInArrow(
                _place(centre, similarity), f"node long, v {vector}, n long, own int, visits array<int>"
            ),
            "vector-cells",
        )
        # One row per cell, at most MOST_CELLS.
        held = np.zeros(len(centre), dtype=np.int64)
        for r in placed.groupBy("own").agg(F.count(F.lit(1)).alias("n")).collect():
            held[r["own"]] = r["n"]
        dealt = placed.mapInArrow(
            _deal(bins_of(held, BLOCK_ROWS)), f"node long, v {vector}, n long, cell int, home boolean"
        )
        # Residents and guests of a bin have blocks of their own: residents meet all blocks, guests
        # only those of residents.
        blocks_of = lambda of, rows: F.ceil(F.count_if(of) / F.lit(rows)).cast("int")
        sizes = dealt.groupBy("cell").agg(
            blocks_of(F.col("home"), BLOCK_ROWS).alias("mine"), blocks_of(~F.col("home"), GUEST_ROWS).alias("guests")
        ).where("mine > 0")
        mine, guests = F.col("mine"), F.col("guests")
        block = F.when(F.col("home"), F.pmod(F.xxhash64("node"), mine)).otherwise(
            mine + F.pmod(F.xxhash64("node"), F.greatest(guests, F.lit(1)))
        )
        blocked = dealt.join(F.broadcast(sizes), "cell").withColumn("block", block.cast("int"))
        last = F.when(F.col("home"), mine + guests).otherwise(mine) - 1
        met = blocked.withColumn("with", F.explode(F.sequence(F.lit(0), last)))
        tasks = met.select(
            "cell", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"),
            (F.col("block") > F.col("with")).cast("int").alias("side"), "node", "v", "n", "home",
        )
        links = stored(tasks.groupBy("cell", "low", "high").applyInArrow(_compare(similarity), _LINK), "vector-links")
    named = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")), "vectors")
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    joined = classes.join(counted, "node", "left").join(named, "node", "left").select(
        "v", "id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
        F.coalesce("component", "node").alias("component"),
    )
    joined = stored(joined, "vector-components")
    least = joined.groupBy("component").agg(F.min("id").alias("component_id"))
    per_class = joined.join(least, "component").select("v", "links", "component_id")
    every = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    out = every.join(per_class, "v", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
