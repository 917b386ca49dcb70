"""Hard negatives by exact inner products, found through an inverted multi-index with sure bounds.

Components are whole numbers (``floor(256 * x)``), so scores are exact. Vectors are split in two halves,
each with a codebook of its own; a pair of centroids is a cell. With the largest distance of any vector
from its centroid, a half's score is at most ``q . c + |q| * radius``, and a cell's score at most the sum of
both. The multi-sequence walk visits cells by that sum, from a heap that starts at the best pair; it is
done when the sum falls under what an anchor still needs, which is then certain:

* positives: the best rows of the anchor's own label, needed from its k-th score found upwards;
* negatives: the best rows of other labels in a window of scores for every positive, needed from the
  n-th score found in the window upwards, or from the window's lower end.

Each search runs in two waves: the first walks until its cells hold a few thousand rows and gives every
anchor a bound, the second goes on to where that bound certifies the result. Cells carry radii of their
own, and what they rule out is not visited. Where bounds rule out little, all cells are visited: the
result is exact either way.

Cells are cut into bins of bounded size, a crowded cell into several, and anchors are dealt into parts; a
task holds one bin and one part, and multiplies blocks of anchors with the rows of the cells they visit.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescout.llm.common import empty_frame, folds, stored
from tablescout.llm.neighbours import centroids, distances, matrix

#: Fixed values of the contract: scale of a component, positives of an anchor, negatives of a positive, and
#: the window of a negative's score in hundredths of the positive's.
SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
#: Vectors that the codebooks are fitted on, by the hash of their ids; rows per cell that their size aims
#: at; most centroids of a half, so at most 4,096 cells.
FITTED, CELL_ROWS, MOST_CENTROIDS = 8192, 256, 64
#: Rows that the first wave visits at least; rows of a bin; anchors of a part; anchors multiplied at once.
SEED_ROWS, BIN_ROWS, PART_ROWS, _CHUNK = 4096, 8192, 8192, 128


def takes_part(label: Column, v: Column) -> Column:
    """True unless the label or the vector is null, or a component is null or not finite."""
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(label.isNotNull() & finite, F.lit(False))


def whole(v: Column, scale: int = SCALE) -> Column:
    """Components as whole numbers: the floor of ``scale`` times each, in double precision."""
    return F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers.

    Doubles hold them exactly while no sum can pass 2**53; beyond that whole numbers are multiplied, and
    what 64 bits cannot hold is an error.
    """
    q_most, m_most = np.abs(q).max(initial=0.0), np.abs(m).max(initial=0.0)
    most = q_most * m_most * max(1, q.shape[1])
    if most < 2.0**53:
        return (q @ m.T).astype(np.int64)
    if most >= 2.0**62 or max(q_most, m_most) >= 2.0**53:
        raise ValueError("components too large for exact scores")
    return q.astype(np.int64) @ m.astype(np.int64).T


def walk(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """``(bound, i, j)`` over all pairs of a first and a second half, by falling sum of their bounds."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    if not len(a) or not len(b):
        return
    # A pair is reached from the one before it in its row; each row's head from the row above.
    heap = [(-(first[a[0]] + second[b[0]]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, int(a[i]), int(b[j])
        if j + 1 < len(b):
            heapq.heappush(heap, (-(first[a[i]] + second[b[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(first[a[i + 1]] + second[b[0]]), i + 1, 0))


class Codebooks:
    """Two half-space codebooks, radii and sizes of the cells, and the bins that hold them; small arrays only."""

    def __init__(self, points: np.ndarray, n: int, cell_rows: int):
        self.half = max(1, points.shape[1] // 2)
        k = int(min(MOST_CENTROIDS, max(2, round((n / cell_rows) ** 0.5)), len(points)))
        self.first, self.second = centroids(points[:, : self.half], k, 1), centroids(points[:, self.half :], k, 2)
        cells = len(self.first) * len(self.second)
        self.rows, self.radius = np.zeros(cells, dtype=np.int64), np.zeros((2, cells))
        self.bin, self.bins, self.n_bins = np.zeros(cells, dtype=np.int32), np.ones(cells, dtype=np.int32), 1

    def assign(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell of each vector, and how far it is from either centroid."""
        parts = (m[:, : self.half], self.first), (m[:, self.half :], self.second)
        own = [distances(part, centre).argmin(axis=1) for part, centre in parts]
        # Measured from the differences, so that rounding cannot make a radius too small.
        far = [np.sqrt(((part - centre[at]) ** 2).sum(axis=1)) for (part, centre), at in zip(parts, own)]
        return (own[0] * len(self.second) + own[1]).astype(np.int32), *far

    def measure(self, sizes: list, bin_rows: int) -> None:
        """Take sizes and radii, and deal the cells into bins: neighbours share one, a crowded cell has several."""
        for r in sizes:
            self.rows[r["cell"]] = r["n"]
            self.radius[:, r["cell"]] = r["far1"], r["far2"]
        at, held = 0, 0
        for c in np.flatnonzero(self.rows).tolist():
            need, n = folds(self.rows[c], bin_rows), int(self.rows[c])
            if held and held + n > bin_rows:
                at, held = at + 1, 0
            self.bin[c], self.bins[c] = at, need
            at, held = (at + need, 0) if need > 1 else (at, held + n)
        self.n_bins = at + 1

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, ...]:
        """Bounds of one anchor: of either half by centroid, and ``(upper, lower)`` by cell."""
        q1, q2 = q[: self.half], q[self.half :]
        n1, n2 = float(np.sqrt(q1 @ q1)), float(np.sqrt(q2 @ q2))
        s1, s2 = self.first @ q1, self.second @ q2
        r1, r2 = (r.reshape(len(self.first), len(self.second)) for r in self.radius)
        # Room for rounding, relative to the sums' largest part.
        slack = 1e-9 * (1.0 + np.abs(s1).max() + np.abs(s2).max() + n1 * r1.max() + n2 * r2.max())
        far = n1 * r1 + n2 * r2 + slack
        middle = s1[:, None] + s2[None, :]
        return s1 + n1 * r1.max(axis=1), s2 + n2 * r2.max(axis=0) + slack, middle + far, middle - far


def fit(rows: DataFrame, cell_rows: int = CELL_ROWS, bin_rows: int = BIN_ROWS) -> tuple[Codebooks, DataFrame] | None:
    """Codebooks for rows ``id, label, v`` with whole components, and the rows with their cell; None without rows."""
    n = rows.count()
    # A share by hash first, so that tasks do not each send the whole bound to the driver.
    mark, share = F.xxhash64("id", "v"), min(1.0, 1.5 * FITTED / max(1, n))
    some = rows.select("id", "v").where(F.pmod(mark, F.lit(1_000_003)) < int(share * 1_000_003) + 1)
    sample = some.orderBy(mark, "id").limit(FITTED).toArrow()
    if not n or not sample.num_rows:
        # One crowd of copies may all miss the share.
        sample = rows.select("id", "v").limit(1).toArrow()
    if not sample.num_rows:
        return None
    books = Codebooks(matrix(sample.column("v")), n, cell_rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                more = [pa.array(x) for x in books.assign(matrix(b.column(2)))]
                yield pa.RecordBatch.from_arrays([*b.columns, *more], names=["id", "label", "v", "cell", "far1", "far2"])

    schema = "id long, label long, v array<long>, cell int, far1 double, far2 double"
    placed = stored(rows.select("id", "label", "v").mapInArrow(place, schema), "negative-cells")
    # At most 4,096 rows.
    sizes = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("far1").alias("far1"), F.max("far2").alias("far2")
    )
    books.measure(sizes.collect(), bin_rows)
    return books, placed


def _visits(books: Codebooks, q: np.ndarray, windows: list[tuple[int, float]], seed: int, seen: int) -> tuple[list[int], int]:
    """Cells that an anchor visits, and how many it has walked.

    ``windows`` are the score ranges that it still needs. A first wave (``seed`` rows) stops once its cells
    hold them; a second goes on behind the ``seen`` cells until no later cell can reach a window.
    """
    first, second, upper, lower = books.bounds(q)
    least, cells, walked, held = min(lo for lo, _ in windows), [], 0, 0
    for bound, i, j in walk(first, second):
        if bound < least or (seed and held >= seed):
            break
        walked += 1
        cell = i * len(second) + j
        if walked <= seen or not books.rows[cell]:
            continue
        if any(upper[i, j] >= lo and lower[i, j] <= hi for lo, hi in windows):
            cells.append(cell)
            held += int(books.rows[cell])
    return cells, walked


_ASKED = "key long, id long, label long, v array<long>, windows array<struct<p:long,lo:long,hi:long>>, seen int"
_FOUND = "key long, p long, id long, score long"


def _route(books: Codebooks, seed: int):
    """Anchors ``key, id, label, v, windows, seen`` once for every bin that they visit."""
    least = np.iinfo(np.int64).min

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = matrix(b.column(3))
            at, bins, cells, walked = [], [], [], []
            for i, (q, windows, seen) in enumerate(zip(m, b.column(4).to_pylist(), b.column(5).to_pylist())):
                ranges = [
                    (-np.inf if w["lo"] == least else w["lo"], np.inf if w["hi"] is None else w["hi"]) for w in windows
                ]
                got, n = _visits(books, q, ranges, seed, seen)
                per: dict[int, list[int]] = {}
                for c in got:
                    for x in range(books.bins[c]):
                        per.setdefault(int(books.bin[c]) + x, []).append(c)
                # An anchor without cells still tells how far it walked.
                for x, own in per.items() if per else ((-1, []),):
                    at.append(i)
                    bins.append(x)
                    cells.append(own)
                    walked.append(n)
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(i).take(rows) for i in range(5)), pa.array(walked, pa.int32()), pa.array(bins, pa.int32()),
                    pa.array(cells, pa.list_(pa.int32())),
                ],
                names=["key", "id", "label", "v", "windows", "seen", "bin", "cells"],
            )

    return run


def _score(k: int, same: bool):
    """Group function: the ``k`` best rows of a bin for every window of every anchor of a part."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            ids = left.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, label = ids[order], left.column("label").to_numpy()[order]
            cell, m = left.column("cell").to_numpy()[order], matrix(left.column("v"))[order]
            names, column = np.unique(cell, return_inverse=True)
            key, asked = right.column("key").to_numpy(), right.column("id").to_numpy()
            own, q = right.column("label").to_numpy(), matrix(right.column("v"))
            windows, visited = right.column("windows").to_pylist(), right.column("cells").to_pylist()
            for lo in range(0, len(key), _CHUNK):
                part = slice(lo, lo + _CHUNK)
                score = products(q[part], m)
                goes = np.zeros((len(score), len(names)), dtype=bool)
                for i, cells in enumerate(visited[part]):
                    goes[i, np.searchsorted(names, cells)] = True
                ok = goes[:, column] & ((label[None, :] == own[part, None]) == same)
                if same:
                    ok &= ids[None, :] != asked[part, None]
                for i in range(len(score)):
                    at = np.flatnonzero(ok[i])
                    near = score[i, at]
                    for w in windows[lo + i]:
                        keep = near >= w["lo"]
                        if w["hi"] is not None:
                            keep &= near <= w["hi"]
                        mine, s = at[keep], near[keep]
                        if len(s) > k:
                            few = s >= np.partition(s, len(s) - k)[len(s) - k]
                            mine, s = mine[few], s[few]
                        # Rows go by id, so a stable order settles ties.
                        best = np.argsort(-s, kind="stable")[:k]
                        for x in best.tolist():
                            out[0].append(key[lo + i])
                            out[1].append(w["p"])
                            out[2].append(ids[mine[x]])
                            out[3].append(s[x])
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["key", "p", "id", "score"])

    return run


def _wave(
    books: Codebooks, placed: DataFrame, asked: DataFrame, k: int, same: bool, seed: int, parts: int
) -> tuple[DataFrame, DataFrame]:
    """One wave: ``(found, routed)``, the best rows per anchor and window, and what every anchor walked."""
    asked = asked.select("key", "id", "label", "v", "windows", "seen")
    routed = stored(asked.mapInArrow(_route(books, seed), _ASKED + ", bin int, cells array<int>"), "negative-visits")
    first, many = books.bin, books.bins

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = b.column(3).to_numpy()
            bin_ = first[cell] + b.column(4).to_numpy() % many[cell]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array(bin_.astype(np.int32))], names=["id", "label", "v", "cell", "bin"]
            )

    # Rows of a crowded cell take turns, copies included; the table is written, so a row keeps its place.
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 30)).cast("int")
    rows = placed.select("id", "label", "v", "cell", spread.alias("bin")).mapInArrow(
        dealt, "id long, label long, v array<long>, cell int, bin int"
    )
    # Every bin meets every part of the anchors.
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    part = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")
    visits = routed.where("bin >= 0").withColumn("part", part)
    tasks = max(1, min(books.n_bins * parts, 20_000))
    keys = ["bin", "part"]
    found = (
        rows.repartition(tasks, *keys).groupBy(*keys).cogroup(visits.repartition(tasks, *keys).groupBy(*keys))
        .applyInArrow(_score(k, same), _FOUND)
    )
    return stored(_best(found, k), "negative-found"), routed


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key", "p").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def _two_waves(
    books: Codebooks, placed: DataFrame, asked: DataFrame, k: int, same: bool, seed: int, parts: int
) -> DataFrame:
    """``key, p, id, score, rank``: the ``k`` best rows of every window, whatever the codebooks."""
    found, routed = _wave(books, placed, asked, k, same, seed, parts)
    # The k-th score in a window is needed from now on; with fewer rows all of the window is.
    kth = found.where(F.col("rank") == k).groupBy("key").agg(
        F.map_from_entries(F.collect_list(F.struct("p", "score"))).alias("kth")
    )
    lo = lambda w: F.coalesce(F.try_element_at("kth", w["p"]), w["lo"])
    narrowed = F.transform("windows", lambda w: F.struct(w["p"].alias("p"), lo(w).alias("lo"), w["hi"].alias("hi")))
    walked = routed.groupBy("key").agg(F.first("seen").alias("seen"))
    more = asked.drop("seen").join(kth, "key", "left").withColumn("windows", narrowed).drop("kth").join(walked, "key")
    rest, _ = _wave(books, placed, more, k, same, 0, parts)
    return _best(found.drop("rank").unionByName(rest.drop("rank")), k)


def mine_negatives(
    df: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
    cell_rows: int = CELL_ROWS, bin_rows: int = BIN_ROWS, part_rows: int = PART_ROWS, seed_rows: int = SEED_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` is a condition on the columns of ``df``. A row's score is its inner product with the anchor
    on whole components. An anchor's positives are its best other rows of the same label; a positive's
    negatives are the best rows of other labels with ``low * p <= 100 * score <= high * p``. Equal scores go
    by the smaller id.

    Rows without an id, with a null label or a vector that is null or holds null or non-finite
    components take no part; zero vectors do. A row is no positive of an anchor with its own id; rows that
    share an id are candidates each, and anchors each, so their results repeat. Empty tables and anchors
    without a candidate give no rows; vectors of different lengths raise an error.
    """
    columns = [F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label")]
    part = F.col(id_col).isNotNull() & takes_part(F.col(label_col), F.col(vector_col))
    rows = df.where(part).select(
        *columns, whole(F.col(vector_col), scale).alias("v"), F.coalesce(anchors, F.lit(False)).alias("asked")
    )
    fitted = fit(rows, cell_rows, bin_rows)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if fitted is None:
        return empty_frame(df.sparkSession, schema)
    least, no_end = F.lit(np.iinfo(np.int64).min).cast("long"), F.lit(None).cast("long")
    every = F.array(F.struct(F.lit(0).cast("long").alias("p"), least.alias("lo"), no_end.alias("hi")))
    # Keys are written with the rows, so that later jobs read the same ones.
    asked = stored(
        rows.where("asked").select(
            F.monotonically_increasing_id().alias("key"), "id", "label", "v", every.alias("windows"), F.lit(0).alias("seen")
        ),
        "anchors",
    )
    parts = folds(asked.count(), part_rows)
    best = stored(
        _two_waves(*fitted, asked, positives, True, seed_rows, parts).select(
            "key", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
        ),
        "positives",
    )
    # The window of a positive in whole numbers; none where it is empty.
    p = F.col("positive_score")
    floored = lambda share: F.expr(f"({share} * positive_score - pmod({share} * positive_score, 100)) div 100")
    spans = best.select("key", p.alias("p"), (-floored(-low)).alias("lo"), floored(high).alias("hi"))
    spans = spans.where("lo <= hi").distinct()
    windows = spans.groupBy("key").agg(F.collect_list(F.struct("p", "lo", "hi")).alias("windows"))
    hunted = stored(asked.drop("windows").join(windows, "key"), "hunters")
    found = _two_waves(*fitted, hunted, negatives, False, seed_rows, parts)
    named = asked.select("key", F.col("id").alias("anchor_id"))
    hard = found.select(
        "key", F.col("p").alias("positive_score"), "rank", F.col("id").alias("negative_id"),
        F.col("score").alias("negative_score"),
    )
    return best.join(named, "key").join(hard, ["key", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
