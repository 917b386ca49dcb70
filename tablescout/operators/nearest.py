"""Nearest neighbours by squared Euclidean distance or inner product.

One query uses a column expression and a top-k. Many queries meet the corpus in blocks: rows and
queries are dealt into blocks of a bounded number of bytes, and a task holds one block of each. Nothing
passes through the driver, and the corpus is read a fixed number of times however many queries there
are.

A corpus of several blocks is cut into cells, the rows nearest to each of some pivots, and so are the
queries, so that blocks hold neighbours. By the triangle inequality no row of a cell is nearer than
the query's distance from the pivot less the cell's radius. A query first visits its nearest cells,
by falling nearness until they hold k rows, which bounds its k-th distance; then only the cells
that this bound does not rule out. A block of rows goes to the blocks of queries that visit it.

Queries may be held against the rows of their own group (tenant, provider), against listed schemas
only, and may bring their own k. Within a group, the first block of rows gives the bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tablescout.functions import vectors as V
from tablescout.sources.lineage import cut_lineage

# A block of rows, and one of queries, is at most this many bytes of float64.
BLOCK_BYTES = 32 * 1024 * 1024
# Blocks that many queries of one search are dealt into at least, and queries that fill one in any case: the
# blocks of bytes alone would leave a corpus of one or two blocks to one or four tasks.
QUERY_BLOCKS, LEAST_QUERIES = 16, 8192
# Most pivots; cells that the rows of a block fall into.
PIVOTS, BLOCK_CELLS = 256, 4
# Numbers of a matrix of distances that a task holds at a time, rows of its parts, and pairs measured at once.
_TILE = 1 << 20
_FIRST_ROWS, _PART_ROWS, _PAIRS = 256, 2048, 1 << 16


def topk_exact(
    corpus: DataFrame,
    query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    condition: Column | None = None,
) -> DataFrame:
    """The k nearest rows of one query vector, rank from 1; k is cut to the number of rows."""
    rows = corpus.where(F.col(vector_col).isNotNull())
    if condition is not None:
        rows = rows.where(condition)
    scored = rows.withColumn("_q", query).withColumn(
        "score", F.round(V.squared_distance(F.col(vector_col), F.col("_q")), V.DISTANCE_DECIMALS)
    )
    best = scored.drop("_q", vector_col).orderBy("score", id_col).limit(k)
    # The rank runs over k rows.
    return best.withColumn("rank", F.row_number().over(Window.orderBy("score", id_col)))


def topk_inner_product(
    corpus: DataFrame,
    query: Column,
    k: int = 5,
    threshold: float = 0.5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The k rows with the largest inner product at or over the threshold."""
    rows = corpus.where(F.col(vector_col).isNotNull()).withColumn("_q", query)
    dot = F.round(V.inner_product(F.col(vector_col), F.col("_q")), V.DISTANCE_DECIMALS)
    return (
        rows.withColumn("score", dot)
        .drop("_q", vector_col)
        .where(F.col("score") >= threshold)
        .orderBy(F.col("score").desc(), id_col)
        .limit(k)
    )


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as doubles; vectors of different lengths are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not len(column):
        return flat.reshape(0, 1)
    lengths = np.unique(np.diff(column.offsets.to_numpy()))
    if len(lengths) > 1:
        raise ValueError(f"vectors differ in length: {lengths.tolist()}")
    return flat.reshape(len(column), -1)


def _same_length(rows: np.ndarray, queries: np.ndarray) -> None:
    if rows.shape[1] != queries.shape[1]:
        raise ValueError(f"vectors differ in length: {rows.shape[1]} and {queries.shape[1]}")


def _distances(corpus: np.ndarray, queries: np.ndarray, query_norms: np.ndarray) -> np.ndarray:
    """Queries x rows matrix of squared distances at the compared number of decimals."""
    d = (queries @ corpus.T) * -2.0
    d += query_norms[:, None]
    d += np.einsum("ij,ij->i", corpus, corpus)[None, :]
    return np.round(np.maximum(d, 0.0), V.DISTANCE_DECIMALS)


def _scores(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances, pair by pair, at the compared number of decimals."""
    gap = rows - queries
    return np.round(np.einsum("ij,ij->i", gap, gap), V.DISTANCE_DECIMALS)


def _foremost(rows: np.ndarray, marks: np.ndarray | None, most: int) -> np.ndarray:
    """Places of rows that can be among the ``most`` nearest: of equal vectors with equal marks, the first ones."""
    if len(rows) <= most:
        return np.arange(len(rows))
    raw = np.ascontiguousarray(rows if marks is None else np.column_stack([rows, marks]))
    which = np.unique(raw.view(np.dtype((np.void, raw.itemsize * raw.shape[1]))).ravel(), return_inverse=True)[1]
    order = np.argsort(which, kind="stable")
    nth = np.arange(len(rows)) - np.searchsorted(which[order], which[order])
    return np.sort(order[nth < most])


class _Nearest:
    """The nearest rows of a block for a tile of queries at a time; rows are ordered by their ids, which settle ties.

    A product in single precision tells which pairs can be near enough, with a margin over its largest error,
    and only these are measured in full. Where that leaves too many, the product is made again in doubles.
    Memory is bounded by the tile whatever the number of queries, marks and ties.
    """

    def __init__(self, rows: np.ndarray, marks: np.ndarray | None):
        self.rows, self.marks, self.center = rows, marks, rows.mean(axis=0)
        moved = rows - self.center
        self.norms = np.einsum("ij,ij->i", moved, moved)
        self.reach = float(np.sqrt(self.norms.max()))
        with np.errstate(over="ignore"):
            self.single = np.column_stack([moved, self.norms]).astype(np.float32)

    def _side(self, lo: int, hi: int, kind: type) -> np.ndarray:
        if kind is np.float32:
            return self.single[lo:hi]
        return np.column_stack([self.rows[lo:hi] - self.center, self.norms[lo:hi]])

    def _candidates(
        self, moved: np.ndarray, lo: int, hi: int, limit: np.ndarray, most: int, allowed: np.ndarray | None
    ) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query of the tile, row) that may be within the limit, none of those that are left out."""
        norms = np.einsum("ij,ij->i", moved, moved)
        far = np.sqrt(norms) + self.reach
        for kind in (np.float32, np.float64):
            if kind is np.float32 and far.max() > 1e18:
                continue
            left = np.column_stack([-2.0 * moved, np.ones(len(moved))]).astype(kind)
            d = left @ self._side(lo, hi, kind).T
            if allowed is not None:
                d[~allowed] = np.inf
            slack = np.finfo(kind).eps * (moved.shape[1] + 8) * far * far
            upto = limit - norms + slack
            # A query without a limit takes that of the k-th row of this part, as far as the product tells.
            free = np.flatnonzero(np.isposinf(limit))
            if len(free) and hi - lo > most:
                nth = np.partition(d[free], most - 1, axis=1)[:, most - 1]
                upto[free] = nth + 2.0 * slack[free]
            near = d <= np.nextafter(upto.astype(kind), kind(np.inf))[:, None]
            if allowed is not None:
                near &= allowed
            if np.count_nonzero(near) * 24 <= near.size:
                break
        at = np.flatnonzero(near)
        return at // (hi - lo), at % (hi - lo) + lo

    def search(
        self, queries: np.ndarray, k: np.ndarray, bound: np.ndarray, own: np.ndarray | None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, place and score of the k best rows within the bound; ``own`` tells the marks a query sees."""
        most, each, count = int(k.max()), np.arange(len(queries)), len(self.rows)
        best = np.full((len(queries), most), np.inf)
        found = np.full((len(queries), most), count)
        moved = queries - self.center
        # A short first part gives the limits that spare most pairs of the others.
        edges = [0, *range(min(_FIRST_ROWS, count), count, _PART_ROWS), count]
        for lo, hi in zip(edges, edges[1:]):
            limit = np.minimum(bound, best[each, k - 1]) + 10.0**-V.DISTANCE_DECIMALS
            # Nothing comes before k rows at distance 0.
            limit[best[each, k - 1] <= 0.0] = -np.inf
            allowed = None if own is None else own[:, self.marks[lo:hi]]
            q, p = self._candidates(moved, lo, hi, limit, most, allowed)
            for at in range(0, len(q), _PAIRS):
                self._fold(best, found, queries, k, bound, q[at : at + _PAIRS], p[at : at + _PAIRS])
        who, nth = np.nonzero(np.isfinite(best) & (np.arange(most)[None, :] < k[:, None]))
        return who, found[who, nth], best[who, nth]

    def _fold(self, best, found, queries, k, bound, q, p) -> None:
        """Measure pairs and fold them into the best (score, place) of their queries."""
        score = _scores(self.rows[p], queries[q])
        # A row at the k-th distance comes after those found, as its place is larger.
        keep = (score <= bound[q]) & (score < best[q, k[q] - 1])
        if not keep.any():
            return
        q, p, score = q[keep], p[keep], score[keep]
        who = np.unique(q)
        old, nth = np.nonzero(np.isfinite(best[who]))
        q = np.concatenate([who[old], q])
        p, score = np.concatenate([found[who[old], nth], p]), np.concatenate([best[who[old], nth], score])
        order = np.lexsort((p, score, q))
        q, p, score = q[order], p[order], score[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        kept = nth < best.shape[1]
        best[who] = np.inf
        best[q[kept], nth[kept]], found[q[kept], nth[kept]] = score[kept], p[kept]


def _blocks(vector: str) -> Column:
    """Blocks that hold the vectors as doubles."""
    size = 8 * F.greatest(F.max(F.size(vector)), F.lit(1))
    return F.ceil(F.count(F.lit(1)) / F.greatest(F.floor(F.lit(BLOCK_BYTES) / size), F.lit(1))).cast("int")


def _block_queries(count: int, most: int) -> int:
    """Queries of a block, of which ``most`` fit: fewer where that gives more tasks a share of the pairs."""
    return min(most, max(LEAST_QUERIES, -(-count // QUERY_BLOCKS)))


def _dealt(rows: DataFrame, queries: DataFrame, grouped: bool) -> tuple[DataFrame, DataFrame, int]:
    """Both sides with their block numbers ``_rb, _qb`` in each group ``_t``, and the most row blocks.

    A row goes to every block of queries of its group and a query to every block of rows, so each
    pair meets once. Groups without rows or without queries drop out.
    """
    rbs, qbs = _blocks("v").alias("_rbs"), _blocks("qv").alias("_qbs")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    row_block = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    query_block = lambda n: F.pmod(F.xxhash64("query_id"), n).cast("int")
    if not grouped:
        # One group: two counts in one job, and no join.
        size = F.count(F.lit(1)).alias("size")
        counts = rows.agg(F.lit("r").alias("of"), rbs.alias("n"), size).unionByName(queries.agg(F.lit("q").alias("of"), qbs.alias("n"), size))
        counts = {c["of"]: (c["n"] or 0, c["size"]) for c in counts.collect()}
        most, (parts, asked) = counts["r"][0], counts["q"]
        parts = max(parts, -(-asked // _block_queries(asked, max(asked, 1))))
        r, q = F.lit(max(most, 1)), F.lit(max(parts, 1))
        left = rows.withColumn("_rb", row_block(r)).withColumn("_qb", upto(q))
        return left, queries.withColumn("_qb", query_block(q)).withColumn("_rb", upto(r)), most
    sizes = cut_lineage(rows.groupBy("_t").agg(rbs).join(queries.groupBy("_t").agg(qbs), "_t"))
    most = sizes.agg(F.max("_rbs").alias("m")).first()["m"] or 0
    r, q = F.col("_rbs"), F.col("_qbs")
    left = rows.join(sizes, "_t").withColumn("_rb", row_block(r)).withColumn("_qb", upto(q))
    right = queries.join(sizes, "_t").withColumn("_qb", query_block(q)).withColumn("_rb", upto(r))
    return left.drop("_rbs", "_qbs"), right.drop("_rbs", "_qbs"), most


_BLOCK_KEY = ["_t", "_rb", "_qb"]


def _met(left: DataFrame, right: DataFrame, fn, schema) -> DataFrame:
    return left.groupBy(*_BLOCK_KEY).cogroup(right.groupBy(*_BLOCK_KEY)).applyInArrow(fn, schema)


def _best_in_block(id_type: pa.DataType, query_type: pa.DataType):
    """Group function: the best rows of a block for each query of a block, within its bound."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            # Ids by their order settle ties, whatever their type.
            left = left.sort_by("id")
            ids, asked = left.column("id").combine_chunks(), right.column("query_id").combine_chunks()
            rows, queries = _matrix(left.column("v")), _matrix(right.column("qv"))
            _same_length(rows, queries)
            k, bound = right.column("k").to_numpy(), right.column("bound").to_numpy()
            marks, lists = _marks(left, right)
            # A vector that cannot be measured is near to nothing.
            there = np.flatnonzero(np.isfinite(np.einsum("ij,ij->i", rows, rows)))
            asking = np.flatnonzero(np.isfinite(np.einsum("ij,ij->i", queries, queries)) & (k >= 1))
            if len(there) and len(asking):
                k = k.astype(np.int64)
                places = there[_foremost(rows[there], None if marks is None else marks[there], int(k[asking].max()))]
                block = _Nearest(rows[places], None if marks is None else marks[places])
                tile = max(1, _TILE // min(len(places), _PART_ROWS))
                for at in range(0, len(asking), tile):
                    part = asking[at : at + tile]
                    own = _seen(lists, part, marks)
                    q, p, score = block.search(queries[part], k[part], bound[part], own)
                    out["query_id"].append(asked.take(pa.array(part[q])))
                    out["vec_id"].append(ids.take(pa.array(places[p])))
                    out["score"].append(pa.array(score))
        types = {"query_id": query_type, "vec_id": id_type, "score": pa.float64()}
        return pa.table({n: pa.chunked_array(c, t) for (n, c), t in zip(out.items(), types.values())})

    return run


def _marks(left: pa.Table, right: pa.Table) -> tuple[np.ndarray | None, list | None]:
    """The number of each row's mark, and the numbers of the marks in each query's list.

    A row's mark (schema or cell) must be in the query's list; a query without a list sees all.
    """
    if "mark" not in left.column_names:
        return None, None
    coded = left.column("mark").combine_chunks().dictionary_encode(null_encoding="encode")
    code = {m: i for i, m in enumerate(coded.dictionary.to_pylist())}
    lists = [[code[m] for m in listed if m in code] if listed else None for listed in right.column("listed").to_pylist()]
    return coded.indices.to_numpy().astype(np.int64), lists


def _seen(lists: list | None, part: np.ndarray, marks: np.ndarray | None) -> np.ndarray | None:
    """Which marks each query of a tile may see: queries x marks, null when all may see all."""
    if lists is None or all(lists[i] is None for i in part):
        return None
    out = np.zeros((len(part), int(marks.max()) + 1), dtype=bool)
    for n, i in enumerate(part):
        out[n, slice(None) if lists[i] is None else lists[i]] = True
    return out


def _search(rows: DataFrame, queries: DataFrame, grouped: bool) -> DataFrame:
    """Unranked hits ``query_id, vec_id, score`` of rows ``_t, id, v[, mark]`` and queries
    ``_t, query_id, qv, k[, listed]``."""
    left, right, most = _dealt(rows, queries, grouped)
    types = rows.schema["id"].dataType, queries.schema["query_id"].dataType
    schema = T.StructType([
        T.StructField("query_id", types[1]), T.StructField("vec_id", types[0]), T.StructField("score", T.DoubleType())
    ])
    fn = _best_in_block(*(to_arrow_type(t) for t in types))
    free = right.withColumn("bound", F.lit(float("inf")))
    if most <= 1:
        return _met(left, free, fn, schema)
    if not grouped:
        return _search_cells(rows, queries, fn, schema)
    first = cut_lineage(_met(left.where("_rb = 0"), free.where("_rb = 0"), fn, schema))
    bounded = _bounded(right.where("_rb > 0"), first)
    return first.unionByName(_met(left.where("_rb > 0"), bounded, fn, schema))


def _bounded(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Queries with ``bound``, the k-th distance among the hits found; none with fewer hits."""
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    nth = found.join(queries.select("query_id", "k").distinct(), "query_id").withColumn("_n", F.row_number().over(w))
    kth = nth.where(F.col("_n") == F.col("k")).select("query_id", F.col("score").alias("_kth"))
    return queries.join(kth, "query_id", "left").withColumn("bound", F.coalesce("_kth", F.lit(float("inf")))).drop("_kth")


class Cells:
    """Pivots with the rows and the radius of their cells, and the blocks that hold them; small arrays only."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.rows, self.radius = np.zeros(len(pivots), dtype=np.int64), np.zeros(len(pivots))

    def distances(self, m: np.ndarray) -> np.ndarray:
        _same_length(self.pivots, m)
        squares = np.einsum("ij,ij->i", self.pivots, self.pivots)[None, :] + np.einsum("ij,ij->i", m, m)[:, None]
        return np.sqrt(np.maximum(squares - 2.0 * m @ self.pivots.T, 0.0))

    def nearest(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance of each row; one that cannot be measured is as far as can be."""
        d = self.distances(m)
        d = np.where(np.isfinite(d), d, np.inf)
        cell = d.argmin(axis=1)
        return cell.astype(np.int32), d[np.arange(len(m)), cell]

    def first(self, d: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The nearest cells of queries at these distances, until they hold k rows: queries x cells."""
        order = np.argsort(np.where(self.rows > 0, d, np.inf), axis=1, kind="stable")
        held = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        out = np.zeros(d.shape, dtype=bool)
        np.put_along_axis(out, order, held < np.maximum(k, 1)[:, None], axis=1)
        return out & (self.rows > 0)

    def within(self, d: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The cells that may hold a row within the bounds of queries: queries x cells."""
        radius = np.where(np.isfinite(self.radius), self.radius, 0.0)
        # Distances are rounded, by more where vectors are long, so a cell must be out of reach by more than that.
        slack = 1e-6 * (1.0 + d + radius + np.sqrt(np.einsum("ij,ij->i", self.pivots, self.pivots).max()))
        nearest = np.maximum(d - self.radius - slack, 0.0)
        return (self.rows > 0) & ~(nearest * nearest > bound[:, None])


def _dealing(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First block and number of blocks of each cell: neighbours share one, a crowded cell has its own."""
    first, many, at, held = np.zeros(len(counts), np.int32), np.ones(len(counts), np.int32), 0, 0
    for c, n in enumerate(counts.tolist()):
        need = max(1, -(-n // most))
        if held and held + n > most:
            at, held = at + 1, 0
        first[c], many[c] = at, need
        at, held = (at + need, 0) if need > 1 else (at, held + n)
    return first, many, at + 1


def _in_line(pivots: np.ndarray) -> np.ndarray:
    """Pivots along their main direction, so that cells with neighbouring numbers are mostly near."""
    if len(pivots) < 3:
        return pivots
    centred = pivots - pivots.mean(axis=0)
    direction = np.linalg.svd(centred, full_matrices=False)[2][0]
    return pivots[np.argsort(centred @ direction, kind="stable")]


def _search_cells(rows: DataFrame, queries: DataFrame, fn, schema: T.StructType) -> DataFrame:
    """The search over cells, in two waves; see the head of this module."""
    sample = rows.select("v").orderBy(F.xxhash64("id"), "id").limit(PIVOTS)
    width = rows.agg(F.max(F.size("v")).alias("w"), F.count(F.lit(1)).alias("n")).first()
    most = max(1, BLOCK_BYTES // (8 * max(1, width["w"])))
    pivots = _matrix(sample.limit(max(2, min(PIVOTS, BLOCK_CELLS * width["n"] // most))).toArrow().column("v"))
    finite = pivots[np.isfinite(pivots).all(axis=1)]
    cells = Cells(_in_line(finite if len(finite) else np.zeros_like(pivots[:1])))

    def place(vector: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    cell, far = cells.nearest(_matrix(b.column(b.schema.get_field_index(vector))))
                    yield pa.RecordBatch.from_arrays(
                        [*b.columns, pa.array(cell), pa.array(far)], names=[*b.schema.names, "_cell", "_far"]
                    )

        return run

    def placed(df: DataFrame, vector: str) -> tuple[DataFrame, list]:
        fields = [T.StructField("_cell", T.IntegerType()), T.StructField("_far", T.DoubleType())]
        out = cut_lineage(df.mapInArrow(place(vector), T.StructType([*df.schema.fields, *fields])))
        # At most one row for each pivot.
        return out, out.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_far").alias("far")).collect()

    corpus, held = placed(rows, "v")
    asked, parts = placed(queries, "qv")
    in_part = np.zeros(len(cells.rows), dtype=np.int64)
    for r in held:
        cells.rows[r["_cell"]], cells.radius[r["_cell"]] = r["n"], r["far"]
    for r in parts:
        in_part[r["_cell"]] = r["n"]
    row_first, row_many, _ = _dealing(cells.rows, most)
    query_first, query_many, _ = _dealing(in_part, _block_queries(int(in_part.sum()), most))

    def block(first: np.ndarray, many: np.ndarray, name: str) -> Column:
        """Block of a row by its cell, as one lookup in two short arrays."""
        cell = F.col("_cell")
        lookup = lambda x: F.element_at(F.array(*[F.lit(int(v)) for v in x]), cell + 1)
        return (lookup(first) + F.pmod(F.xxhash64(name), lookup(many))).cast("int")

    left = corpus.withColumn("_rb", block(row_first, row_many, "id")).drop("_cell", "_far")
    right = asked.withColumn("_qb", block(query_first, query_many, "query_id")).drop("_cell", "_far")

    # Which blocks hold rows of a cell; a crowded one has several.
    holds = np.zeros((len(cells.rows), int((row_first + row_many).max())), dtype=np.float32)
    for c, (lo, n) in enumerate(zip(row_first, row_many)):
        holds[c, lo : lo + n] = 1.0

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            names = b.schema.names
            d = cells.distances(_matrix(b.column(names.index("qv"))))
            d = np.where(np.isfinite(d), d, 0.0)
            k, bound = b.column(names.index("k")).to_numpy(), b.column(names.index("bound")).to_numpy()
            blocks = cells.first(d, k).astype(np.float32) @ holds > 0
            later = bound >= 0
            blocks[later] = (cells.within(d[later], bound[later]).astype(np.float32) @ holds > 0) & ~blocks[later]
            at, to = np.nonzero(blocks)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(pa.array(at)) for c in b.columns), pa.array(to, pa.int32())], names=[*names, "_rb"]
                )

    def wave(df: DataFrame) -> DataFrame:
        routed = cut_lineage(df.mapInArrow(route, T.StructType([*df.schema.fields, T.StructField("_rb", T.IntegerType())])))
        routed = routed.withColumn("bound", F.when(F.col("bound") < 0, float("inf")).otherwise(F.col("bound")))
        pairs = routed.select(F.col("_rb").alias("_b"), F.col("_qb").alias("_q")).distinct()
        met = left.join(pairs, left["_rb"] == pairs["_b"]).drop("_b").withColumnRenamed("_q", "_qb")
        return _met(met, routed, fn, schema)

    # The first wave has no bound, which a negative one stands for.
    first = cut_lineage(wave(right.withColumn("bound", F.lit(-1.0))))
    return first.unionByName(wave(_bounded(right, first)))


def _ranked(hits: DataFrame, queries: DataFrame, k: int | None) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out = hits.withColumn("rank", F.row_number().over(w))
    if k is not None:
        return out.where(F.col("rank") <= k)
    return out.join(queries.select("query_id", "k"), "query_id").where(F.col("rank") <= F.col("k")).drop("k")


def _group(by: list[str]) -> Column:
    return F.to_json(F.struct(*by)) if by else F.lit("")


def knn_batch(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str | Column = "vec_id",
    vector_col: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    by: list[str] = (),
    k_col: str | None = None,
    listed: str | None = None,
    mark: str = "schema_name",
) -> DataFrame:
    """Exact k nearest rows of every query: ``query_id, vec_id, score, rank``.

    ``by`` names columns of both frames that must be equal, such as tenant and provider. ``k_col`` is
    a column of the queries with a k of their own. ``listed`` is an array column of the queries: only
    rows whose ``mark`` is in it are seen; an empty or null list sees all. Ids may be of any type
    with an order, also an expression over several columns; query ids must be unique. Vectors of
    different lengths are an error, null vectors take no part.
    """
    id_ = F.col(id_col) if isinstance(id_col, str) else id_col
    rows = corpus.where(F.col(vector_col).isNotNull()).select(
        _group(list(by)).alias("_t"), id_.alias("id"), F.col(vector_col).alias("v"),
        *([F.col(mark).alias("mark")] if listed else []),
    )
    asked = queries.where(F.col(query_vector).isNotNull()).select(
        _group(list(by)).alias("_t"), F.col(query_id).alias("query_id"), F.col(query_vector).alias("qv"),
        (F.col(k_col) if k_col else F.lit(k)).cast("int").alias("k"), *([F.col(listed).alias("listed")] if listed else []),
    )
    return _ranked(_search(rows, asked, bool(by)), asked, None if k_col else k)


def fit_cells(
    corpus: DataFrame, cells: int = 16, vector_col: str = "embedding", seed: int = 7, rounds: int = 10
) -> np.ndarray:
    """Centres of a k-means partition of the given rows (``cells`` x dimension numbers).

    The centres only steer the search, so they may be fitted on a part of a very large corpus.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = corpus.where(F.col(vector_col).isNotNull()).select(
        array_to_vector(F.col(vector_col).cast("array<double>")).alias("features")
    )
    model = KMeans(k=cells, seed=seed, maxIter=rounds).fit(points)
    return np.asarray(model.clusterCenters())


def assign_cells(
    corpus: DataFrame, centers: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Rows ``id, v, cell`` with the nearest centre; nothing is shuffled.

    Written with ``partitionBy("cell")`` once, later searches read only the probed folders.
    """
    norms = np.einsum("ij,ij->i", centers, centers)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = norms[None, :] - 2.0 * _matrix(b.column(1)) @ centers.T
                cell = pa.array(np.argmin(d, axis=1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), cell], names=["id", "v", "cell"])

    rows = corpus.where(F.col(vector_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")
    )
    return rows.mapInArrow(assign, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())]))


def knn_approx(
    placed: DataFrame,
    queries: DataFrame,
    centers: np.ndarray,
    k: int = 10,
    probes: int = 4,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
) -> DataFrame:
    """Approximate k nearest rows: each query is compared with its nearest cells only.

    ``placed`` comes from ``assign_cells``. Rows stay where they are, so a crowded cell is spread
    over all tasks that hold a part of it. A query whose cells hold fewer than k rows is
    searched again exactly.
    """
    norms = np.einsum("ij,ij->i", centers, centers)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = np.argsort(norms[None, :] - 2.0 * _matrix(b.column(1)) @ centers.T, axis=1)[:, :probes]
                lists = pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], names=["query_id", "qv", "listed"])

    asked = queries.where(F.col(query_vector).isNotNull()).select(
        F.col(query_id).cast("long").alias("query_id"), F.col(query_vector).alias("qv")
    )
    fields = [*asked.schema.fields, T.StructField("listed", T.ArrayType(T.IntegerType()))]
    # A query goes to the cells it probes; within a cell, blocks meet as in the exact search.
    probed = asked.mapInArrow(probe, T.StructType(fields)).select(
        F.explode(F.col("listed").cast("array<string>")).alias("_t"), "query_id", "qv", F.lit(k).alias("k")
    )
    rows = placed.select(F.col("cell").cast("string").alias("_t"), "id", "v")
    found = cut_lineage(_ranked(_search(rows, probed, True), probed, k))
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    short = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(query_vector).alias("query_vector")).join(
        full, "query_id", "left_anti"
    )
    exact = knn_batch(placed, short, k, "id", "v")
    return found.join(full, "query_id", "left_semi").unionByName(exact)


def rank_explain(
    corpus: DataFrame,
    targets: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    first: int = 0,
) -> DataFrame:
    """Why a target missed the top: its rank, distance, gap to rank 1 and the population.

    ``targets`` has ``query_id, query_vector, target_id``. The rank is one more than the number
    of rows that come before the target, so tasks only count and no full order is built. ``first``
    adds the ids of the first hits in order. Filter the corpus for the schemas that count.
    """
    own = corpus.select(F.col(id_col).alias("target_id"), F.col(vector_col).alias("_tv"))
    aimed = targets.join(own, "target_id", "left")
    rows = corpus.where(F.col(vector_col).isNotNull()).select(
        F.lit("").alias("_t"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")
    )
    asked = aimed.select(
        F.lit("").alias("_t"), F.col("query_id").cast("long").alias("query_id"), F.col("query_vector").alias("qv"),
        F.col("target_id").cast("long").alias("target_id"),
        F.round(V.squared_distance(F.col("query_vector"), F.col("_tv")), V.DISTANCE_DECIMALS).alias("target_score"),
    )
    schema = "query_id long, target_id long, target_score double, ahead long, seen long, nearest double"
    left, right, _ = _dealt(rows, asked, False)
    out = _met(left, right, _count_ahead, schema)
    # A target that is not in the corpus has no distance.
    there = F.col("target_score").isNotNull() & ~F.isnan("target_score")
    ranks = (
        out.groupBy("query_id", "target_id", "target_score")
        .agg(F.sum("ahead").alias("_a"), F.sum("seen").alias("population"), F.min("nearest").alias("_m"))
        .select(
            "query_id",
            "target_id",
            F.when(there, F.col("target_score")).alias("target_score"),
            F.when(there, F.col("_a") + 1).alias("target_rank"),
            F.when(there, F.round(F.col("target_score") - F.col("_m"), V.DISTANCE_DECIMALS)).alias("gap"),
            "population",
        )
    )
    if not first:
        return ranks
    hits = knn_batch(corpus, targets.select("query_id", "query_vector").dropDuplicates(["query_id"]), first, id_col, vector_col)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda h: h["vec_id"])
    return ranks.join(hits.groupBy("query_id").agg(listed.alias("first_hits")), "query_id", "left")


def _count_ahead(left: pa.Table, right: pa.Table) -> pa.Table:
    """Group function: how many rows of a block come before each query's target."""
    target = right.column("target_id").to_numpy()
    score = right.column("target_score").to_numpy().astype(np.float64)
    ahead, nearest = np.zeros(right.num_rows, dtype=np.int64), np.full(right.num_rows, np.inf)
    if left.num_rows and right.num_rows:
        rows, queries = _matrix(left.column("v")), _matrix(right.column("qv"))
        _same_length(rows, queries)
        norms = np.einsum("ij,ij->i", queries, queries)
        ids = left.column("id").to_numpy()[None, :]
        tile = max(1, _TILE // len(rows))
        for at in range(0, right.num_rows, tile):
            part = slice(at, at + tile)
            d = _distances(rows, queries[part], norms[part])
            aim, goal = target[part, None], score[part, None]
            before = (d < goal) | ((d == goal) & (ids < aim))
            ahead[part] = (before & (ids != aim)).sum(axis=1)
            nearest[part] = d.min(axis=1)
    return pa.table({
        "query_id": right.column("query_id"), "target_id": right.column("target_id"),
        "target_score": right.column("target_score"), "ahead": ahead,
        "seen": np.full(right.num_rows, left.num_rows, dtype=np.int64), "nearest": nearest,
    })


def centroid(df: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Mean vector of a frame, as one row: one partial mean per part and task."""
    parts = df.select(F.posexplode(vector_col).alias("p", "x")).groupBy("p").agg(F.avg("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("p", "x")))
    return parts.agg(F.transform(ordered, lambda s: s["x"]).alias("centroid"))


def group_centroids(df: DataFrame, by: str, vector_col: str = "embedding") -> DataFrame:
    """Mean vector per group."""
    parts = df.select(by, F.posexplode(vector_col).alias("p", "x")).groupBy(by, "p").agg(F.avg("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("p", "x")))
    return parts.groupBy(by).agg(F.transform(ordered, lambda s: s["x"]).alias("centroid"))


def hits_with_cards(hits: DataFrame, cards: DataFrame, key: list[str]) -> DataFrame:
    """Hits with the full record of each; the rank column keeps the order."""
    return hits.join(cards, key)
