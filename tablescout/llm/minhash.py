"""Near-duplicate documents: weighted DartMinHash signatures, banded join, exact check.

A document is the multiset of its five-word shingles. Darts are thrown at the region of each shingle
in the plane of weight and rank: the places are hashes of the shingle, so documents that share it
share its darts. A dart counts when it lies below the shingle's weight; of the darts at a coordinate
the earliest by rank is kept. Two documents agree at a coordinate with probability equal to
their weighted Jaccard similarity. Work follows the darts thrown (about ``k ln k + 2k`` for ``k``
coordinates, whatever the length), not shingles times coordinates.

Documents with the same words are one node of the graph; only nodes are compared. Nodes that agree
on all coordinates of a band share a bucket. Every link is checked on the whole multisets:

1. each node of a bucket with the bucket's hub, which joins most of every group at linear cost;
2. where a bucket still holds several components, all pairs across components, in blocks.

So the components are those of all pairs that share a bucket, and no pair within a component is
listed. Every bucket is split into blocks of bounded size before it reaches a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescout.llm import textbytes as B
from tablescout.llm.common import fresh, stored
from tablescout.llm.graph import components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: A pair at the threshold shares no bucket with probability (1 - 0.8**6)**32, 6 in 100,000.
BANDS, ROWS = 32, 6
#: Members of a bucket or hub that are checked in one task, and words of all of them together; a task
#: holds more only where one text is longer.
BLOCK, BLOCK_WORDS = 512, 500_000
_CHUNK = 512 * 1024
_C = [np.uint64(int(x) | 1) for x in B.mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))]


def shingles(texts: pa.Array, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, shingle)`` of all shingles in order, and two 64-bit content hashes per text.

    Words are runs without white space, in small letters. A text of fewer words than a shingle
    has one shingle of all its words; a text without words has none.
    """
    data, offsets = B.buffer_of(texts)
    data = B.lowered(data)
    start, end, first = B.words(data, offsets)
    count = np.diff(first)
    word = B.RangeHash(data).of(start, end)
    n = len(word)
    nth = np.arange(n) - np.repeat(first[:-1], count)
    content = np.zeros((len(count), 2), dtype=np.uint64)
    for i, base in enumerate((_C[40], _C[41])):
        if n:
            powers = np.full(int(count.max()), base, dtype=np.uint64)
            powers[:1] = 1
            terms = B.mix(word + _C[42 + i]) * np.cumprod(powers)[nth]
            sums = np.add.reduceat(np.append(terms, np.uint64(0)), first[:-1])
            content[:, i] = B.mix(np.where(count > 0, sums, 0).astype(np.uint64) + count.astype(np.uint64))
    total = np.zeros(n, dtype=np.uint64)
    size = np.repeat(count, count)
    for j in range(width):
        there = np.flatnonzero(nth + j < size)
        total[there] += word[there + j] * _C[j]
    here = np.flatnonzero((nth + width <= size) | (nth == 0))
    total = B.mix(total + np.minimum(size, width).astype(np.uint64))
    return np.repeat(np.arange(len(count)), count)[here], total[here], content


def weighted(text: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their counts, sorted by text and shingle."""
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(new)
    return text[at], shingle[at], np.diff(np.append(at, len(text)))


def _unit(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers over 0, at most 1."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1.0) / float(1 << 53)


def dart_signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, k: int) -> np.ndarray:
    """``texts x k`` dart ids; texts must have one shingle at least, rows sorted by text.

    Ranks run up to a bound that gives a text about ``k ln k + 2k`` darts; texts with a coordinate
    left empty are thrown again with twice the bound, which changes no dart found before.
    """
    signature = np.zeros((texts, k), dtype=np.uint64)
    total = np.bincount(text, weights=weight, minlength=texts)
    todo = np.flatnonzero(total > 0)
    bound = (k * np.log(k) + 2 * k) / np.maximum(total, 1)
    while len(todo):
        place = np.full(texts, -1)
        place[todo] = np.arange(len(todo))
        own = np.flatnonzero(place[text] >= 0)
        best, found = _throw(place[text[own]], shingle[own], weight[own], bound[todo], len(todo), k)
        full = np.isfinite(best).all(axis=1)
        signature[todo[full]] = found[full]
        todo = todo[~full]
        bound[todo] *= 2
    return signature


def _throw(text, shingle, weight, bound, texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    best = np.full(texts * k, np.inf)
    found = np.zeros(texts * k, dtype=np.uint64)
    # Regions of weight: 0 to 1, then 1 to 2, 2 to 4, and so on; darts of a region are the same
    # for every weight that reaches into it.
    low, width, region = 0, 1, 0
    most = int(weight.max()) if len(weight) else 0
    while low < most:
        own = np.flatnonzero(weight > low)
        state = [text[own], shingle[own] + np.uint64(int(_C[20]) * region % (1 << 64)), weight[own], np.zeros(len(own))]
        nth, step = 0, 1
        while len(state[0]):
            t, seed, w, rank = state
            dart = B.mix(seed[:, None] + _C[21] * np.arange(nth + 1, nth + step + 1, dtype=np.uint64)[None, :])
            # Gaps between the ranks of a region's darts are exponential with its width as rate.
            ranks = rank[:, None] + np.cumsum(-np.log(_unit(B.mix(dart ^ _C[22]))), axis=1) / width
            inside = ranks <= bound[t][:, None]
            height = low + width * _unit(B.mix(dart ^ _C[23]))
            row, col = np.nonzero(inside & (height <= w[:, None]))
            ids, r = dart[row, col], ranks[row, col]
            key = t[row] * k + (B.mix(ids ^ _C[24]) % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, key, r)
            first = best[key] == r
            found[key[first]] = ids[first]
            on = np.flatnonzero(inside[:, -1])
            state = [t[on], seed[on], w[on], ranks[on, -1]]
            nth, step = nth + step, min(step if nth < 3 else 2 * step, 256)
        low, width, region = low + width, max(1, low + width), region + 1
    return best.reshape(texts, k), found.reshape(texts, k)


def _binary(hashes: np.ndarray) -> pa.Array:
    """Rows of two 64-bit numbers as 16-byte values."""
    raw = pa.py_buffer(np.ascontiguousarray(hashes).astype("<u8").tobytes())
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(hashes), [None, raw]).cast(pa.binary())


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, some in B.chunks(b.column(1), _CHUNK):
                text, shingle, content = shingles(some)
                n = len(some)
                has = np.zeros(n, dtype=bool)
                has[text] = True
                signature = dart_signatures(*weighted(text, shingle), n, bands * rows).reshape(n, bands, rows)
                keys = np.zeros((n, bands), dtype=np.uint64)
                for j in range(rows):
                    keys += signature[:, :, j] * _C[j]
                keys = B.mix(keys + _C[30] * np.arange(bands, dtype=np.uint64)[None, :]).view(np.int64)
                none = pa.array(~has)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1))
                )
                node = pa.compute.if_else(none, pa.scalar(None, pa.binary()), _binary(content))
                lists = pa.compute.if_else(none, pa.scalar(None, lists.type), lists)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, n), b.column(2).slice(at, n), node, lists],
                    names=["doc_id", "text_hash", "node", "bands"],
                )

    return run


def _elements():
    """Task function: each text's multiset as sorted distinct numbers, the n-th copy its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, some in B.chunks(b.column(0), _CHUNK):
                text, shingle, content = shingles(some)
                text, shingle, count = weighted(text, shingle)
                nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                each = B.mix(np.repeat(shingle, count) + _C[25] * nth.astype(np.uint64))
                size = np.bincount(np.repeat(text, count), minlength=len(some))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(each.view(np.int64))
                )
                yield pa.RecordBatch.from_arrays([_binary(content), lists], names=["node", "elements"])

    return run


def _alike(threshold: float):
    """Group function: links between the two sides of a task, or within one side.

    Rows are ``task, side, node, component, elements``. Side 0 is held against sides 0 and 1, side 1
    never against itself; pairs of one component are left out, and a link between two components
    is given once.
    """

    def run(rows: pa.Table) -> pa.Table:
        side = rows.column("side").to_numpy()
        node, comp = rows.column("node").to_pylist(), rows.column("component").to_pylist()
        lists = rows.column("elements").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        _, values = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        begin = np.cumsum(size) - size
        number = {c: i for i, c in enumerate(dict.fromkeys(comp))}
        group = np.array([number[c] for c in comp])
        flag = np.zeros(len(values) + 1, dtype=np.int64)
        links, joined = [], set()
        for i in np.flatnonzero(side == 0):
            mine = values[begin[i] : begin[i] + size[i]]
            flag[mine] = 1
            common = np.add.reduceat(flag[values], begin)
            flag[mine] = 0
            ok = (common >= threshold * (size[i] + size - common) - 1e-9) & (group != group[i])
            for j in np.flatnonzero(ok):
                pair = (group[i], group[j]) if group[i] < group[j] else (group[j], group[i])
                if pair not in joined:
                    joined.add(pair)
                    links.append((comp[i], comp[j]))
        return pa.table(
            {"a": pa.array([x[0] for x in links], pa.binary()), "b": pa.array([x[1] for x in links], pa.binary())}
        )

    return run


def _check(tasks: DataFrame, elements: DataFrame, threshold: float) -> DataFrame:
    """Links ``a, b`` between components, from rows ``task, part, side, node, component``."""
    rows = tasks.join(elements.select("node", "elements"), "node")
    return (
        rows.select("task", "part", "side", "node", "component", "elements")
        .groupBy("task", "part").applyInArrow(_alike(threshold), "a binary, b binary")
    )


def _blocks(n: Column, words: Column) -> Column:
    return F.ceil(F.greatest(n / F.lit(BLOCK), words / F.lit(BLOCK_WORDS))).cast("int")


def _star_tasks(members: DataFrame, buckets: DataFrame, elements: DataFrame) -> DataFrame:
    """Every node with the hub of each of its buckets, once per hub."""
    pairs = members.join(buckets, "bucket").where("node != hub").select("hub", "node").distinct()
    pairs = stored(pairs, "near-hubs")
    many = pairs.join(elements.select("node", "words"), "node").groupBy("hub").agg(
        _blocks(F.count(F.lit(1)), F.sum("words")).alias("parts")
    )
    many = stored(many, "near-hub-parts")
    # The hub stands on side 0 of each part.
    hubs = many.select(
        F.col("hub").alias("task"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.lit(0).alias("side"), F.col("hub").alias("node"), F.col("hub").alias("component"),
    )
    # Few hubs have more than a block of members, so looking these up seldom moves the pairs.
    others = pairs.join(many.where("parts > 1"), "hub", "left").select(
        F.col("hub").alias("task"),
        F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"),
        F.lit(1).alias("side"), "node", F.col("node").alias("component"),
    )
    return hubs.unionByName(others)


def _rest_tasks(members: DataFrame, elements: DataFrame) -> DataFrame:
    """Blocks of the buckets that hold several components, so that all pairs across them meet.

    The largest component of a bucket is never held against itself.
    """
    sizes = members.join(elements.select("node", "words"), "node").groupBy("bucket", "component").agg(
        F.count(F.lit(1)).alias("n"), F.sum("words").alias("words")
    )
    split = (
        sizes.groupBy("bucket")
        .agg(
            F.max(F.struct("n", "component", "words")).alias("top"), F.sum("n").alias("n"), F.sum("words").alias("words"),
            F.count(F.lit(1)).alias("parts"),
        )
        .where("parts > 1")
        .select(
            "bucket", F.col("top.component").alias("main"),
            _blocks(F.col("n") - F.col("top.n"), F.col("words") - F.col("top.words")).alias("few"),
            _blocks(F.col("top.n"), F.col("top.words")).alias("many"),
        )
    )
    rows = members.join(split, "bucket")
    main, few, many = F.col("component") == F.col("main"), F.col("few"), F.col("many")
    own = F.when(main, few + F.pmod(F.xxhash64("node"), many)).otherwise(F.pmod(F.xxhash64("node"), few)).cast("int")
    rows = rows.withColumn("own", own)
    # Block x meets block y in task (x, y), x <= y; blocks of the largest component meet the others only.
    meets = F.when(main, F.sequence(F.lit(0), few - 1)).otherwise(F.sequence(F.lit(0), few + many - 1))
    met = rows.select("bucket", "node", "component", "own", F.explode(meets).alias("with"))
    return met.select(
        F.col("bucket").alias("task"),
        F.concat_ws(":", F.least("own", "with"), F.greatest("own", "with")).alias("part"),
        (F.col("own") > F.col("with")).cast("int").alias("side"), "node", "component",
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """One row per document: ``doc_id, text_hash, node, component, component_id, kept``.

    ``component_id`` is the least id of the documents reachable by links of weighted Jaccard
    similarity at or over the threshold, over whole texts; ``kept`` marks the rows that bear it, several
    where rows share that id. ``node`` is the content hash of the text's words, ``component`` one of its
    group's, so it tells groups with the same least id apart. Documents with the same words are always together.

    Null and empty texts, and texts without a word, link with nothing and are kept. Repeated rows have
    equal results. Null ids never name a component unless all its ids are null. An empty table gives
    no rows; other columns are not read.
    """
    chosen = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
        F.xxhash64(text_col).alias("text_hash"),
    )
    signed = stored(
        chosen.mapInArrow(_sign(bands, rows), "doc_id long, text_hash long, node binary, bands array<long>"), "near-signed"
    )
    # The row that stands for a node: least id, null last, then least hash.
    at = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    nodes = signed.where("node is not null").groupBy("node").agg(at.alias("at"), F.min("bands").alias("bands")).select(
        "node", F.col("at.doc_id").alias("first"), F.col("at.text_hash").alias("hash"), "bands"
    )
    placed = stored(nodes.select("node", "first", "hash", F.explode("bands").alias("bucket")), "near-bands")
    # The hub is the least by a hash that differs between a few kinds of buckets.
    by = F.xxhash64("node", F.pmod("bucket", F.lit(4)))
    buckets = (
        placed.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(by.alias("h"), "node")).alias("hub"))
        .where("n > 1").select("bucket", F.col("hub.node").alias("hub"))
    )
    buckets = stored(buckets, "near-buckets")
    members = stored(placed.join(buckets.select("bucket"), "bucket").select("bucket", "node", "first", "hash"), "near-members")
    # By id and text, so that the rows of one id, or of none, are spread.
    wanted = members.select("first", "hash").distinct()
    same = chosen["doc_id"].eqNullSafe(wanted["first"]) & (chosen["text_hash"] == wanted["hash"])
    texts = chosen.join(wanted.hint("shuffle_hash"), same, "left_semi")
    elements = stored(
        texts.select("text").mapInArrow(_elements(), "node binary, elements array<long>")
        .join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
        .select("node", F.size("elements").alias("words"), "elements"),
        "near-elements",
    )
    members = members.select("bucket", "node")
    star = stored(_check(_star_tasks(members, buckets, elements), elements, similarity), "near-star")
    named = components(star, "near-star")
    labelled = members.join(named, "node", "left").select(
        "bucket", "node", F.coalesce("component", "node").alias("component")
    )
    rest = stored(_check(_rest_tasks(stored(labelled, "near-labelled"), elements), elements, similarity), "near-rest")
    upper = components(rest, "near-rest").select(F.col("node").alias("component"), F.col("component").alias("top"))
    # Components of components; nodes without links are their own.
    all_nodes = nodes.select("node", "first").join(named, "node", "left").select(
        "node", "first", F.coalesce("component", "node").alias("component")
    )
    final = stored(
        all_nodes.join(upper, "component", "left").select("node", "first", F.coalesce("top", "component").alias("top")),
        "near-final",
    )
    least = final.groupBy("top").agg(F.min("first").alias("component_id"))
    classes = final.join(least, "top").select("node", F.col("top").alias("component"), "component_id")
    return signed.select("doc_id", "text_hash", "node").join(classes, "node", "left").select(
        "doc_id", "text_hash", "node", "component",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with one document of each group; all columns stay.

    That is one row of the least id, null last; of rows with that id, the least by the hashes of the text
    and of the row. Rows without a word all stay.
    """
    id_, hash_, nth = fresh(docs, "_near_id", "_near_hash", "_near_nth")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    kept = (
        near_duplicates(docs, id_col, text_col, **options).where("component IS NOT NULL").groupBy("component")
        .agg(least.alias("at")).select(F.col("at.doc_id").alias(id_), F.col("at.text_hash").alias(hash_)).distinct()
    )
    worded = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    some = docs.where(worded)
    same = some[id_col].cast("long").eqNullSafe(kept[id_]) & (F.xxhash64(some[text_col]) == kept[hash_])
    first = F.row_number().over(Window.partitionBy(id_, hash_).orderBy(F.xxhash64(*[some[c] for c in docs.columns])))
    one = some.join(kept.hint("shuffle_hash"), same).withColumn(nth, first).where(F.col(nth) == 1).select(*docs.columns)
    return docs.where(~worded).unionByName(one)
