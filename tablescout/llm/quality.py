"""Document quality by voting of the nearest labelled documents in a latent-semantic space.

A text is described by how often its byte triples and its neighbouring word shapes occur (a shape
notes capitals, digits, marks at the end, length, and whether the word repeats the one before). A
bounded sample of labelled documents gives the weights of these terms and, by a truncated singular
value decomposition, the latent directions. Its vectors and labels are broadcast, at most
``LABELLED`` rows of ``LATENT`` numbers. Every document is then held against all of them by exact
cosine, block by block, and the labels of the nearest vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.llm import textbytes as B
from tablescout.llm.common import fresh, held_out

#: Most labelled documents that a model learns from; taken by the hash of their ids.
LABELLED = 4000
LATENT = 48
NEIGHBOURS = 15
TRIPLES, SHAPES = 2048, 256
#: Bytes and rows that are described and held against the labelled rows at a time; the arrays take some
#: dozens of bytes for each byte and about 70 KB for each row, however short its text.
_CHUNK, _ROWS = 256 * 1024, 128
_CLASS = np.zeros(256, dtype=np.uint8)  # 0 mark, 1 small letter, 2 capital, 3 digit
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3


def _shares(key: np.ndarray, n: int, width: int) -> np.ndarray:
    """Square roots of each text's term shares, so that every row has length 1 (or 0)."""
    counts = np.bincount(key, minlength=n * width).reshape(n, width).astype(np.float32)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1.0))


def features(texts: pa.Array) -> np.ndarray:
    """``texts x (TRIPLES + SHAPES)`` term shares."""
    data, offsets = B.buffer_of(texts)
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    out = np.zeros((n, TRIPLES + SHAPES), dtype=np.float32)
    if len(data) >= 3:
        d = data.astype(np.uint32)
        triple = (d[:-2] << 16 | d[1:-1] << 8 | d[2:]) * np.uint32(0x9E3779B1)
        bucket = (triple >> np.uint32(21)).astype(np.int64)
        own = doc[:-2] == doc[2:]
        out[:, :TRIPLES] = _shares((doc[:-2] * TRIPLES + bucket)[own], n, TRIPLES)
    start, end, first = B.words(data, offsets)
    if len(start):
        of = np.repeat(np.arange(n), np.diff(first))
        word = B.RangeHash(data).of(start, end)
        kind = _CLASS[data]
        head, tail = kind[start], kind[end - 1]
        before_tail = kind[np.maximum(end - 2, start)]
        length = np.minimum(np.log2(end - start + 0.5).astype(np.int64), 3)
        same = np.zeros(len(word), dtype=np.int64)
        same[1:] = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
        # 0 plain, 1 one mark at the end, 2 several marks, 3 capital or digit at the end
        ending = np.where(tail == 0, np.where(before_tail == 0, 2, 1), np.where(tail >= 2, 3, 0))
        shape = (head.astype(np.int64) * 4 + ending) * 4 + length
        shape = B.mix((shape * 2 + same).astype(np.uint64) + np.uint64(7))
        pair = shape.copy()
        pair[1:] += np.where(of[1:] == of[:-1], shape[:-1], 0) * np.uint64(3)
        both = np.concatenate([of * SHAPES + (shape % np.uint64(SHAPES)).astype(np.int64),
                               of * SHAPES + (B.mix(pair) % np.uint64(SHAPES)).astype(np.int64)])
        out[:, TRIPLES:] = _shares(both, n, SHAPES)
    return out


class Model(NamedTuple):
    weight: np.ndarray  # of each term
    directions: np.ndarray  # terms x latent
    vectors: np.ndarray  # labelled rows x latent, of length 1
    labels: np.ndarray


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def learn(terms: np.ndarray, labels: np.ndarray, latent: int = LATENT, seed: int = 5) -> Model:
    """Weights, directions and labelled vectors of a sample; every step is in numpy."""
    share = (terms > 0).mean(axis=0)
    weight = np.log((1.0 + 1.0) / (share + 1e-3)).astype(np.float32)
    x = terms * weight
    latent = min(latent, *x.shape)
    # Randomised decomposition with power steps.
    rng = np.random.default_rng(seed)
    q = rng.standard_normal((x.shape[1], latent + 8)).astype(np.float32)
    for _ in range(5):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    directions = (q @ v.T[:, :latent]).astype(np.float32)
    return Model(weight, directions, _unit(x @ directions).astype(np.float32), labels.astype(np.float32))


def vote(model: Model, terms: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Share of label 1 among the k nearest labelled rows, weighted by cosine.

    A row without any term is near to none, and gets the share of label 1 among all labelled rows.
    """
    mine = _unit((terms * model.weight) @ model.directions).astype(np.float32)
    near = mine @ model.vectors.T
    k = min(k, near.shape[1])
    at = np.argpartition(-near, k - 1, axis=1)[:, :k]
    # A high power of the cosine, so that the nearest count most.
    weight = np.clip(np.take_along_axis(near, at, axis=1).astype(np.float64), 1e-6, 1.0) ** 8
    out = (weight * model.labels[at]).sum(axis=1) / weight.sum(axis=1)
    return np.where(terms.any(axis=1), np.clip(out, 0.0, 1.0), float(model.labels.mean()))


def fit(
    docs: DataFrame, labels: DataFrame, bound: int = LABELLED, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality",
) -> Model:
    """Learn from at most ``bound`` labelled documents that are not held out.

    They are those with the least hashes of their ids, so a rerun takes the same. Labels that are
    null or belong to no document with a text are skipped and take no place of the bound. Only the terms of the sample reach the driver:
    ``bound`` rows of fixed width.
    """
    known = (
        labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    )
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    chosen = known.join(texts.select("id"), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(bound)
    # The limit bounds this side.
    rows = texts.join(F.broadcast(chosen), "id")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, some in B.chunks(b.column(1), _CHUNK, _ROWS):
                f = features(some).astype(np.float16)
                packed = pa.array([r.tobytes() for r in f], pa.binary())
                ids, marks = b.column(0).slice(at, len(some)), b.column(2).slice(at, len(some))
                yield pa.RecordBatch.from_arrays([ids, packed, marks], names=["id", "terms", "label"])

    got = rows.select("id", "text", "label").mapInArrow(terms, "id long, terms binary, label int")
    # Copies of a document may repeat an id; the bound holds for rows too.
    got = got.orderBy(F.xxhash64("id"), "id", "terms").limit(bound).collect()
    if not got:
        width = TRIPLES + SHAPES
        zero = np.zeros((width, 1), np.float32)
        return Model(np.zeros(width, np.float32), zero, zero[:1], np.array([0.5], np.float32))
    x = np.vstack([np.frombuffer(r["terms"], dtype=np.float16) for r in got]).astype(np.float32)
    return learn(x, np.array([r["label"] for r in got]))


def _scored(shared, at: int, names: list[str], k: int):
    """Task function: the rows with the vote on the text in column ``at``; ``shared`` is the broadcast model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Small batches go back, so that the JVM never holds a second large one.
            for start, some in B.chunks(b.column(at), _CHUNK, _ROWS):
                column = pa.array(vote(Model(*shared.value), features(some), k), pa.float64())
                rows = b.slice(start, len(some))
                yield pa.RecordBatch.from_arrays([*rows.columns, column], names=names)

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score", k: int = NEIGHBOURS) -> DataFrame:
    """The rows of ``docs`` with a score from 0 to 1, higher where label 1 is likelier.

    Whole texts count. Null and empty texts get the share of label 1 among the labelled rows.
    Without any label the score is 0.5. Equal texts have equal scores; an empty table gives no rows.
    ``out`` must be free in ``docs``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    at = docs.columns.index(text_col)
    names = [*docs.columns, out]

    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    return docs.mapInArrow(_scored(shared, at, names, k), schema)


def good_documents(docs: DataFrame, model: Model, text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """The rows that the vote does not reject; all columns stay."""
    (out,) = fresh(docs, "_quality_score")
    return score(docs, model, text_col, out).where(F.col(out) >= at_least).select(*docs.columns)
