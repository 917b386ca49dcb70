"""Language of a text by a convolutional network over its bytes.

Each byte has a small vector. Filters two, three and four bytes wide slide over a window of fixed
length, each keeps its largest response, and a softmax over these gives the languages. A text is
cut into windows, all of them count, and their probabilities are averaged by the bytes they hold.
The network is trained in numpy on windows of a bounded sample of labelled documents. To apply it,
the responses of every pair of bytes are put into tables, so that a filter costs one or two
look-ups per byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.llm import textbytes as B
from tablescout.llm.common import fresh, held_out

WINDOW = 256
VECTOR, FILTERS, WIDTHS = 8, 8, (2, 3, 4)
#: Most documents of a language, and windows of a document, that the network learns from.
PER_LANGUAGE, WINDOWS_EACH = 400, 6
EPOCHS, BATCH, RATE = 6, 64, 0.01
_CHUNK = 1024 * 1024
UNKNOWN = "und"


class Network(NamedTuple):
    languages: list[str]
    vectors: np.ndarray  # bytes x VECTOR
    filters: list[np.ndarray]  # per width: width x VECTOR x FILTERS
    bias: np.ndarray
    weight: np.ndarray  # all filters x languages
    offset: np.ndarray


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(windows, text, bytes)``: every text cut into windows, the last one filled with zeros."""
    size = np.diff(offsets)
    many = -(-size // WINDOW)
    first = np.cumsum(many) - many
    out = np.zeros(int(many.sum()) * WINDOW, dtype=np.uint8)
    out[np.arange(len(data)) + np.repeat(first * WINDOW - offsets[:-1], size)] = data
    text = np.repeat(np.arange(len(size)), many)
    held = np.minimum(size[text] - (np.arange(len(text)) - first[text]) * WINDOW, WINDOW)
    return out.reshape(-1, WINDOW), text, held


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 3, epochs: int = EPOCHS) -> Network:
    """Fit a network to windows by gradient steps with moments."""
    rng = np.random.default_rng(seed)
    kinds = len(languages)
    total = FILTERS * len(WIDTHS)
    net = {"vectors": rng.normal(0, 0.5, (256, VECTOR)), "bias": np.zeros(total)}
    net |= {f"f{w}": rng.normal(0, 1 / np.sqrt(w * VECTOR), (w * VECTOR, FILTERS)) for w in WIDTHS}
    net |= {"weight": rng.normal(0, 0.3, (total, kinds)), "offset": np.zeros(kinds)}
    net = {k: v.astype(np.float32) for k, v in net.items()}
    first, second = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            own = order[at : at + BATCH]
            grad = _gradient(net, rows[own], labels[own])
            step += 1
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    filters = [net[f"f{w}"].reshape(w, VECTOR, FILTERS) for w in WIDTHS]
    return Network(languages, net["vectors"], filters, net["bias"], net["weight"], net["offset"])


def _gradient(net: dict, rows: np.ndarray, labels: np.ndarray) -> dict:
    n = len(rows)
    x = net["vectors"][rows]
    peaks, places, views = [], [], []
    for w in WIDTHS:
        view = np.lib.stride_tricks.sliding_window_view(x, w, axis=1).transpose(0, 1, 3, 2)
        view = view.reshape(n, WINDOW - w + 1, w * VECTOR)
        response = view @ net[f"f{w}"]
        at = response.argmax(axis=1)
        places.append(at)
        views.append(np.take_along_axis(view, at[:, :, None], axis=1))
        peaks.append(np.take_along_axis(response, at[:, None, :], axis=1)[:, 0])
    before = np.concatenate(peaks, axis=1) + net["bias"]
    kept = np.maximum(before, 0)
    p = _softmax(kept @ net["weight"] + net["offset"])
    p[np.arange(n), labels] -= 1
    p /= n
    grad = {"weight": kept.T @ p, "offset": p.sum(axis=0)}
    back = (p @ net["weight"].T) * (before > 0)
    grad["bias"] = back.sum(axis=0)
    grad["vectors"] = np.zeros_like(net["vectors"])
    for i, w in enumerate(WIDTHS):
        own = back[:, i * FILTERS : (i + 1) * FILTERS]
        grad[f"f{w}"] = np.einsum("nf,nfk->kf", own, views[i])
        # The largest response alone passes the gradient on to its bytes.
        bytes_ = rows[np.arange(n)[:, None, None], places[i][:, :, None] + np.arange(w)]
        down = own[:, :, None] * net[f"f{w}"].T[None]
        np.add.at(grad["vectors"], bytes_, down.reshape(n, FILTERS, w, VECTOR))
    return grad


class Tables:
    """A network's filter responses per pair of bytes, for fast application."""

    def __init__(self, net: Network):
        self.net = net
        tap = [[net.vectors @ f[j] for j in range(len(f))] for f in net.filters]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS).astype(np.float32)
        two, three, four = tap
        self.two = pair(two[0], two[1])
        self.three = pair(three[0], three[1]), three[2].astype(np.float32)
        self.four = pair(four[0], four[1]), pair(four[2], four[3])

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """Softmax of each window."""
        out = np.empty((len(rows), len(self.net.languages)), dtype=np.float32)
        for at in range(0, len(rows), 64):
            some = rows[at : at + 64]
            p = some[:, :-1].astype(np.intp) * 256 + some[:, 1:]
            peaks = [
                self.two[p].max(axis=1),
                (self.three[0][p[:, :-1]] + self.three[1][some[:, 2:]]).max(axis=1),
                (self.four[0][p[:, :-2]] + self.four[1][p[:, 2:]]).max(axis=1),
            ]
            kept = np.maximum(np.concatenate(peaks, axis=1) + self.net.bias, 0)
            out[at : at + 64] = _softmax(kept @ self.net.weight + self.net.offset)
        return out

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(language index, probability)`` of each text; texts without bytes get -1 and 0."""
        data, offsets = B.buffer_of(texts)
        rows, text, held = windows(data, offsets)
        n = len(offsets) - 1
        total = np.zeros((n, len(self.net.languages)))
        np.add.at(total, text, self.probabilities(rows) * held[:, None])
        best = total.argmax(axis=1)
        size = np.diff(offsets)
        share = total[np.arange(n), best] / np.maximum(size, 1)
        return np.where(size > 0, best, -1), np.clip(share, 0.0, 1.0)


def fit(
    docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang",
) -> Network | None:
    """Learn from at most ``per_language`` documents of each language that are not held out.

    They are those with the least hashes of their ids, and one row stands for all of an id; from a long document ``WINDOWS_EACH`` windows
    spread over it are taken. Null languages and texts without a letter are skipped; without any
    document there is no network. A language is a label, of which there are few.
    """
    known = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang")
    )
    # A share of the ids that leaves four times the bound or all; the least hashes of these are taken.
    place = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 40))
    known = known.distinct()
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    some = known.join(counts, "lang").where(place < F.lit(float(1 << 40)) * 4 * per_language / F.col("n"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    chosen = some.select("lang", "id").withColumn("nth", nth).where(F.col("nth") <= per_language).drop("nth")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_rows, text, held = windows(*B.buffer_of(b.column(1)))
            first = np.searchsorted(text, np.arange(b.num_rows + 1))
            ids, packed, lang = [], [], []
            for i, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                own = np.unique(np.linspace(lo, hi - 1, WINDOWS_EACH).astype(int)) if hi > lo else []
                for w in own:
                    if held[w] >= WINDOW // 4 or hi - lo == 1:
                        ids.append(b.column(0)[i].as_py())
                        packed.append(all_rows[w].tobytes())
                        lang.append(b.column(2)[i].as_py())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(packed, pa.binary()), pa.array(lang, pa.string())],
                names=["id", "bytes", "lang"],
            )

    # Rows of one id are combined before the shuffle: the text with the least hash stands for them.
    one = (
        rows.join(F.broadcast(chosen), ["id", "lang"]).where(F.col("text").rlike(r"\p{L}"))
        .groupBy("id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    )
    # The bound per language and the number of languages bound this side.
    got = (
        one.select("id", "text", "lang")
        .mapInArrow(cut, "id long, bytes binary, lang string").orderBy("id", "bytes", "lang").collect()
    )
    if not got:
        return None
    languages = sorted({r["lang"] for r in got})
    number = {name: i for i, name in enumerate(languages)}
    x = np.vstack([np.frombuffer(r["bytes"], dtype=np.uint8) for r in got])
    return train(x, np.array([number[r["lang"]] for r in got]), languages)


def identify(
    docs: DataFrame, net: Network | None, text_col: str = "text", lang: str = "lang_pred", score: str = "score"
) -> DataFrame:
    """The rows of ``docs`` with the likeliest language and its probability.

    All windows of a text count. Null texts and texts without a letter are ``und`` with probability 0,
    and so is everything without a network. Equal texts get equal results; an empty table gives no
    rows. The two names must be free in ``docs``.
    """
    has = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    if net is None:
        return docs.withColumn(lang, F.lit(UNKNOWN)).withColumn(score, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(tuple(net))
    (letters,) = fresh(docs, "_lang_letters")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(*shared.value)
        tables = Tables(net)
        names = np.array([*net.languages, UNKNOWN], dtype=object)
        for b in batches:
            best, share = [np.empty(0, dtype=np.int64)], [np.empty(0)]
            for _, some in B.chunks(b.column(at), _CHUNK):
                i, p = tables.predict(some)
                best.append(i)
                share.append(p)
            known = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            best = np.where(known, np.concatenate(best), -1)
            share = np.where(best >= 0, np.concatenate(share), 0.0)
            columns = [*b.columns[:-1], pa.array(names[best], pa.string()), pa.array(share, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:-1], lang, score])

    fields = [*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]
    return docs.withColumn(letters, has).mapInArrow(run, T.StructType(fields))
