"""Text to vectors: an encoder is a callable ``list[str] -> array (n x dim)``.

The encoder is made once per task by a factory and called with small batches. Keys travel
with their text, so vectors never have to be matched to rows afterwards.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.functions import constants as K

Encoder = Callable[[list[str]], np.ndarray]


def hashed_ngrams(dim: int = 64, n: int = 3) -> Encoder:
    """Counts of hashed character n-grams, unit length; texts shorter than n give zeros.

    The hash of code points c0..cn-1 is ``(sum c_i * 31^(n-1-i) mod 1000003) mod dim``.
    """
    weights = [31 ** (n - 1 - i) for i in range(n)]

    def encode(texts: list[str]) -> np.ndarray:
        # One buffer of code points for the batch; a gram counts when it lies in one text.
        codes = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        row = np.repeat(np.arange(len(texts)), [len(t or "") for t in texts])
        last = max(len(codes) - n + 1, 0)
        h = sum(w * codes[i : i + last] for i, w in enumerate(weights))
        own = np.flatnonzero(row[:last] == row[n - 1 : n - 1 + last])
        cell = row[own] * dim + (h[own] % 1000003) % dim if last else own
        out = np.bincount(cell, minlength=len(texts) * dim).reshape(len(texts), dim)
        return unit_rows(out.astype(np.float64))

    return encode


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay."""
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(norm > 0, norm, 1.0)[:, None]


def service_encoder(
    call: Callable[[str], list[float]], in_flight: int = 10, attempts: int = 3, wait: float = 1.0
) -> Encoder:
    """Encoder over a caller's one-text function, with calls in parallel and retries."""

    def once(t: str) -> list[float]:
        for n in range(attempts):
            try:
                return call(t)
            except Exception:
                if n + 1 == attempts:
                    raise
                time.sleep(wait * 2**n)
        raise AssertionError("unreachable")

    def encode(texts: list[str]) -> np.ndarray:
        with ThreadPoolExecutor(max_workers=in_flight) as pool:
            return unit_rows(np.asarray(list(pool.map(once, texts)), dtype=np.float64))

    return encode


def encode(
    df: DataFrame,
    text: str,
    factory: Callable[[], Encoder] = hashed_ngrams,
    out: str = "embedding",
    batch: int = K.ENCODE_BATCH,
    partitions: int | None = None,
) -> DataFrame:
    """Add a float vector column; rows without text get null.

    ``partitions`` bounds the number of encoders (or service callers) that run at once.
    """
    if partitions:
        df = df.repartition(partitions)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = factory()
        for b in batches:
            texts = b.column(at)
            filled = texts.drop_null().to_pylist()
            parts = [np.asarray(encoder(filled[lo : lo + batch]), dtype=np.float32) for lo in range(0, len(filled), batch)]
            # The matrix is the column's buffer; a null text has no numbers in it.
            there = texts.is_valid().to_numpy(zero_copy_only=False)
            width = parts[0].shape[1] if parts else 0
            ends = np.append(0, np.cumsum(there * width)).astype(np.int32)
            flat = pa.array(np.concatenate([p.ravel() for p in parts]) if parts else np.empty(0, dtype=np.float32))
            column = pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array(~there))
            yield pa.RecordBatch.from_arrays([*b.columns, column], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)


def encode_for_providers(
    items: DataFrame, text: str, factories: dict[str, Callable[[], Encoder]], **options
) -> DataFrame:
    """Encode the rows of each provider with its own encoder (``provider`` column).

    Rows of a provider without an encoder, or without a provider, keep a null vector.
    """
    parts = [
        encode(items.where(F.col("provider") == name), text, make, **options)
        for name, make in factories.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    served = F.coalesce(F.col("provider").isin(list(factories)), F.lit(False))
    column = options.get("out", "embedding")
    return out.unionByName(items.where(~served).withColumn(column, F.lit(None).cast("array<float>")))


def vector_rejects(vectors: DataFrame, dims: dict[str, int]) -> DataFrame:
    """Rows whose vector does not have the length set for its provider."""
    from tablescout.functions.vectors import has_dimension

    bad = F.lit(False)
    for name, dim in dims.items():
        bad = bad | ((F.col("provider") == name) & ~has_dimension(F.col("embedding"), dim))
    return vectors.where(F.col("embedding").isNotNull() & bad)
