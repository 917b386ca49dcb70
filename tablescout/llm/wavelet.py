"""Token files as wavelet matrices: one compressed file per shard, readable without unpacking all.

A shard's ids are written bit by bit, highest first. Plane ``k`` holds bit ``k`` of every id in the
order the planes above left, and the ids whose bit is 0 move before those whose bit is 1. With a
count of ones per 512 bits, the file answers which token stands at a place, how often a token occurs
in a range, and where its n-th occurrence is, in one step per plane. Planes are compressed in blocks,
and a query unpacks only the planes' blocks it reads; reading a whole shard undoes the moves from
the lowest plane up.

Shards are ranges of document ids in ascending order, so files sorted by (shard, part) hold the
corpus in that order. A shard of very long texts goes on in further parts. Files are rows of a
Parquet folder (one row in each file), so Spark commits them and any store that Spark reaches works.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescout.llm.common import checkpoint_folder, folds
from tablescout.llm.textbytes import chunks
from tablescout.llm.tokens import encoder

#: Documents of a shard, and tokens of a part at which a shard goes on in a new one.
SHARD_ROWS, PART_TOKENS = 2048, 8_000_000
#: Most shards of a run; beyond it shards get more documents and more parts.
MOST_SHARDS = 20_000
_MAGIC, _HEAD = b"WVM1", "<4sQIB"
_RANK_BYTES = 64
_BLOCK = 1 << 16  # bytes of a plane that are compressed together


def _section(out: list[bytes], data: bytes) -> None:
    packed = zstandard.ZstdCompressor(level=1).compress(data)
    out.append(struct.pack("<II", len(data), len(packed)) + packed)


def write(ids: np.ndarray, doc_ids: list[int | None], sizes: np.ndarray) -> bytes:
    """The file of some documents: all ids one after another, the documents' ids and their lengths."""
    ids = np.asarray(ids, dtype=np.uint32)
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    out = [struct.pack(_HEAD, _MAGIC, len(ids), len(doc_ids), planes)]
    _section(out, np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes())
    _section(out, np.packbits([d is None for d in doc_ids]).tobytes())
    _section(out, np.asarray(sizes, dtype="<u4").tobytes())
    for k in range(planes - 1, -1, -1):
        ones = (ids >> np.uint32(k) & np.uint32(1)).astype(bool)
        bits = np.packbits(ones)
        counts = np.bitwise_count(np.pad(bits, (0, -len(bits) % _RANK_BYTES))).reshape(-1, _RANK_BYTES)
        ranks = np.append(0, np.cumsum(counts.sum(axis=1, dtype=np.int64))).astype("<u4")
        _section(out, ranks.tobytes())
        raw = bits.tobytes()
        for at in range(0, len(raw), _BLOCK):
            _section(out, raw[at : at + _BLOCK])
        ids = np.concatenate([ids[~ones], ids[ones]])
    return b"".join(out)


class WaveletFile:
    """Reader of one file image."""

    def __init__(self, data: bytes):
        magic, self.n, docs, self.planes = struct.unpack_from(_HEAD, data)
        if magic != _MAGIC:
            raise ValueError("not a wavelet file")
        self._data, at = data, struct.calcsize(_HEAD)
        sections = []
        while at < len(data):
            raw, packed = struct.unpack_from("<II", data, at)
            sections.append((at + 8, packed, raw))
            at += 8 + packed
        blocks = -(-(-(-self.n // 8)) // _BLOCK)
        ids = np.frombuffer(self._read(sections[0]), dtype="<i8")
        null = np.unpackbits(np.frombuffer(self._read(sections[1]), dtype=np.uint8), count=docs).astype(bool)
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, null)]
        self.sizes = np.frombuffer(self._read(sections[2]), dtype="<u4").astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self._blocks, self._ranks, self._open = [], [], {}
        for k in range(self.planes):
            first = 3 + k * (blocks + 1)
            self._ranks.append(np.frombuffer(self._read(sections[first]), dtype="<u4").astype(np.int64))
            self._blocks.append(sections[first + 1 : first + 1 + blocks])
        self._zeros = [self.n - int(r[-1]) for r in self._ranks]

    def _read(self, section: tuple[int, int, int]) -> bytes:
        at, packed, raw = section
        return zstandard.ZstdDecompressor().decompress(self._data[at : at + packed], max_output_size=max(raw, 1))

    def _bytes(self, plane: int, at: int) -> np.ndarray:
        """The ``_RANK_BYTES`` bytes of a plane from a multiple of that."""
        key = plane, at // _BLOCK
        if key not in self._open:
            self._open[key] = np.frombuffer(self._read(self._blocks[plane][key[1]]), dtype=np.uint8)
        return self._open[key][at % _BLOCK : at % _BLOCK + _RANK_BYTES]

    def _bits(self, plane: int, at: int) -> np.ndarray:
        return np.unpackbits(self._bytes(plane, at))

    def _rank(self, plane: int, at: int) -> int:
        """Ones of a plane before a place."""
        block, rest = divmod(at, 8 * _RANK_BYTES)
        ones = int(self._ranks[plane][block])
        return ones + (int(self._bits(plane, block * _RANK_BYTES)[:rest].sum()) if rest else 0)

    def _select(self, plane: int, bit: int, nth: int) -> int:
        """Place of the n-th one or zero of a plane."""
        ones = self._ranks[plane]
        upto = ones if bit else np.minimum(np.arange(len(ones)) * 8 * _RANK_BYTES, self.n) - ones
        block = int(np.searchsorted(upto, nth, side="right")) - 1
        own = np.flatnonzero(self._bits(plane, block * _RANK_BYTES) == bit)
        return block * 8 * _RANK_BYTES + int(own[nth - int(upto[block])])

    def access(self, at: int) -> int:
        """The token at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        token = 0
        for k in range(self.planes):
            ones = self._rank(k, at)
            bit = self._rank(k, at + 1) - ones
            token = token << 1 | bit
            at = self._zeros[k] + ones if bit else at - ones
        return token

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of a token in a range of places."""
        lo, hi = self._range(token, start, self.n if end is None else end)
        return hi - lo

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> self.planes:
            return 0, 0
        for k in range(self.planes):
            a, b = self._rank(k, lo), self._rank(k, hi)
            if token >> (self.planes - 1 - k) & 1:
                lo, hi = self._zeros[k] + a, self._zeros[k] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def place(self, token: int, nth: int) -> int:
        """Place of the n-th occurrence of a token, from 0."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= nth < hi - lo:
            raise IndexError(nth)
        at = lo + nth
        for k in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - k) & 1
            at = self._select(k, bit, at - self._zeros[k] if bit else at)
        return at

    def document(self, at: int) -> int:
        """Index of the document that holds a place."""
        return int(np.searchsorted(self.starts, at, side="right")) - 1

    def tokens(self) -> np.ndarray:
        """All ids in order."""
        ids = np.zeros(self.n, dtype=np.uint32)
        for k in range(self.planes - 1, -1, -1):
            raw = b"".join(self._read(s) for s in self._blocks[k])
            ones = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=self.n).astype(bool)
            above = np.empty_like(ids)
            above[~ones] = ids[: self._zeros[k]]
            above[ones] = ids[self._zeros[k] :]
            above |= ones.astype(np.uint32) << np.uint32(self.planes - 1 - k)
            ids = above
        return ids


_FILE = "shard int, part int, docs long, tokens long, image binary"


def write_shards(
    docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, id_col: str = "doc_id",
    text_col: str = "text", shard_rows: int = SHARD_ROWS, part_tokens: int = PART_TOKENS,
) -> str:
    """Write the token files of all documents in ascending id order; returns their folder.

    Each document's ids are followed by the end id. Null and empty texts are the end id alone; null
    ids come first; rows with equal ids are ordered by text. An empty table writes no files. Other
    columns are not read.
    """
    spark = docs.sparkSession
    if path is None:
        path = f"{checkpoint_folder(spark).rstrip('/')}/tablescout-wavelet-{uuid.uuid4().hex}"
    key = F.col(id_col).cast("long")
    shards = min(folds(docs.count(), shard_rows), MOST_SHARDS)
    cuts = [i / shards for i in range(1, shards)]
    # At most MOST_SHARDS numbers; only the id column is read.
    bounds = (docs.agg(F.percentile_approx(key, cuts, 20 * shards).alias("b")).first()["b"] or []) if cuts else []
    bounds = np.unique(np.array(bounds, dtype=np.int64))

    def shard_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
            shard = pa.array(np.searchsorted(bounds, ids, side="right").astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, shard], names=["id", "text", "shard"])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        shard, part = None, 0
        ids: list = []
        keys: list = []
        sizes: list = []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal part
            if keys:
                flat, size = np.concatenate(ids), np.concatenate(sizes)
                image = write(flat, keys, size)
                yield pa.RecordBatch.from_pylist(
                    [{"shard": shard, "part": part, "docs": len(keys), "tokens": len(flat), "image": image}],
                    schema=pa.schema([
                        ("shard", pa.int32()), ("part", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64()),
                        ("image", pa.binary()),
                    ]),
                )
                part += 1
                for kept in (ids, keys, sizes):
                    kept.clear()

        for b in batches:
            of = b.column(2).to_numpy()
            begin = np.flatnonzero(np.diff(of, prepend=-1)) if len(of) else np.empty(0, dtype=np.int64)
            for lo, hi in zip(begin.tolist(), np.append(begin[1:], len(of)).tolist()):
                if of[lo] != shard:
                    yield from close()
                    shard, part = int(of[lo]), 0
                # A part has about as many bytes of text as tokens at most.
                for at, some in chunks(b.column(1).slice(lo, hi - lo), part_tokens):
                    flat, offsets = encode.ids(some)
                    ends = offsets[1:] + np.arange(len(some))
                    keys.extend(b.column(0).slice(lo + at, len(some)).to_pylist())
                    sizes.append(np.diff(offsets) + 1)
                    ids.append(np.insert(flat, offsets[1:], np.uint32(end_id)))
                    assert (ids[-1][ends] == end_id).all()
                    if sum(map(len, ids)) >= part_tokens:
                        yield from close()
        yield from close()

    tasks = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    (
        docs.select(key.alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(shard_of, "id long, text string, shard int")
        .repartition(tasks, "shard").sortWithinPartitions("shard", "id", "text")
        .mapInArrow(files, _FILE)
        .write.option("maxRecordsPerFile", 1).option("compression", "uncompressed").parquet(path)
    )
    return path


def read_shards(docs_of: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents of the token files: ``doc_id, start, n_tokens, ids_crc32`` and ``ids``.

    ``docs_of`` is the folder read as Parquet. ``start`` counts the ids of all documents before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, part, image in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                file = WaveletFile(image.as_py())
                ids = file.tokens().astype("<u4")
                raw = memoryview(ids.tobytes())
                ends = file.starts + file.sizes
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(file.starts.tolist(), ends.tolist())]
                n = len(crc)
                columns = [
                    pa.array([shard] * n, pa.int32()), pa.array([part] * n, pa.int32()),
                    pa.array(file.doc_ids, pa.int64()), pa.array(file.starts), pa.array(file.sizes), pa.array(crc, pa.int64()),
                ]
                names = ["shard", "part", "doc_id", "begin", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "shard int, part int, doc_id long, begin long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    read = docs_of.select("shard", "part", "image").mapInArrow(run, schema)
    # One row per file.
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = docs_of.select(
        "shard", "part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("_before")
    )
    rows = read.join(starts, ["shard", "part"]).withColumn("start", F.col("_before") + F.col("begin"))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
