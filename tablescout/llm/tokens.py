"""Token ids of whole texts with a given tokenizer file, piece by piece.

A BPE that first cuts a text into words never merges across a space that follows a non-space, nor
between an ASCII letter and ASCII punctuation: the pattern always cuts there. So texts are cut at
such places, every different piece is encoded once by the tokenizer, and the ids of a text are
those of its pieces in order. Most pieces repeat, which makes this many times as fast as encoding
whole texts. Tests hold it against the tokenizer itself.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from tablescout.llm import textbytes as B
from tablescout.llm.common import worker_memo

#: Pieces whose ids a worker remembers; each takes about 50 bytes.
REMEMBERED = 2_000_000
#: A piece longer than this is encoded each time it comes.
LONG_PIECE = 64
#: Bytes of text cut at a time, so that the arrays stay small.
_CHUNK = 512 * 1024
_JOINED = 500
_LATEST = 65_536
_ASCII_SPACE = np.zeros(256, dtype=bool)
_ASCII_SPACE[[*range(9, 14), *range(28, 33)]] = True
#: 1 letter, 2 punctuation (without what may open a contraction or a special token), 0 other.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[c for c in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)) if c not in b"'<|>"]] = 2
#: First bytes of characters some of which are white space: cutting after one of them is left out.
_RARE2, _RARE3 = 0xC2, (0xE1, 0xE2, 0xE3)
_ODD = re.compile(rb"[\x00-\x20\x7f\xc2\xe1-\xe3]")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class PieceEncoder:
    """``ids(texts)`` gives ``(all ids, offsets)`` of a string column."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Either a token holds the space before its word, or white space is dropped.
        self.drops_space = bool(getattr(self.tokenizer.model, "end_of_word_suffix", None))
        self.lowers = "Lowercase" in str(self.tokenizer.normalizer)
        # Stands between pieces that are encoded in one call.
        self.between = " \0 " if self.drops_space else "\n"
        self.marker = self._encode(self.between)
        self._forget()

    def _forget(self) -> None:
        # Hashes of pieces in order, with their rows in ``begin`` and ``size``: many, and the latest.
        empty = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int32)
        self.known, self.latest = empty, empty
        self.begin, self.size = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int32)
        self.pool, self.used, self.rows = np.zeros(4096, dtype=np.uint32), 0, 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 for new ones."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        for keys, rows in (self.known, self.latest):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = keys[at] == hashes
                out[hit] = rows[at[hit]]
        return out

    def _insert(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        """Remember sorted new hashes; the latest are merged into the many now and then."""
        self.latest = _merged(self.latest, (hashes, rows.astype(np.int32)))
        if len(self.latest[0]) > _LATEST:
            self.known = _merged(self.known, self.latest)
            self.latest = self.latest[0][:0], self.latest[1][:0]

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces begin."""
        white = _ASCII_SPACE[data]
        cut = B.SPACE[data] if self.drops_space else data == 32
        cut[1:] &= ~white[:-1]
        if not self.drops_space:
            # What a character of several bytes is takes more than its last byte to tell.
            cut[2:] &= data[:-2] != _RARE2
            for b in _RARE3:
                cut[3:] &= data[:-3] != b
        kind = _KIND[data]
        cut[1:] |= (kind[:-1] ^ kind[1:]) == 3
        # A line end between two non-white characters is a piece of its own.
        line = np.flatnonzero(data[1:-1] == 10) + 1
        line = line[(kind[line - 1] > 0) & (kind[line + 1] > 0)]
        cut[line] = cut[line + 1] = True
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(cut)

    def _learn(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces as they stand in a text; a piece brings the space before it along."""
        out: list = [None] * len(pieces)
        plain = []
        for i, p in enumerate(pieces):
            if len(p) > LONG_PIECE or len(p) < 2 or _ODD.search(p, 1) or p[0] < 32:
                out[i] = np.asarray(self._encode(p.decode()), dtype=np.uint32)
            else:
                plain.append(i)
        for i, ids in zip(plain, self._together([pieces[i] for i in plain])):
            out[i] = ids
        return out

    def _together(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Many pieces in one call; a mark that none of them holds tells their ids apart."""
        between, out = self.between.encode(), []
        parts = [pieces[at : at + _JOINED] for at in range(0, len(pieces), _JOINED)]
        texts = [(between.join(part) + between).decode() for part in parts]
        # This call leaves out the places in the text, which are not needed.
        for part, found in zip(parts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.asarray(found.ids, dtype=np.uint32)
            end = np.flatnonzero(ids == self.marker[0])
            if len(self.marker) != 1 or len(end) != len(part):
                out += [np.asarray(self._encode(p.decode()), dtype=np.uint32) for p in part]
            else:
                begin = np.append(0, end[:-1] + 1)
                out += [ids[b:e] for b, e in zip(begin.tolist(), end.tolist())]
        return out

    def _keep(self, ids: list[np.ndarray]) -> np.ndarray:
        """Put the ids of new pieces into the pool; gives their rows."""
        rows, more = self.rows, sum(map(len, ids))
        while len(self.begin) < rows + len(ids):
            self.begin, self.size = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.size, 2 * len(self.size))
        while len(self.pool) < self.used + more:
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        self.size[rows : rows + len(ids)] = sizes
        self.begin[rows : rows + len(ids)] = self.used + np.cumsum(sizes) - sizes
        if ids:
            self.pool[self.used : self.used + more] = np.concatenate(ids)
        self.used += more
        self.rows += len(ids)
        return np.arange(rows, rows + len(ids))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and where each text's begin; a null text has none."""
        parts, sizes = [np.empty(0, dtype=np.uint32)], [np.zeros(1, dtype=np.int64)]
        for _, some in B.chunks(texts, _CHUNK):
            flat, counts = self._ids(*B.buffer_of(some))
            parts.append(flat)
            sizes.append(counts)
        return np.concatenate(parts), np.cumsum(np.concatenate(sizes))

    def _ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.empty(0, dtype=np.uint32), np.zeros(len(offsets) - 1, dtype=np.int64)
        raw = data.tobytes()
        if self.lowers and b"\xcc" not in raw and b"\xcd" not in raw:
            # Letters with combining marks may compose, and are left to the tokenizer.
            raw = raw.translate(_LOWER)
            data = np.frombuffer(raw, dtype=np.uint8)
        begin = self._cuts(data, offsets)
        end = np.append(begin[1:], len(data))
        hash_ = B.RangeHash(data).of(begin, end)
        # Each long piece is one of its own; its number stands for it within this call.
        long = np.flatnonzero(end - begin > LONG_PIECE)
        hash_[long] = np.arange(len(long), dtype=np.uint64)
        hashes, first, piece = np.unique(hash_, return_index=True, return_inverse=True)
        if self.rows > REMEMBERED or self.used > 8 * REMEMBERED:
            self._forget()  # frequent pieces come back at once
        short = end[first] - begin[first] <= LONG_PIECE
        place = self._find(hashes)
        place[~short] = -1
        new = np.flatnonzero(place < 0)
        slices = [raw[b:e] for b, e in zip(begin[first[new]].tolist(), end[first[new]].tolist())]
        place[new] = self._keep(self._learn(slices))
        stays = new[short[new]]
        self._insert(hashes[stays], place[stays])
        row = place[piece]
        size = self.size[row]
        stop = np.cumsum(size, dtype=np.int64)
        source = np.repeat(self.begin[row] - (stop - size), size) + np.arange(stop[-1])
        flat = self.pool[source]
        # A text's pieces are those that begin in it.
        upto = np.concatenate([[0], stop])[np.searchsorted(begin, offsets)]
        return flat, np.diff(upto)


def _merged(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted lists of keys with their values as one."""
    at = np.searchsorted(one[0], two[0])
    return np.insert(one[0], at, two[0]), np.insert(one[1], at, two[1])


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder for a tokenizer file."""
    memo = worker_memo("encoders")
    if path not in memo:
        memo[path] = PieceEncoder(path)
    return memo[path]
