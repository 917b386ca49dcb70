"""Tokens, packing and token files against the tokenizer and plain loops."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tablescout.llm import packing, tokens, wavelet
from tests.llm import cases as C

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
PARTS = (
    "a", "B", "word", "Word", " ", "  ", "\n", "\t", "é", "É", "ß", "Σ", "ς", "İ", "J", "̌", "H̱", " ", " ",
    "　", "\x85", "\x1c", "\x00", "'s", "'LL", "12", "٣", "!", "...", "<|endoftext|>", "<|startoftext|>", "<|", "日本", "😀",
    "-", "_", "x" * 70, "​", "ﬁ", "Ǆ", ",", ".", "|",
)


@pytest.mark.parametrize("file", FILES)
def test_pieces_encode_as_the_tokenizer(file):
    path = public_tokenizers.path(file)
    plain, own = Tokenizer.from_file(path), tokens.PieceEncoder(path)
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 16))) for _ in range(4000)]
    texts += [C.prose(rng, 300) + ".\n" + C.prose(rng, 20) for _ in range(30)] + [None, "", " ", "\n", "z" * 5000]
    for at in range(0, len(texts), 1000):
        some = texts[at : at + 1000]
        flat, offsets = own.ids(pa.array(some, pa.string()))
        for t, lo, hi in zip(some, offsets[:-1], offsets[1:]):
            assert flat[lo:hi].tolist() == plain.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_forgetting_pieces_changes_nothing(monkeypatch):
    path = public_tokenizers.path(FILES[0])
    rng = random.Random(6)
    texts = pa.array([C.prose(rng, 200) for _ in range(40)])
    whole = tokens.PieceEncoder(path).ids(texts)
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    monkeypatch.setattr(tokens, "_CHUNK", 500)
    small = tokens.PieceEncoder(path).ids(texts)
    assert all((a == b).all() for a, b in zip(whole, small))


def check_runs(counts, limits):
    """Every piece is placed once, offsets have no gaps, all capacities hold; gives the sequences."""
    seqs, seen = defaultdict(list), defaultdict(set)
    for r in packing.best_fit(counts, limits):
        for i in range(r.n):
            seen[r.length].add(r.start + i)
            seqs[r.first + i // r.each].append((r.offset + i % r.each * r.length, r.length))
    assert {k: len(v) for k, v in seen.items()} == counts
    assert all(v == set(range(counts[k])) for k, v in seen.items())
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= limits.tokens and len(s) <= limits.documents and sum(n * n for _, n in s) <= limits.attention
    assert sorted(seqs) == list(range(len(seqs)))
    return seqs


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize(("documents", "attention"), [(1000, 64 * 64), (5, 64 * 64), (1000, 1500), (4, 2500)])
def test_best_fit_holds_every_capacity(rule, documents, attention):
    rng = np.random.default_rng(documents + attention)
    for _ in range(8):
        most = min(64, int(attention**0.5))
        lengths, n = np.unique(rng.integers(1, most + 1, rng.integers(1, 400)), return_counts=True)
        counts = dict(zip(lengths.tolist(), n.tolist()))
        limits = packing.Limits(64, documents, attention, rule=rule)
        seqs = check_runs(counts, limits)
        need = max(
            sum(k * c for k, c in counts.items()) / 64, sum(counts.values()) / documents,
            sum(k * k * c for k, c in counts.items()) / attention,
        )
        assert len(seqs) <= 1.7 * need + 2


def test_best_fit_is_near_the_fewest():
    rng = np.random.default_rng(2)
    lengths, n = np.unique(np.minimum(rng.geometric(0.004, 20_000), 1024), return_counts=True)
    counts = dict(zip(lengths.tolist(), n.tolist()))
    seqs = check_runs(counts, packing.Limits())
    assert len(seqs) <= -(-sum(k * c for k, c in counts.items()) // 1024) + 2


def test_a_piece_larger_than_a_sequence_is_an_error():
    with pytest.raises(ValueError):
        packing.best_fit({30: 1}, packing.Limits(64, 10, 500))
    assert packing.best_fit({}) == []


def expected_pieces(rows, tokenizer, end, size):
    out = []
    for i, t, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [end]
        first = len(ids) - (len(ids) - 1) // size * size
        cuts = [0, *range(first, len(ids) + 1, size)]
        out += [(i if i is not None else -1, p, a, b - a, C.crc(ids[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [4096, 5])
def test_documents_are_packed_whole(spark, block_rows):
    rows = C.awkward()
    path = public_tokenizers.path(FILES[0])
    cut = packing.pieces(C.documents(spark, rows), path, 2, 64).cache()
    limits = packing.Limits(64, 8, 64 * 64)
    got = packing.pack(cut, limits, block_rows).collect()
    key = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    assert key == expected_pieces(rows, Tokenizer.from_file(path), 2, 64)
    seqs = defaultdict(list)
    for r in got:
        assert C.crc(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        assert len(s) <= 8
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    again = packing.pack(cut.repartition(7), limits, block_rows)
    digest = lambda rows: sorted((r["sequence_id"], r["offset"], r["ids_crc32"]) for r in rows)
    assert digest(again.collect()) == digest(got)


def test_packing_an_empty_table(spark):
    docs = C.documents(spark, [(1, "x", "s")]).where("false")
    out = packing.pack_documents(docs, public_tokenizers.path(FILES[0]), 2, with_ids=False)
    assert out.count() == 0 and {"sequence_id", "offset"} <= set(out.columns)


@pytest.mark.parametrize("n", [0, 1, 7, 512, 513, 6000])
def test_wavelet_file_answers(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 200, n) ** 2
    sizes = np.array([n // 3, n - n // 3])
    file = wavelet.WaveletFile(wavelet.write(ids, [5, None], sizes))
    assert (file.tokens() == ids).all() and file.doc_ids == [5, None] and file.sizes.tolist() == sizes.tolist()
    for at in range(0, n, max(1, n // 50)):
        token = int(ids[at])
        places = np.flatnonzero(ids == token)
        assert file.access(at) == token and file.count(token) == len(places)
        assert file.count(token, n // 4, n // 2) == ((places >= n // 4) & (places < n // 2)).sum()
        nth = int(rng.integers(len(places)))
        assert file.place(token, nth) == places[nth]
        assert file.document(at) == int(at >= sizes[0])
    assert file.count(1 << 21) == 0
    for bad in (-1, n):
        with pytest.raises(IndexError):
            file.access(bad)
    with pytest.raises(IndexError):
        file.place(10**6, 0)


def test_wavelet_blocks_beyond_one(monkeypatch):
    monkeypatch.setattr(wavelet, "_BLOCK", 128)
    ids = np.random.default_rng(1).integers(0, 5, 9000)
    file = wavelet.WaveletFile(wavelet.write(ids, [1], np.array([9000])))
    assert (file.tokens() == ids).all()
    assert [file.access(i) for i in range(0, 9000, 611)] == ids[::611].tolist()
    assert file.place(3, 700) == np.flatnonzero(ids == 3)[700]
    with pytest.raises(ValueError):
        wavelet.WaveletFile(b"????" + bytes(40))


@pytest.mark.parametrize(("shard_rows", "part_tokens"), [(2048, 8_000_000), (7, 200)])
def test_shards_hold_the_corpus_in_order(spark, tmp_path, shard_rows, part_tokens):
    rows = [r for r in C.awkward(2)]
    path = public_tokenizers.path(FILES[1])
    plain = Tokenizer.from_file(path)
    docs = C.documents(spark, rows)
    folder = wavelet.write_shards(docs, path, 1, f"{tmp_path}/w", shard_rows=shard_rows, part_tokens=part_tokens)
    table = spark.read.parquet(folder)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"], tuple(r["ids"])) for r in wavelet.read_shards(table).collect())
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for (s, doc, n, crc, ids), (i, t, _) in zip(got, order, strict=True):
        want = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        assert (s, doc, n, crc, list(ids)) == (start, i, len(want), C.crc(want), want)
        start += n
    if shard_rows == 7:
        assert table.select("shard").distinct().count() > 3 and table.where("part > 0").count() > 0


def test_no_documents_no_files(spark, tmp_path):
    docs = C.documents(spark, [(1, "x", "s")]).where("false")
    folder = wavelet.write_shards(docs, public_tokenizers.path(FILES[1]), 1, f"{tmp_path}/w")
    assert wavelet.read_shards(spark.read.schema(wavelet._FILE).parquet(folder)).count() == 0
