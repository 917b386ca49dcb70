"""Binary packing, hard negatives and spelling variants against plain loops and exact round trips."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablescout.llm import binary_packing, hard_negatives, queries, spelling
from tests.llm import cases as C

FILE = public_tokenizers.path("byte_bpe_50k.json")


# --- packing by powers of two ---------------------------------------------------------------------


def test_binary_lengths_are_the_bits_of_a_length():
    for n in [1, 2, 3, 7, 8, 31, 32, 33, 1000, 4097]:
        lengths = binary_packing.binary_lengths(n, 32)
        assert sum(lengths) == n and lengths == sorted(lengths, reverse=True)
        assert all(x & (x - 1) == 0 and x <= 32 for x in lengths)
        assert all(c == 1 for x, c in Counter(lengths).items() if x < 32)


def check_sequences(rows, texts, end_id, tokens):
    """Every row of a document is there once, in its order, and sequences hold one piece without padding."""
    plain = Tokenizer.from_file(FILE)
    want = Counter()
    for i, text in texts:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [end_id]
        at = 0
        for n in binary_packing.binary_lengths(len(ids), tokens):
            want[i, at, n, C.crc(ids[at : at + n]), len(ids)] += 1
            at += n
    got = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
    assert got == want
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    assert all(r["offset"] == 0 for r in rows)
    # Buckets follow one another, the longest first.
    by_id = [r["length"] for r in sorted(rows, key=lambda r: r["sequence_id"])]
    assert by_id == sorted(by_id, reverse=True)


@pytest.mark.parametrize(("tokens", "block_rows", "group_blocks"), [(64, 3, 2), (2048, 1024, 1024)])
def test_binary_packing_of_awkward_rows(spark, tokens, block_rows, group_blocks):
    rows = C.awkward() + [(None, None, "c"), (None, None, "c"), (5, "word", None)]
    docs = C.documents(spark, rows)
    cut = binary_packing.binary_pieces(docs, FILE, 1, tokens)
    packed = binary_packing.number_sequences(cut, block_rows, group_blocks).collect()
    check_sequences(packed, [(i, t) for i, t, _ in rows], 1, tokens)
    assert all(C.crc(np.array(r["ids"], dtype=np.int64)) == r["ids_crc32"] for r in packed)


def test_binary_packing_numbers_do_not_depend_on_partitions(spark):
    docs = C.documents(spark, C.awkward())
    one, two = (
        sorted((r["sequence_id"], r["length"], r["ids_crc32"]) for r in binary_packing.pack_binary(
            docs.repartition(n), FILE, 1, 256, with_ids=False
        ).collect()) for n in (1, 5)
    )
    assert one == two


def test_binary_packing_of_a_crowd_of_copies_and_of_nothing(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"))
    packed = binary_packing.pack_binary(docs, FILE, 1)
    assert packed.select("sequence_id").distinct().count() == packed.count() == 3000 * len(
        binary_packing.binary_lengths(4, 2048)
    )
    assert binary_packing.pack_binary(docs.limit(0), FILE, 1).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        binary_packing.binary_pieces(docs, FILE, 1, 1000)


def test_registered_binary_packing(spark):
    folder = "/root/testdata/sf0.001"
    texts = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    check_sequences(queries.op11_binary_packing(spark, folder).collect(), texts, 1, 2048)


# --- hard negatives -------------------------------------------------------------------------------


def mined(rows, asked, positives=5, negatives=3):
    """By all pairs, in whole numbers."""
    def whole(v):
        return [int(np.floor(256.0 * float(x))) for x in v]

    good = [
        (i, lab, whole(v)) for i, v, lab in rows
        if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for i, lab, q in good:
        if not asked(i):
            continue
        scored = sorted(
            ((-sum(a * b for a, b in zip(q, m)), j, other == lab) for j, other, m in good), key=lambda x: x[:2]
        )
        for p, j, same in [x for x in scored if x[2] and x[1] != i][:positives]:
            inside = [x for x in scored if not x[2] and 50 * -p <= 100 * -x[0] <= 95 * -p]
            out += [(i, j, r + 1, x[1], -p, -x[0]) for r, x in enumerate(inside[:negatives])]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int, score string, cell string, `key` int, v int, id int, bin int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "s", "c", 1, 2, 3, 4) for r in rows], SCHEMA).repartition(3)


def some_vectors(seed, n, dim=8, labels=3, copies=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, dim))
    rows = []
    for i in range(n):
        v = centre[rng.integers(5)] + 0.4 * rng.normal(size=dim)
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(labels))))
    # Copies of one vector under several labels, so that most of its scores tie.
    rows += [(10_000 + i, rows[0][1], i % labels) for i in range(copies)]
    return rows


@pytest.mark.parametrize("bounds", [
    {}, {"cell_rows": 4, "bin_rows": 16, "part_rows": 3, "seed_rows": 10}, {"cell_rows": 2, "bin_rows": 1000, "seed_rows": 1},
])
def test_hard_negatives_are_those_of_all_pairs(spark, bounds):
    rows = some_vectors(1, 300, copies=120)
    got = hard_negatives.mine_negatives(vectors(spark, rows), F.col("vec_id") % 10 == 0, **bounds).collect()
    want = mined(rows, lambda i: i % 10 == 0)
    assert want and sorted(tuple(r) for r in got) == want


def test_hard_negatives_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = some_vectors(2, 60)
    rows += [
        (None, rows[0][1], 1), (70, None, 1), (71, [None] + [0.5] * 7, 1), (72, [nan] + [0.5] * 7, 1), (73, [inf] * 8, 1),
        (80, [0.0] * 8, 1), (81, [0.0] * 8, 2), (90, rows[3][1], None), (100, rows[4][1], 2), (100, rows[4][1], 2),
        (110, [-x for x in rows[5][1]], 9),
    ]
    got = hard_negatives.mine_negatives(vectors(spark, rows), F.col("vec_id") % 10 == 0, cell_rows=4, seed_rows=8).collect()
    want = mined(rows, lambda i: i % 10 == 0)
    assert sorted(tuple(r) for r in got) == want
    # A zero vector's scores are all 0, and so is its window.
    assert any(r[0] == 80 and r[4] == r[5] == 0 for r in want)
    assert all(r[0] != 110 for r in want)


def test_hard_negatives_of_empty_tables_lone_rows_and_odd_lengths(spark):
    none = vectors(spark, some_vectors(3, 1)).limit(0)
    assert hard_negatives.mine_negatives(none, F.lit(True)).count() == 0
    lone = vectors(spark, some_vectors(3, 1))
    assert hard_negatives.mine_negatives(lone, F.lit(True)).count() == 0
    assert hard_negatives.mine_negatives(vectors(spark, some_vectors(3, 20)), F.lit(None).cast("boolean")).count() == 0
    odd = vectors(spark, [(0, [1.0], 1), (1, [1.0, 2.0], 1)])
    with pytest.raises(Exception, match="vectors differ in length"):
        hard_negatives.mine_negatives(odd, F.lit(True)).count()


def test_the_walk_goes_by_falling_bounds_and_skips_what_cannot_matter():
    rng = np.random.default_rng(4)
    first, second = rng.normal(size=7).round(1), rng.normal(size=5).round(1)
    walked = list(hard_negatives.walk(first, second))
    assert [b for b, _, _ in walked] == sorted((b for b, _, _ in walked), reverse=True)
    assert {(i, j) for _, i, j in walked} == {(i, j) for i in range(7) for j in range(5)}
    assert all(b == first[i] + second[j] for b, i, j in walked)
    # Well-parted clusters: few of the rows are visited, and nothing is lost.
    centre = 40 * rng.normal(size=(30, 8))
    points = np.floor(np.repeat(centre, 40, axis=0) + rng.normal(size=(1200, 8)))
    books = hard_negatives.Codebooks(points, len(points), 40)
    cell, far1, far2 = books.assign(points)
    books.measure(
        [{"cell": c, "n": int((cell == c).sum()), "far1": far1[cell == c].max(), "far2": far2[cell == c].max()} for c in np.unique(cell)],
        100,
    )
    seen = []
    for q in points[::50]:
        score = points @ q
        fifth = np.sort(score)[-5]
        cells, _ = hard_negatives._visits(books, q, [(fifth, np.inf)], 0, 0)
        assert set(cell[score >= fifth]) <= set(cells)
        seen.append(books.rows[cells].sum() / len(points))
    assert np.mean(seen) < 0.3
    assert books.rows.sum() == 1200 and (books.bin + books.bins <= books.n_bins).all()


def test_products_stay_exact_where_doubles_do_not():
    q, m = np.array([[2.0**30 + 1, 3.0]]), np.array([[2.0**25 + 1, 1.0]])
    assert hard_negatives.products(q, m)[0, 0] == (2**30 + 1) * (2**25 + 1) + 3
    with pytest.raises(ValueError, match="too large"):
        hard_negatives.products(np.array([[2.0**40]]), np.array([[2.0**40]]))


def test_registered_hard_negatives(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    rows = [(i, v, (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab in rows]
    got = queries.op12_hard_negatives(spark, folder).collect()
    assert sorted(tuple(r) for r in got) == mined(rows, lambda i: i % 50 == 0)


# --- spelling variants ----------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(words, times=10):
    """By all pairs: ``word -> (form, root, n, n_near, form_n)``."""
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= times * words[w]:
            form[w] = best
    out = {}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None)
    return out


def misspelt(rng, n, letters="abcdé"):
    """Words with few letters, so anagrams, copies but for one edit, and chains of them abound."""
    words = {}
    while len(words) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.choice([7, 7, 8, 9])))
        words[w] = rng.choice([2, 3, 30, 400, 5000])
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w) + 1)
            v = rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :]])
            words.setdefault(v, rng.choice([2, 3, 30, 400]))
    return words


@pytest.mark.parametrize("bounds", [
    {}, {"cell_words": 40, "block_letters": 200, "part_letters": 300}, {"cell_words": 10, "block_letters": 10_000},
])
def test_near_words_are_those_of_all_pairs(spark, bounds):
    words = misspelt(random.Random(1), 700)
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    got = {r["word"]: tuple(r)[1:] for r in spelling.variants(frame, **bounds).collect()}
    want = grouped(words)
    assert got == want
    assert any(r[0] and r[1] != r[0] for r in want.values()), "no chain of forms"


def test_cells_reach_every_near_word():
    rng = random.Random(2)
    words = misspelt(rng, 600, "abcdefgé")
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    planes = {n: spelling.Planes(some, 12) for n, some in by_length.items() if len(some) > 60}
    assert all(p.leaves > 4 for p in planes.values())
    home = {}
    for n, p in planes.items():
        home.update(zip(by_length[n], p.leaf_of(spelling.letter_rows(by_length[n])).tolist()))
    for n, p in planes.items():
        for of, spare in ((n, 1), (n - 1, 0)):
            if of in planes:
                asked = by_length[of]
                row, leaf = p.reached(spelling.letter_rows(asked), spare)
                met = set(zip(row.tolist(), leaf.tolist()))
                assert len(met) < len(asked) * p.leaves
                for i, w in enumerate(asked):
                    assert all((i, home[x]) in met for x in by_length[n] if one_edit(w, x))


def counted(rows, slips):
    import re

    n = Counter()
    for i, text, _ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall(spelling.RUN, low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slips and h % slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


@pytest.mark.parametrize("slips", [0, 3])
def test_words_of_awkward_texts(spark, slips, monkeypatch):
    rows = C.awkward() + [
        (200, "Éclairés éclairés ÉCLAIRÉS straße×straße naïveté÷naïveté 日本 Łódźłódź Łódźłódź " * 3, "a"),
        (None, "wordswords WORDSWORDS words_words", None), (None, "wordswords", None), (-5, "wordswords" * 3 + " wordswords", "b"),
    ]
    monkeypatch.setattr(spelling, "_SLICE", 1000)
    got = {r["word"]: r["n"] for r in spelling.word_counts(C.documents(spark, rows), slips=slips).collect()}
    want = counted(rows, slips)
    assert want and got == want


def test_variants_of_very_long_words_and_of_nothing(spark):
    long = "ß" * 30_000
    words = {long: 500, long + "a": 3, "a" + long: 20, long[:-1] + "b": 2, "abcdefg": 2, long[: len(long) // 2]: 7}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r["word"]: tuple(r)[1:] for r in spelling.variants(frame).collect()}
    assert got == grouped(words)
    assert spelling.variants(frame.limit(0)).count() == 0
    assert spelling.spelling_variants(C.documents(spark, [(1, None, "a"), (2, "", "a")])).count() == 0


def test_one_inserted_letter():
    rows = spelling.letter_rows
    cases = [("abcabc", "abcabcx"), ("abcabc", "xabcabc"), ("aaaaaa", "aaaaaaa"), ("abcabc", "abxcabc"), ("abcabc", "bacabcx")]
    for short, long in cases:
        assert spelling.one_inserted(rows([short]), rows([long]))[0] == one_edit(short, long)
