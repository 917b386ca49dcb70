"""Near-duplicate texts and vectors, and nearest neighbours, against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tablescout.llm import embedding_dedup, graph, minhash, neighbours
from tests.llm import cases as C


def edited(rng, text, n):
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = "x%d" % rng.randrange(10**6)
    return " ".join(words)


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 150)] + [(200, 200), (300, 301), (301, 300)]
    links += [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(200)]
    parent = {x: x for link in links for x in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(x, x) == root(x) for x in parent)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signatures_agree_as_often_as_texts_are_alike():
    rng = random.Random(2)
    base = [C.prose(rng, 250) for _ in range(40)] + [C.prose(rng, 9) for _ in range(10)]
    texts = [t for b in base for t in (b, edited(rng, b, rng.randint(1, 2)))]
    texts += ["a b c " * 40, "a b c " * 60]
    text, shingle, _ = minhash.shingles(pa.array(texts))
    signature = minhash.dart_signatures(*minhash.weighted(text, shingle), len(texts), 192)
    off = []
    for i in range(0, len(texts), 2):
        a, b = C.shingles(texts[i]), C.shingles(texts[i + 1])
        alike = sum((a & b).values()) / sum((a | b).values())
        off.append((signature[i] == signature[i + 1]).mean() - alike)
    assert abs(np.mean(off)) < 0.015 and np.std(off) < 0.05
    # Whatever stands beside a text in a batch, its signature is the same.
    one = minhash.dart_signatures(*minhash.weighted(*minhash.shingles(pa.array(texts[3:4]))[:2]), 1, 192)
    assert (one[0] == signature[3]).all()


def check_groups(spark, rows, **options):
    docs = C.documents(spark, rows)
    got = minhash.near_duplicates(docs, **options).collect()
    assert len(got) == len(rows)
    texts = [t for _, t, _ in rows]
    group = C.near_groups(texts, 0.8)
    names = {}
    for g, (i, t, _) in zip(group, rows):
        if i is not None:
            names[g] = min(names.get(g, i), i)
    want = sorted(
        (str(i), str(names.get(g) if C.shingles(t) else i)) for g, (i, t, _) in zip(group, rows)
    )
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return docs, got


@pytest.mark.parametrize("block", [512, 3])
def test_near_groups_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BLOCK_WORDS", 1000 * block)
    rng = random.Random(3)
    rows = C.awkward(3)
    one = C.prose(rng, 120)
    # A crowd around one text, at similarities on both sides of the threshold.
    rows += [(100 + i, edited(rng, one, rng.randint(0, 5)), "s") for i in range(70)]
    # A chain whose ends are far apart.
    for i in range(12):
        rows.append((300 + i, one := edited(rng, one, 2), "s"))
    passage = C.prose(rng, 60)
    rows += [(400 + i, f"{C.prose(rng, 40)} {passage} {C.prose(rng, 40)}", "s") for i in range(40)]
    rows += [(500, "Ein ÄPFEL Ö", "s"), (501, "ein äpfel  ö", "s"), (502, "ein äpfel ö ü", "s")]
    rows = [(i if i != 7 else 70 + n, t, s) for n, (i, t, s) in enumerate(rows)]
    docs, got = check_groups(spark, rows)
    kept = minhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = sorted(str(r["doc_id"]) for r in got if r["kept"])
    assert sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect()) == want


def test_repeated_rows_keep_one(spark):
    rng = random.Random(4)
    same, other = C.prose(rng, 30), C.prose(rng, 30)
    docs = C.documents(spark, [(7, same, "a"), (7, same, "a"), (8, same, "a"), (9, other, "a"), (1, None, "a"), (2, None, "a")])
    assert sorted(r["doc_id"] for r in minhash.without_near_duplicates(docs).collect()) == [1, 2, 7, 9]
    # One id for two texts: both stay.
    docs = C.documents(spark, [(7, same, "a"), (7, other, "a"), (7, other, "a")])
    assert sorted(r["text"] for r in minhash.without_near_duplicates(docs).collect()) == sorted([same, other])


def test_no_documents(spark):
    docs = C.documents(spark, [(1, "x", "s")]).where("false")
    assert minhash.near_duplicates(docs).count() == 0 and minhash.without_near_duplicates(docs).count() == 0


def vectors(seed=1, n=400, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    # A third of the rows lie close to one vector, some are equal, some are scaled copies.
    x[: n // 3] = x[0] + rng.normal(size=(n // 3, d)) * 0.2
    x[n // 3 : n // 3 + 30] = x[n - 1]
    x[n // 3 + 30 : n // 3 + 40] = 7.5 * x[n - 2]
    return x.astype(np.float32)


def frame(spark, x, extra=True):
    rows = [(i, [float(v) for v in r], "c", 1, 2) for i, r in enumerate(x)]
    if extra:
        bad = ([0.0] * x.shape[1], None, [float("nan")] + [1.0] * (x.shape[1] - 1), [None] + [1.0] * (x.shape[1] - 1))
        bad += ([float("inf")] + [1.0] * (x.shape[1] - 1),)
        rows += [(10_000 + i, v, "c", 1, 2) for i, v in enumerate(bad)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell string, id int, node int").repartition(4)


def unit(x):
    x = x.astype(float)
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("block", [2048, 16])
def test_vector_links_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block)
    monkeypatch.setattr(embedding_dedup, "GUEST_ROWS", 2 * block)
    x = vectors()
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicate_vectors(frame(spark, x), similarity=0.9, cell_rows=64).collect()}
    linked = unit(x) @ unit(x).T >= 0.9
    np.fill_diagonal(linked, False)
    component = np.arange(len(x))
    while True:
        low = np.where(linked, component[None, :], len(x)).min(axis=1)
        after = np.minimum(component, low)
        if (after == component).all():
            break
        component = after
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert found >= 0.99 * linked.sum()
    assert all(got[i]["n_links"] <= linked[i].sum() for i in range(len(x)))
    assert np.mean([got[i]["component_id"] == component[i] for i in range(len(x))]) > 0.99
    for i in range(10_000, 10_005):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)


@pytest.mark.parametrize("block", [2048, 16])
def test_vectors_of_low_rank_miss_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block)
    monkeypatch.setattr(embedding_dedup, "GUEST_ROWS", 2 * block)
    rng = np.random.default_rng(9)
    # Three active directions of 64, so that differences are not spread over all dimensions.
    x = (rng.normal(size=(500, 3)) @ rng.normal(size=(3, 64))).astype(np.float32)
    got = embedding_dedup.near_duplicate_vectors(frame(spark, x, False), cell_rows=16).collect()
    linked = unit(x) @ unit(x).T >= 0.95
    np.fill_diagonal(linked, False)
    assert {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate(linked.sum(axis=1).tolist()))


def test_guests_reach_every_partner():
    rng = np.random.default_rng(10)
    for d in (2, 3, 16, 64):
        x = unit(rng.normal(size=(300, d)))
        # Partners just within the threshold, on the line between a vector and a centre.
        centre = embedding_dedup.spherical_centres(x, 12)
        near = x @ centre.T
        other = centre[np.argsort(-near, axis=1)[:, min(1, len(centre) - 1)]]
        across = unit(other - (other * x).sum(axis=1)[:, None] * x)
        x = np.concatenate([x, unit(0.951 * x + np.sqrt(1 - 0.951**2) * across)])
        near = x @ centre.T
        own = near.argmax(axis=1)
        visits = embedding_dedup.guest_cells(near, own, centre, 0.95)
        a, b = np.nonzero((x @ x.T >= 0.95) & (own[:, None] > own[None, :]))
        assert len(a) and visits[a, own[b]].all()


def test_one_cell_misses_no_link(spark):
    x = vectors(2, 200)
    got = embedding_dedup.near_duplicate_vectors(frame(spark, x, False), similarity=0.9, cell_rows=1000).collect()
    linked = unit(x) @ unit(x).T >= 0.9
    assert {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate((linked.sum(axis=1) - 1).tolist()))


def test_vectors_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (3, [0.01, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicate_vectors(df).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (3, 2, 1)]


def test_empty_and_ragged_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicate_vectors(df.where("false")).count() == 0
    index = neighbours.MultiIndex(df.where("false"))
    assert index.search(df.where("false")).count() == 0
    with pytest.raises(Exception, match="differ in length"):
        embedding_dedup.near_duplicate_vectors(df).count()


def test_walk_goes_by_summed_distance():
    rng = np.random.default_rng(5)
    first, second = rng.random(9), rng.random(7)
    rows = rng.integers(0, 3, 63)
    order = sorted(range(63), key=lambda c: first[c // 7] + second[c % 7])
    for wanted in (1, 10, 40, 1000):
        held, want = 0, []
        for c in order:
            if held >= wanted:
                break
            if rows[c]:
                want.append(c)
                held += rows[c]
        assert neighbours.walk(first, second, rows, wanted) == want


def brute_nearest(x, q, k):
    score = unit(x) @ unit(x[q : q + 1])[0]
    score[q] = -9
    return np.lexsort((np.arange(len(x)), -score))[:k], score


@pytest.mark.parametrize("block", [1024, 20])
def test_search_is_exact_when_all_cells_are_walked(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 10)
    x = vectors(6)
    df = frame(spark, x)
    found = neighbours.MultiIndex(df, cell_rows=16).search(df.where("vec_id % 25 = 0"), 5, share=1.0).collect()
    got = {}
    for r in found:
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == {i for i in range(len(x)) if i % 25 == 0}
    for q, hits in got.items():
        want, score = brute_nearest(x, q, 5)
        assert sorted(hits) == [1, 2, 3, 4, 5]
        mine = [hits[r] for r in sorted(hits)]
        assert np.allclose([s for _, s in mine], score[want], atol=1e-12)
        assert np.allclose([score[v] for v, _ in mine], [s for _, s in mine], atol=1e-12)
        gaps = np.abs(np.diff(score[want])) > 1e-9
        if gaps.all():
            assert [v for v, _ in mine] == want.tolist()


def test_recall_at_the_usual_share(spark):
    x = vectors(7, 3000, 32)
    df = frame(spark, x, False)
    hit = total = 0
    got = {}
    for r in neighbours.MultiIndex(df).search(df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q, mine in got.items():
        want, score = brute_nearest(x, q, 5)
        hit += sum(score[v] >= score[want[-1]] - 1e-12 for v in mine)
        total += 5
    assert hit / total >= 0.9


@pytest.mark.parametrize("scale", ["0.01", "0.1"])
def test_recall_and_rows_compared_on_the_given_vectors(spark, scale):
    """The walk stops at the share that the index measured: recall 0.9 from at most half of the rows."""
    df = spark.read.parquet(f"/root/testdata/sf{scale}/embeddings.parquet")
    index, asked = neighbours.MultiIndex(df), df.where("vec_id % 50 = 0")
    rows = {r["vec_id"]: r["embedding"] for r in df.select("vec_id", "embedding").collect()}
    ids = np.array(sorted(rows))
    x = unit(np.array([rows[i] for i in ids], dtype=float))
    got = {}
    for r in index.search(asked).collect():
        got.setdefault(r["query_id"], []).append(r["score"])
    hit = total = 0
    for q, scores in got.items():
        want, score = brute_nearest(x, int(np.flatnonzero(ids == q)[0]), 5)
        hit += sum(s >= score[want[-1]] - 1e-12 for s in scores)
        total += 5
    assert hit / total >= 0.9
    compared = [r["compared"] for r in index.walked(asked).collect()]
    assert len(compared) == len(got) and np.mean(compared) <= 0.5 * len(x)


def test_blocks_hold_whole_cells_or_parts_of_one(monkeypatch):
    rows = np.array([0, 3, 4, 25, 0, 2, 9, 10, 1])
    low, count = neighbours.blocks_of(rows, 10)
    assert count.tolist() == [1, 1, 1, 3, 1, 1, 1, 1, 1]
    held = {}
    for c, n in enumerate(rows):
        for i in range(count[c]):
            held.setdefault(low[c] + i, []).append(c)
    assert all(sum(rows[c] for c in cells) <= 10 or len([c for c in cells if rows[c]]) == 1 for cells in held.values())


def test_equal_vectors_go_by_the_smaller_id(spark, monkeypatch):
    """Ties between copies, also where one cell is split into blocks."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 8)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 60)] + [(i, [3.0, -1.0, 0.5]) for i in range(100, 140)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.MultiIndex(df).search(df.where("vec_id IN (0, 50, 100)"), 4, share=1.0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert {q: [v[i] for i in (1, 2, 3, 4)] for q, v in got.items()} == {
        0: [1, 2, 3, 4], 50: [0, 1, 2, 3], 100: [101, 102, 103, 104],
    }


def test_few_candidates_give_all(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = neighbours.MultiIndex(df).search(df.where("vec_id % 50 = 0"), 5)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got.collect()) == [
        (0, 1, 50, 1.0), (0, 2, 3, 0.0), (50, 1, 0, 1.0), (50, 2, 3, 0.0),
    ]
