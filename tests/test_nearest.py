"""Nearest neighbours against brute force."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablescout.operators import encode, nearest
from tablescout.plans import search


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 8)).astype(np.float32)
    # Copies of one vector: a third of all rows are equal, ids decide.
    base[::3] = base[0]
    return base


@pytest.fixture(scope="module")
def corpus(spark, points):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(points)] + [(999, None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)


def brute(points, q, k):
    d = np.round(((points.astype(float) - q.astype(float)) ** 2).sum(axis=1), 9)
    order = np.lexsort((np.arange(len(d)), d))[:k]
    return [(int(i), float(d[i])) for i in order]


def as_queries(spark, points, n):
    return spark.createDataFrame(
        [(i, [float(x) for x in points[i]]) for i in range(n)], "query_id long, query_vector array<float>"
    )


@pytest.mark.parametrize("k", [1, 7, 50, 500])
def test_knn_batch_equals_brute_force(spark, points, corpus, k):
    got = {}
    for r in nearest.knn_batch(corpus, as_queries(spark, points, 9), k).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(9):
        mine = [(i, s) for _, i, s in sorted(got[q])]
        want = brute(points, points[q], k)
        assert [i for i, _ in mine] == [i for i, _ in want]
        assert np.allclose([s for _, s in mine], [s for _, s in want])


def test_many_blocks_give_the_same(spark, points, corpus, monkeypatch):
    whole = {tuple(r) for r in nearest.knn_batch(corpus, as_queries(spark, points, 20), 6).collect()}
    monkeypatch.setattr(nearest, "BLOCK_BYTES", 8 * 8 * 3)
    monkeypatch.setattr(nearest, "_TILE", 2)
    assert {tuple(r) for r in nearest.knn_batch(corpus, as_queries(spark, points, 20), 6).collect()} == whole


def test_no_queries(spark, points, corpus):
    assert nearest.knn_batch(corpus, as_queries(spark, points, 0), 3).count() == 0


def test_topk_exact_filter_and_small_population(spark, points, corpus):
    q = F.array(*[F.lit(float(x)) for x in points[5]])
    got = nearest.topk_exact(corpus, q, 4).collect()
    assert [r["vec_id"] for r in got] == [i for i, _ in brute(points, points[5], 4)]
    few = nearest.topk_exact(corpus, q, 10, condition=F.col("vec_id") < 3).collect()
    assert [r["rank"] for r in few] == [1, 2, 3]


def test_inner_product_threshold(spark, points, corpus):
    q = points[7].astype(float)
    got = nearest.topk_inner_product(corpus, F.array(*[F.lit(x) for x in q.tolist()]), 5, 3.0).collect()
    dots = points.astype(float) @ q
    want = sorted(((-round(d, 9), i) for i, d in enumerate(dots) if round(d, 9) >= 3.0))[:5]
    assert [r["vec_id"] for r in got] == [i for _, i in want]


def test_rank_explain_counts_ties_by_id(spark, points, corpus):
    targets = as_queries(spark, points, 6).withColumn("target_id", F.lit(30).cast("long"))
    for r in nearest.rank_explain(corpus, targets).collect():
        full = [i for i, _ in brute(points, points[r["query_id"]], 120)]
        assert r["target_rank"] == full.index(30) + 1
        assert r["population"] == 120
    missing = nearest.rank_explain(corpus, as_queries(spark, points, 1).withColumn("target_id", F.lit(5000).cast("long"))).first()
    assert missing["target_rank"] is None and missing["population"] == 120


def test_approx_is_exact_when_all_cells_are_probed_and_falls_back(spark, points, corpus):
    queries = as_queries(spark, points, 8)
    centers = nearest.fit_cells(corpus, 6)
    exact = {tuple(r) for r in nearest.knn_batch(corpus, queries, 5).collect()}
    placed = nearest.assign_cells(corpus, centers)
    assert placed.count() == 120
    assert {tuple(r) for r in nearest.knn_approx(placed, queries, centers, 5, probes=len(centers)).collect()} == exact
    # One cell never holds 100 rows of 120 here, so every query is searched again exactly.
    wide = {tuple(r) for r in nearest.knn_approx(placed, queries, centers, 100, probes=1).collect()}
    assert wide == {tuple(r) for r in nearest.knn_batch(corpus, queries, 100).collect()}


def test_approx_recall_on_embeddings(spark):
    corpus = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    queries = corpus.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    exact = nearest.knn_batch(corpus, queries, 5)
    centers = nearest.fit_cells(corpus, 8)
    approx = nearest.knn_approx(nearest.assign_cells(corpus, centers), queries, centers, 5, probes=4)
    recall = exact.join(approx, ["query_id", "vec_id"]).count() / exact.count()
    assert recall > 0.6


def test_encoder_keeps_keys_and_nulls(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "ab"), (4, "订单金额")], "id long, t string")
    got = {r["id"]: r["embedding"] for r in encode.encode(df, "t", lambda: encode.hashed_ngrams(32), batch=2).collect()}
    assert got[2] is None
    assert np.isclose(np.linalg.norm(got[1]), 1) and np.isclose(np.linalg.norm(got[4]), 1)
    assert np.allclose(got[3], 0)
    again = {r["id"]: r["embedding"] for r in encode.encode(df.repartition(3), "t", lambda: encode.hashed_ngrams(32)).collect()}
    assert again == got


def test_service_encoder_retries():
    calls = {}

    def call(t):
        calls[t] = calls.get(t, 0) + 1
        if calls[t] < 3:
            raise OSError("busy")
        return [3.0, 4.0]

    out = encode.service_encoder(call, attempts=3, wait=0.0)(["a", "b"])
    assert np.allclose(out, [[0.6, 0.8], [0.6, 0.8]]) and calls == {"a": 3, "b": 3}
    with pytest.raises(OSError):
        encode.service_encoder(lambda t: (_ for _ in ()).throw(OSError()), attempts=2, wait=0.0)(["a"])


def test_search_questions_finds_the_same_text(spark):
    items = encode.encode(
        spark.createDataFrame([(1, "orders by nation"), (2, "supplier balance"), (3, "web pages")], "vec_id long, t string"), "t"
    )
    ask = spark.createDataFrame([(10, "balance of a supplier")], "query_id long, question string")
    assert search.search_questions(ask, items, 1).first()["vec_id"] == 2
    empty = items.where("vec_id > 5")
    assert search.search_or_build(ask, empty, lambda: items, 2).count() == 2


def test_tenants_lists_and_own_k(spark, points):
    rows = [(f"i{i:03d}", "ab"[i % 2], f"s{i % 3}", [float(x) for x in v]) for i, v in enumerate(points)]
    corpus = spark.createDataFrame(rows, "item string, db string, schema_name string, embedding array<float>")
    asked = [(i, "abc"[i % 3], i + 1, [None, ["s0"], [], ["s1", "s9"]][i % 4], [float(x) for x in points[i]]) for i in range(12)]
    queries = spark.createDataFrame(asked, "query_id long, db string, k int, listed array<string>, query_vector array<float>")
    got = {}
    for r in nearest.knn_batch(corpus, queries, id_col="item", by=["db"], k_col="k", listed="listed").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for i, db, k, listed, _ in asked:
        d = np.round(((points.astype(float) - points[i].astype(float)) ** 2).sum(axis=1), 9)
        order = [j for j in np.lexsort((np.arange(len(d)), d)) if rows[j][1] == db and (not listed or rows[j][2] in listed)]
        assert sorted(got.get(i, [])) == [(n + 1, rows[j][0]) for n, j in enumerate(order[:k])]


def test_blocks_of_rows_send_on_what_is_within_the_bound(spark, points, corpus, monkeypatch):
    whole = {tuple(r) for r in nearest.knn_batch(corpus, as_queries(spark, points, 30), 4).collect()}
    monkeypatch.setattr(nearest, "BLOCK_BYTES", 8 * 8 * 25)
    assert {tuple(r) for r in nearest.knn_batch(corpus, as_queries(spark, points, 30), 4).collect()} == whole


@pytest.mark.parametrize("rows", [1000, 25])
def test_many_queries_are_dealt_to_several_tasks(spark, points, corpus, monkeypatch, rows):
    """One block of rows, or a few, must not leave all pairs to as few tasks."""
    whole = {tuple(r) for r in nearest.knn_batch(corpus, as_queries(spark, points, 120), 4).collect()}
    met, plain = [], nearest._met
    monkeypatch.setattr(nearest, "LEAST_QUERIES", 5)
    monkeypatch.setattr(nearest, "BLOCK_BYTES", 8 * 8 * rows)
    monkeypatch.setattr(nearest, "_met", lambda left, right, *a: met.append(right) or plain(left, right, *a))
    assert {tuple(r) for r in nearest.knn_batch(corpus, as_queries(spark, points, 120), 4).collect()} == whole
    # Copies of one vector share a cell, whose queries are dealt out as well.
    assert all(right.select("_qb").distinct().count() >= 8 for right in met[-2:])
    assert met[0].groupBy("_qb").agg(F.countDistinct("query_id").alias("n")).agg(F.max("n")).first()[0] < 60


@pytest.mark.parametrize("shift", [0.0, 1e4])
def test_cells_prune_and_lose_nothing(spark, monkeypatch, shift):
    rng = np.random.default_rng(5)
    centre = 30 * rng.normal(size=(12, 6))
    points = (np.repeat(centre, 60, axis=0) + rng.normal(size=(720, 6)) + shift).astype(np.float32)
    points[100:160] = points[100]
    corpus = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(points)], "vec_id long, embedding array<float>")
    corpus = corpus.repartition(4)
    asked = corpus.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    want = {(q, i, n + 1) for q in range(720) for n, (i, _) in enumerate(brute(points, points[q], 7))}
    met = []
    plain = nearest._met
    monkeypatch.setattr(nearest, "BLOCK_BYTES", 8 * 6 * 40)
    monkeypatch.setattr(nearest, "_met", lambda left, right, *a: met.append((left, right)) or plain(left, right, *a))
    got = {(r["query_id"], r["vec_id"], r["rank"]) for r in nearest.knn_batch(corpus, asked, 7).collect()}
    assert got == want
    # Far fewer pairs than all: blocks meet the queries that may find something in them.
    pairs = 0
    for left, right in met:
        n = left.groupBy(*nearest._BLOCK_KEY).count().join(right.groupBy(*nearest._BLOCK_KEY).agg(F.count("k").alias("q")), nearest._BLOCK_KEY)
        pairs += n.agg(F.sum(F.col("count") * F.col("q"))).first()[0] or 0
    assert len(met) == 2 and pairs < 0.4 * 720 * 720


def test_rows_dealt_grow_with_the_rows(spark):
    def dealt(n):
        rows = spark.range(n).select(F.lit("").alias("_t"), "id", F.array(F.rand(1), F.rand(2)).alias("v"))
        asked = rows.select("_t", F.col("id").alias("query_id"), F.col("v").alias("qv"))
        left, right, most = nearest._dealt(rows, asked, False)
        return left.count() + right.count()

    assert dealt(20_000) <= 20 * dealt(2_000)


def test_vectors_of_different_lengths_are_an_error(spark):
    ragged = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0, 4.0])], "vec_id long, embedding array<float>")
    ask = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "query_id long, query_vector array<float>")
    with pytest.raises(Exception, match="differ in length"):
        nearest.knn_batch(ragged, ask, 1).collect()
    with pytest.raises(Exception, match="differ in length"):
        nearest.knn_batch(ragged.where("vec_id = 1"), ask, 1).collect()


def test_explain_lists_the_first_hits(spark, points, corpus):
    targets = as_queries(spark, points, 3).withColumn("target_id", F.lit(30).cast("long"))
    for r in nearest.rank_explain(corpus, targets, first=15).collect():
        assert r["first_hits"] == [i for i, _ in brute(points, points[r["query_id"]], 15)]


def test_build_is_asked_for_the_tenant_and_provider(spark):
    t = "vec_id long, db_name string, provider string, t string"
    items = encode.encode(spark.createDataFrame([(1, "d", "local", "orders"), (2, "e", "api", "pages")], t), "t")
    ask = spark.createDataFrame([(10, "orders")], "query_id long, question string")
    asked = []

    def build():
        asked.append(1)
        return items

    assert search.search_or_build(ask, items, build, 5, "d", "local").count() == 1 and not asked
    assert search.search_or_build(ask, items, build, 5, "d", "api").count() == 2 and asked == [1]


def block_tables(rows, asked, k, marks=None, listed=None):
    def vectors(m):
        return pa.array([[float(x) for x in v] for v in m], pa.list_(pa.float32()))

    left = {"id": np.arange(len(rows)), "v": vectors(rows)}
    right = {"query_id": np.arange(len(asked)), "qv": vectors(asked), "k": np.full(len(asked), k, np.int32), "bound": np.full(len(asked), np.inf)}
    if marks:
        left["mark"], right["listed"] = pa.array(marks), pa.array(listed, pa.list_(pa.string()))
    return pa.table(left), pa.table(right)


def test_memory_of_a_block_with_lists_does_not_grow_with_rows_times_queries(monkeypatch):
    monkeypatch.setattr(nearest, "_TILE", 1 << 14)
    rng = np.random.default_rng(9)
    points, seen = rng.normal(size=(8000, 4)).astype(np.float32), [["a"], None, [], ["b", "none"], ["none"]]
    marks = [("a", "b", None)[i % 3] for i in range(8000)]
    left, right = block_tables(points, points, 2, marks, [seen[i % 5] for i in range(8000)])
    run = nearest._best_in_block(pa.int64(), pa.int64())
    tracemalloc.start()
    try:
        got = run(left, right).to_pydict()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # A bit for each pair alone would be 64 MB.
    assert peak < 24 * 1024 * 1024
    hits = {}
    for q, i in zip(got["query_id"], got["vec_id"]):
        hits.setdefault(q, []).append(i)
    for q in range(0, 8000, 397):
        own = [i for i in range(8000) if not seen[q % 5] or marks[i] in seen[q % 5]]
        assert hits.get(q, []) == [own[i] for i, _ in brute(points[own], points[q], 2)], q


@pytest.mark.parametrize("spread", [1.0, 1e-4, 0.0])
def test_few_pairs_of_a_block_are_measured_in_full(monkeypatch, spread):
    measured, plain = [], nearest._scores
    monkeypatch.setattr(nearest, "_scores", lambda r, q: measured.append(len(r)) or plain(r, q))
    rng = np.random.default_rng(11)
    points = rng.normal(size=(6000, 16)).astype(np.float32)
    # A third of the rows are near or equal copies of one vector, far from the origin.
    points[::3] = points[0] + spread * points[::3]
    points += 3
    left, right = block_tables(points, points[:600], 5)
    got = nearest._best_in_block(pa.int64(), pa.int64())(left, right).to_pydict()
    for q in range(0, 600, 7):
        mine = [i for n, i in enumerate(got["vec_id"]) if got["query_id"][n] == q]
        assert mine == [i for i, _ in brute(points, points[q], 5)]
    assert sum(measured) < 0.1 * 6000 * 600
