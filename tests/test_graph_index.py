"""Neighbour graph against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescout.operators import graph_index


def brute(x, q, k):
    d = ((x[None, :, :] - q[:, None, :]) ** 2).sum(axis=2)
    return np.sort(d, axis=1)[:, :k]


def test_recall_and_rows_compared(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("embedding IS NOT NULL")
    x = np.array([r["embedding"] for r in df.collect()], dtype=float)
    graph = graph_index.build_graph(df)
    asked = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    rows = graph_index.search_graph(graph, asked, 10, compared=True).collect()
    got, seen = {}, {}
    for r in rows:
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"]))
        seen[r["query_id"]] = r["compared"]
    queries = {r["query_id"]: np.array(r["query_vector"], dtype=float) for r in asked.collect()}
    want = brute(x, np.array([queries[q] for q in sorted(queries)]), 10)
    hit = sum(s <= w[-1] + 1e-9 for q, w in zip(sorted(queries), want) for _, s in got[q])
    print("recall", hit / want.size, "compared", np.mean(list(seen.values())), len(x))
    assert all([r for r, _ in sorted(h)] == list(range(1, 11)) for h in got.values())
    assert hit / want.size >= 0.9
    assert np.mean(list(seen.values())) <= 0.5 * len(x)


@pytest.mark.parametrize("block", [1024, 16])
def test_clusters_and_copies(spark, monkeypatch, block):
    """Copies are one node and come back by id; clusters are found from the entries."""
    monkeypatch.setattr(graph_index, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 8)) * 4
    x = np.vstack([centre[i % 6] + rng.normal(size=8) * 0.3 for i in range(180)])
    rows = [(i, x[i].tolist()) for i in range(180)] + [(1000 + i, x[7].tolist()) for i in range(40)] + [(5000, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in (0, 7, 50)] + [(99, None)], "query_id long, query_vector array<double>")
    graph = graph_index.build_graph(df, degree=6)
    got = {}
    for r in graph_index.search_graph(graph, asked, 5, beam=24, width=4).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == {0, 7, 50}
    assert [got[7][r] for r in range(1, 6)] == [(7, 0.0), *[(1000 + i, 0.0) for i in range(4)]]
    every = np.vstack([x, np.repeat(x[7:8], 40, axis=0)])
    for q in (0, 50):
        assert np.allclose([got[q][r][1] for r in range(1, 6)], brute(every, x[q : q + 1], 5)[0], atol=1e-8)


def test_no_rows_and_one_row(spark):
    schema = "vec_id long, embedding array<double>"
    asked = spark.createDataFrame([(1, [0.0, 1.0])], "query_id long, query_vector array<double>")
    none = graph_index.build_graph(spark.createDataFrame([], schema))
    assert graph_index.search_graph(none, asked, 3).count() == 0
    one = graph_index.build_graph(spark.createDataFrame([(4, [0.0, 3.0])], schema))
    assert [tuple(r) for r in graph_index.search_graph(one, asked, 3).collect()] == [(1, 4, 4.0, 1)]
