"""Order-dependent operators against plain loops."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescout.operators import admission, logs, numbering, packing


def plain_pack(lengths, cap, least):
    out, batch, count, size = [], 0, 0, 0
    for n in lengths:
        if count == 0:
            count, size = 1, n
            out.append(batch)
        elif size + n + 2 <= cap:
            count, size = count + 1, size + n + 2
            out.append(batch)
        elif count >= least:
            batch, count, size = batch + 1, 1, n
            out.append(batch)
        else:
            out.append(batch)
            batch, count, size = batch + 1, 0, 0
    return out


@pytest.mark.parametrize("seed, cap, least, piece", [(1, 100, 2, 4), (2, 60, 2, 1), (3, 200, 3, 7), (4, 40, 1, 5), (5, 100, 2, 1000)])
def test_packing_equals_the_plain_loop(spark, seed, cap, least, piece):
    rng = random.Random(seed)
    rows, want = [], {}
    for g, n in (("hot", 150), ("same", 60), ("big", 12), ("one", 1)):
        sizes = [rng.choice([6, 9, 30, 55, 120]) for _ in range(n)]
        if g == "same":
            sizes = [17] * n
        if g == "big":
            sizes = [150] * n
        at = sorted(rng.sample(range(n * 3), n))
        rows += [(g, p, "表名:" + "x" * (s - 3)) for p, s in zip(at, sizes)]
        want.update({(g, p): b for p, b in zip(at, plain_pack(sizes, cap, least))})
    rng.shuffle(rows)
    rows.append(("hot", 10_000, "no header"))
    df = spark.createDataFrame(rows, "g string, pos long, block string").repartition(3)
    got = packing.pack_blocks(df, "g", "pos", "block", cap, least, piece)
    assert {(r["g"], r["pos"]): r["batch_no"] for r in got.collect()} == want
    texts = packing.batch_texts(df, got, "g", "pos", "block")
    total = {r["g"]: r["n"] for r in texts.groupBy("g").agg(F.sum(F.size(F.split("batch_text", "\n\n"))).alias("n")).collect()}
    assert total == {"hot": 150, "same": 60, "big": 12, "one": 1}


@pytest.mark.parametrize("seed", range(6))
def test_passages_compose_to_that_of_the_whole_run(seed):
    rng = random.Random(seed)
    cap, least = rng.choice([40, 100, 300]), rng.choice([1, 2, 4])

    def passage(lengths):
        pdf = pd.DataFrame({"g": "g", "piece": 0, "pos": range(len(lengths)), "chars": lengths})
        return packing._passages(packing._summary(cap, least)(pdf))[0]

    lengths = [rng.choice([3, 9, 30, 55, 120]) for _ in range(rng.randint(30, 80))]
    cuts = sorted({0, len(lengths), *rng.sample(range(len(lengths)), 9)})
    first, *rest = [passage(lengths[a:b]) for a, b in zip(cuts, cuts[1:])]
    for p in rest:
        first = first.then(p, cap, least)
    whole = passage(lengths)
    assert (first.n, first.total) == (whole.n, whole.total)
    for x, y in zip(first[2:], whole[2:]):
        assert x.tolist() == y.tolist()


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_a_hot_group_is_packed_through_a_tree(spark, fan):
    rng = random.Random(fan)
    sizes = [rng.choice([6, 9, 30, 55, 120]) for _ in range(700)]
    rows = [("hot", p - 350, "表名:" + "x" * (n - 3)) for p, n in enumerate(sizes)] + [(None, 5, "表名:abc"), ("far", 9000, "表名:abc")]
    df = spark.createDataFrame(rows, "g string, pos long, block string").repartition(5)
    got = packing.pack_blocks(df, "g", "pos", "block", 300, 3, 8, fan)
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    found = {(r["g"], r["pos"]): r["batch_no"] for r in got.collect()}
    assert found.pop((None, 5)) == found.pop(("far", 9000)) == 0
    assert [found["hot", p - 350] for p in range(700)] == plain_pack(sizes, 300, 3)
    assert packing.pack_blocks(df.limit(0), "g", "pos", "block").count() == 0


@pytest.mark.parametrize("n", [1, 5, 6, 11, 23])
def test_merge_keeps_order_and_puts_the_rest_last(spark, n):
    df = spark.createDataFrame([("g", i) for i in range(n)], "g string, batch_no long")
    got = [r["merged_no"] for r in packing.merge_batches(df, "g").orderBy("batch_no").collect()]
    want = list(range(n)) if n <= 5 else [min(i // (n // 5), 4) for i in range(n)]
    assert got == want


def test_chunks_rebuild_the_text(spark):
    texts = ["", "a" * 10, "xyz" * 500, "文" * 513, "b" * 512, "c" * 462]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    rows = packing.chunk_text(df, ["id"], "t").orderBy("id", "chunk_no").collect()
    for i, t in enumerate(texts):
        mine = [r["chunk"] for r in rows if r["id"] == i]
        assert "".join(c[:462] for c in mine[:-1]) + (mine[-1] if mine else "") == t
        assert all(len(c) <= 512 for c in mine)
    parts = packing.split_by_length(df, ["id"], "t", 100).orderBy("id", "batch_no").collect()
    for i, t in enumerate(texts):
        assert "".join(r["part"] for r in parts if r["id"] == i) == t


def plain_admit(events, limit, window):
    held, out = {}, {}
    for k, t, i in sorted(events, key=lambda e: (e[1], e[2])):
        mine = [x for x in held.get(k, []) if t - x < window]
        out[i] = len(mine) < limit
        held[k] = mine + [t] if out[i] else mine
    return out


def as_events(spark, events):
    df = spark.createDataFrame(events, "k long, s long, id long")
    return df.select("k", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "id")


@pytest.mark.parametrize("seed, limit, pieces", [(1, 2, 2), (2, 3, 7), (3, 1, 40), (4, 5, None), (5, 30, 3)])
def test_admission_equals_the_plain_loop(spark, seed, limit, pieces):
    rng = random.Random(seed)
    # Key 0 is hot and stays over its limit for many buckets; the others have pauses.
    events = [(0, rng.randrange(0, 1500), i) for i in range(400)]
    events += [(k, rng.randrange(0, 4000), 1000 * k + i) for k in (1, 2, 3) for i in range(40)]
    got = admission.admit_events(as_events(spark, events), "k", "ts", "id", limit, 10, pieces)
    assert {r["id"]: r["admitted"] for r in got.collect()} == plain_admit(events, limit, 10)


def test_admission_of_equal_times_and_strict_window(spark):
    events = [(1, 0, 1), (1, 0, 2), (1, 0, 3), (1, 10, 4), (1, 10, 5), (1, 10, 6), (1, 19, 7)]
    got = admission.admit_events(as_events(spark, events), "k", "ts", "id", 2, 10, pieces=3)
    assert {r["id"]: r["admitted"] for r in got.collect()} == {1: True, 2: True, 3: False, 4: True, 5: True, 6: False, 7: False}


@pytest.mark.parametrize("pieces", [None, 2, 9, 60])
def test_trailing_counts_across_pieces(spark, pieces):
    rng = random.Random(9)
    # Key 1 holds most events, many of them in a burst within one window.
    events = [(1, rng.choice([rng.randrange(0, 900), 450 + i % 5]), i) for i in range(300)]
    events += [(k, rng.randrange(0, 900), 1000 + i) for k in (2, None) for i in range(100)]
    got = logs.trailing_counts(as_events(spark, events), "k", "ts", 7, pieces)
    assert got.count() == len({(k, t) for k, t, _ in events})
    for r in got.select("k", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "n", "trailing").collect():
        t = r["us"] // 1_000_000
        mine = [s for k, s, _ in events if k == r["k"]]
        assert r["n"] == mine.count(t)
        assert r["trailing"] == sum(t - 7 < s <= t for s in mine)


def test_dense_numbers_and_ids(spark):
    rng = random.Random(4)
    keys = rng.sample(range(-5000, 100000), 777)
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(6)
    rows = numbering.dense_numbers(df, "k", pieces=9).orderBy("k").collect()
    assert [r["n"] for r in rows] == list(range(1, 778))
    empty = spark.createDataFrame([], "id long, k long")
    fresh = numbering.insert_with_ids(empty, df, "k")
    assert fresh.agg(F.min("id"), F.max("id"), F.count_distinct("id")).first()[:] == (1, 777, 777)
    more = numbering.insert_with_ids(fresh, spark.createDataFrame([(5,), (7,)], "k long"), "k")
    assert more.agg(F.max("id")).first()[0] == 779
    one = numbering.dense_numbers(spark.createDataFrame([(3,)], "k long"), "k")
    assert one.first()["n"] == 1
