"""What no bound, no crowd and no other source may change."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tablescout.llm import minhash, mixing, pii, quality, secrets
from tablescout.llm import spans as S
from tests.llm import cases as C


# --- spans ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 4095, 4097, 9000])
def test_running_sums_and_maxima(spark, n):
    rng = random.Random(n)
    x = [rng.randint(-50, 50) for _ in range(n)]
    df = spark.createDataFrame([(x,)], "x array<int>")
    add, top = df.select(
        S.running(F.col("x"), lambda a, b: a + b, 0), S.running(F.col("x"), F.greatest, -99)
    ).collect()[0]
    assert add == [sum(x[:i]) for i in range(n)] if n < 100 else add[-1] == sum(x[:-1])
    assert top == [max([-99, *x[:i]]) for i in range(n)] if n < 100 else top[-1] == max(x[:-1])


def test_many_matches_in_one_text_take_time_in_proportion(spark):
    def run(n):
        text = " ".join(f"é{i}@b.cd password=abc{i:06d}" for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        begin = time.time()
        found = pii.sanitise(docs).collect()[0]["text"]
        ledger, paths = secrets.advance(docs, rules=secrets.BASE_RULES)
        spans = secrets.findings(ledger, paths).collect()[0]["spans"]
        took = time.time() - begin
        assert len(spans) == n and "@" not in found and found.count("<EMAIL>") == n
        want = C.base_spans(text, C.SECRETS)
        assert [(s["start"], s["end"]) for s in spans] == [(s, e) for s, _, e, _ in want]
        return took

    few, many = run(2_000), run(200_000)
    assert many < few + 60


def test_text_is_cut_and_replaced_as_by_slices(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        n = rng.choice([0, 1, 255, 256, 257, 700, 2000])
        text = "".join(rng.choice("aé😀\n ") for _ in range(n))
        places = sorted(rng.randint(0, n) for _ in range(2 * rng.randint(0, 6)))
        cover = [(a, rng.randint(0, 3), rng.randint(a, min(n, a + 400)), "term") for a in places]
        rows.append((i, text, sorted(cover), rng.randint(0, n), rng.randint(0, n)))
    df = spark.createDataFrame(rows, f"i int, text string, cover {S.SPAN}, a int, b int")
    got = df.select(
        "i", S.let(S.chunks(F.col("text")), lambda p: S.cut(p, F.col("a"), F.col("b"))).alias("cut"),
        S.replaced(F.col("text"), F.col("cover"), lambda s: F.lit("<X>")).alias("new"),
    ).collect()
    for r, (_, text, cover, a, b) in zip(sorted(got, key=lambda r: r["i"]), rows):
        assert r["cut"] == text[a:b]
        at, out = 0, []
        for start, _, end, _ in cover:
            if start >= at:
                out += [text[at:start], "<X>"]
            at = max(at, end)
        assert r["new"] == "".join(out) + text[at:]


def test_matches_outside_other_spans(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        found = sorted({(a := rng.randint(0, 90), a + rng.randint(1, 6)) for _ in range(rng.randint(0, 20))})
        base = sorted((a := rng.randint(0, 90), rng.randint(0, 3), a + rng.randint(1, 9), "ip") for _ in range(rng.randint(0, 6)))
        rows.append((i, [(a, b, f"{a}") for a, b in found], base))
    df = spark.createDataFrame(rows, f"i int, found {S.MATCH}, base {S.SPAN}")
    got = {r["i"]: [tuple(m) for m in r["o"]] for r in df.select("i", S.outside(F.col("found"), F.col("base")).alias("o")).collect()}
    for i, found, base in rows:
        assert got[i] == [m for m in found if not any(m[0] < e and s < m[1] for s, _, e, _ in base)]


# --- labels ---------------------------------------------------------------------------------------


def test_labels_without_a_text_take_no_place_of_the_bound(spark):
    rng = random.Random(5)
    docs = C.documents(spark, [(i, None if i % 10 == 0 else C.prose(rng, 30), "a") for i in range(300)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(30_000)], "doc_id long, quality int")
    usable = docs.where("text IS NOT NULL AND crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 <> 1").count()
    assert len(quality.fit(docs, labels, bound=1000).labels) == usable
    assert len(quality.fit(docs, labels, bound=50).labels) == 50


# --- near copies ----------------------------------------------------------------------------------


def test_one_row_of_a_group_stays_where_ids_repeat_or_lack(spark):
    rng = random.Random(6)
    a, b, c = (C.prose(rng, 80) for _ in range(3))
    near = lambda t: t.replace(t.split()[40], "changed", 1)
    rows = [(7, a, "s"), (7, near(a), "s"), (7, b, "s"), (7, b, "t"), (None, c, "s"), (None, near(c), "s"), (None, near(b), "s")]
    rows += [(None, "", "s"), (None, "", "s"), (None, None, "s"), (9, " \n", "s"), (9, " \n", "s"), (10, a, "s")]
    docs = C.documents(spark, rows)
    kept = [(r["doc_id"], r["text"]) for r in minhash.without_near_duplicates(docs).collect()]
    words = [(i, t) for i, t in kept if t and t.strip()]
    assert len(words) == 3 and {i for i, _ in words} == {7, None}
    assert {t for i, t in words if i == 7} <= {a, near(a), b} and len([1 for i, _ in words if i == 7]) == 2
    assert len(kept) - len(words) == 5
    again = minhash.without_near_duplicates(docs.repartition(7)).collect()
    assert sorted(map(str, kept)) == sorted(str((r["doc_id"], r["text"])) for r in again)


# --- mixing ---------------------------------------------------------------------------------------


def test_a_small_source_lands_as_well_beside_a_large_one(spark):
    rng = random.Random(7)
    # Long documents, so that a landing with two choices misses by much.
    small = [(i, " ".join(["w"] * rng.randint(300, 900)), "z") for i in range(60)]
    large = [(1000 + i, " ".join(["w"] * rng.randint(1, 9)), "a") for i in range(3000)]
    for rows in (small + large, small + large[:600]):
        got = [r for r in mixing.mix(C.documents(spark, rows), block_rows=64).collect() if r["source"] == "z"]
        goal, taken = got[0]["target"], sum(r["taken"] for r in got)
        assert abs(taken - goal) <= 60, (taken, goal)


def test_a_crowd_without_ids_and_words_is_mixed(spark):
    rows = [(None, "", "a")] * 500 + [(None, "x y z", "a")] * 500 + [(i, "one two", "b") for i in range(100)]
    docs = C.documents(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(r["taken"] == 0 for r in got if r["size"] == 0)
    out = mixing.mixed_documents(docs)
    assert out.count() == sum(r["copies"] for r in got)
