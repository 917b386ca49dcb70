"""Mixing to target weights against plain arithmetic."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablescout.llm import mixing
from tests.llm import cases as C

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets_share_all_and_stop_at_three_times():
    assert mixing.targets([("a", 100), ("b", 100), ("c", 100)]) == {"a": 187.5, "b": 75.0, "c": 37.5}
    got = mixing.targets([("a", 10), ("b", 1000), (None, 1000)])
    assert got["a"] == 30 and got["b"] == pytest.approx(1980 * 2 / 3) and got[None] == pytest.approx(660)
    assert mixing.targets([("a", 0), ("b", 5)])["a"] == 0
    assert mixing.targets([]) == {}
    # Weights repeat, by code point.
    many = mixing.targets([(f"s{i}", 100) for i in range(6)])
    assert many["s0"] == many["s3"] and many["s1"] == many["s4"]


def test_walk_keeps_both_sums_until_the_landing():
    rng = np.random.default_rng(0)
    size, chance = rng.integers(1, 500, 300).astype(float), 0.37
    state, done = [], []
    for i, s in enumerate(size):
        mixing._walk(state, s, chance, i, rng, done)
    assert len(state) <= 2
    words = sum(size[i] for i, taken in done if taken) + sum(s[0] * s[1] for s in state)
    number = sum(taken for _, taken in done) + sum(s[1] for s in state)
    assert words == pytest.approx(chance * size.sum(), rel=1e-6) and number == pytest.approx(chance * 300, rel=1e-6)


def test_every_document_keeps_its_chance():
    hits = Counter()
    for seed in range(400):
        rng, state, done = np.random.default_rng(seed), [], []
        for i in range(12):
            mixing._walk(state, float(1 + i * i), 0.4, i, rng, done)
        hits.update(i for i, taken in done if taken)
        hits.update({s[2]: s[1] for s in state})
    assert all(abs(hits[i] / 400 - 0.4) < 0.12 for i in range(12))


def run(docs, **options):
    return [r.asDict() for r in mixing.mix(docs, **options).collect()]


@pytest.mark.parametrize("block_rows", [1024, 8])
def test_mix_meets_its_targets(spark, block_rows):
    rng = random.Random(4)
    rows = C.awkward(4) + [(1000 + i, C.prose(rng, rng.randint(1, 60)), rng.choice(["a", "a", "b", "c", "d", None])) for i in range(400)]
    docs = C.documents(spark, rows)
    got = run(docs, block_rows=block_rows)
    assert len(got) == len(rows)
    sizes, by = Counter(), defaultdict(list)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    goal = mixing.targets(list(sizes.items()))
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        by[r["source"]].append(r)
    for s, own in by.items():
        taken = sum(r["taken"] for r in own)
        # One document holds most words of this source, so no whole number of copies comes near.
        assert s == "b" or abs(taken - goal[s]) <= max(30, 0.01 * goal[s]), s
        base = int(goal[s] / sizes[s] + 1e-9)
        assert all(r["copies"] in (base, base + 1) for r in own if r["size"])
    key = lambda rows: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"]) for r in rows)
    assert key(run(docs.repartition(9), block_rows=block_rows)) == key(got)


def test_mixed_documents_repeat_or_go(spark):
    rows = [r for r in C.awkward(5) if r[0] != 4]
    docs = C.documents(spark, rows)
    copies = Counter()
    for r in run(docs):
        copies[r["doc_id"], r["source"], r["size"]] += r["copies"]
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in out.collect())
    assert got == Counter({k: n for k, n in copies.items() if n})


def test_a_source_without_words_and_an_empty_table(spark):
    docs = C.documents(spark, [(1, None, "a"), (2, "", "a"), (3, "x y", "b")])
    got = {r["doc_id"]: r for r in run(docs)}
    assert got[1]["taken"] == got[2]["taken"] == 0 and got[1]["target"] == 0 and got[3]["taken"] == 2
    empty = docs.where("false")
    assert run(empty) == [] and mixing.mixed_documents(empty).count() == 0
