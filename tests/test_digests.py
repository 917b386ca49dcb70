"""Change detection by digests: classes as by plain comparison, and work that grows with the changes."""

import random

import pytest
from pyspark.sql import functions as F

from tablescout.operators import diff, digests

SCHEMA = "db_name string, schema_name string, table_name string, hash string"


def versions(seed, n, changes):
    rng = random.Random(seed)
    keys = [(f"t{i % 5}", None if i % 7 == 0 else f"s{i % 31}", f"x{i}") for i in range(n)]
    old = {k: f"h{i}" for i, k in enumerate(keys)}
    cur = dict(old)
    for k in rng.sample(keys, changes):
        kind = rng.randrange(3)
        if kind == 0:
            cur[k] += "x"
        elif kind == 1:
            del cur[k]
        else:
            cur[(k[0], k[1], k[2] + "new")] = "n"
    return cur, old


def frame(spark, rows):
    return spark.createDataFrame([(*k, h) for k, h in rows.items()], SCHEMA).repartition(4)


@pytest.mark.parametrize(("n", "changes"), [(0, 0), (1, 1), (400, 0), (400, 25), (400, 400)])
def test_classes_are_those_of_a_plain_comparison(spark, n, changes):
    cur, old = versions(n + changes, n, changes)
    got = {}
    for r in diff.snapshot_diff(frame(spark, cur), frame(spark, old)).collect():
        got[r["db_name"], r["schema_name"], r["table_name"]] = (r["cur_hash"], r["old_hash"], r["change"])
    plain = lambda rows: {(d, s or "", t): h for (d, s, t), h in rows.items()}
    cur, old = plain(cur), plain(old)
    want = {}
    for k in {*cur, *old}:
        change = "added" if k not in old else "deleted" if k not in cur else "modified" if cur[k] != old[k] else "same"
        want[k] = (cur.get(k), old.get(k), change)
    assert got == want


def touched(spark, n, changes):
    cur, old = versions(3, n, changes)
    rows = diff._sides(diff.with_key(frame(spark, cur)), diff.with_key(frame(spark, old)), diff.KEY, ["hash"])
    some, alike = digests.split_by_change(rows, [*diff.KEY, "hash"])
    some, alike = some.groupBy("_side").count().collect(), alike.count()
    assert sum(r["count"] for r in some if r["_side"] == 1) + alike == len(cur)
    return sum(r["count"] for r in some)


def test_rows_brought_together_grow_with_the_changes(spark):
    assert touched(spark, 20_000, 0) == 0
    few, many = touched(spark, 20_000, 10), touched(spark, 20_000, 100)
    # A leaf holds a handful of these keys, on either side.
    assert 10 <= few <= 300 and 100 <= many <= 3_000
    assert touched(spark, 60_000, 10) <= 4 * few


def test_nulls_and_moved_values_change_a_digest(spark):
    rows = lambda pairs: frame(spark, {("d", "s", t): h for t, h in pairs})
    count = lambda a, b: diff.snapshot_diff(rows(a), rows(b)).where("change <> 'same'").count()
    assert count([("a", "1"), ("b", "2")], [("a", "2"), ("b", "1")]) == 2
    assert count([("a", None), ("b", "2")], [("a", "1"), ("b", "2")]) == 1
    assert count([("a", "1")], []) == count([], [("a", "1")]) == 1


def test_only_moved_items_come_back(spark):
    cur, old = versions(9, 500, 20)
    stored = frame(spark, old).withColumnRenamed("hash", "text_hash").withColumns({
        "provider": F.lit("local"), "has_vector": F.col("table_name") != "x3",
    })
    current = frame(spark, cur).withColumnRenamed("hash", "text_hash")
    every = diff.classify(current, stored, "local")
    some = diff.moved(current, stored, "local")
    key = lambda df: sorted(map(str, df.where("status <> 'unchanged'").collect()))
    assert key(every) == key(some) and some.where("status = 'unchanged'").count() == 0
    assert every.count() == len({*cur, *old})
