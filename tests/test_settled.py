"""Admission in event time and footers read in tasks."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tablescout.operators import catalog_text
from tablescout.sources import footers
from tablescout.streaming import settled
from tests.test_folds import plain_admit

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, settled.STORE)
    yield
    spark.conf.unset(name)


def test_settled_admission_equals_the_batch_form(spark, tmp_path, state_store):
    """Rows out of order, over a restart; a late end moves the watermark past all."""
    # The second half has rows from before the first half's end, inside the delay.
    rows = [(k, 1000 + t * 3 + k, 100 * k + t) for k in (1, 2) for t in range(40)]
    hot = [(3, 1000 + (t * 37 % 300), 1000 + t) for t in range(600)]
    ends = [(k, 100_000, 9000 + k) for k in (1, 2, 3)]
    src, out, check = str(tmp_path / "ev"), str(tmp_path / "out"), str(tmp_path / "check")
    df = spark.createDataFrame(rows + hot, "k long, s long, id long").withColumn("k", F.when(F.col("k") != 2, F.col("k")))
    shaped = df.select("k", F.timestamp_seconds("s").alias("ts"), "id")
    part = F.pmod(F.xxhash64("id"), F.lit(2))

    def drain():
        stream = spark.readStream.schema("k long, ts timestamp, id long").parquet(src)
        decided = settled.admit_settled(stream, "k", "ts", "id", limit=2, seconds=10, delay="400 seconds")
        decided.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out).awaitTermination(180)

    shaped.where(part == 0).write.parquet(src)
    drain()
    assert spark.read.parquet(out).count() == 0
    shaped.where(part == 1).write.mode("append").parquet(src)
    drain()
    last = spark.createDataFrame(ends, "k long, s long, id long").select("k", F.timestamp_seconds("s").alias("ts"), "id")
    last.coalesce(1).write.mode("append").parquet(src)
    drain()
    got = {r["id"]: (r["k"], r["admitted"]) for r in spark.read.parquet(out).collect()}
    want = plain_admit(rows + hot, 2, 10)
    assert {i: a for i, (_, a) in got.items()} == want
    assert {i: k for i, (k, _) in got.items()} == {i: (None if k == 2 else k) for k, _, i in rows + hot}
    assert 0 < sum(want.values()) < len(want)


def test_footers_equal_those_of_another_reader(spark, tmp_path):
    import os

    root = tmp_path / "db"
    root.mkdir()
    os.symlink(DATA, root / "main")
    made = spark.range(3).select("id", F.array(F.lit(1.5)).alias("v")).withMetadata("id", {"comment": "key"})
    made.write.parquet(str(root / "own" / "t"))
    (root / "own" / "notes.txt").write_text("no table")
    (root / "none").mkdir()
    rows = footers.footer_columns(spark, "d", str(root))
    assert rows.rdd.getNumPartitions() == 3
    got = {(r["table_name"], r["column_order"], r["column_name"]) for r in rows.where("schema_name = 'main'").collect()}
    want = set()
    for f in sorted(os.listdir(DATA)):
        names = duckdb.sql(f"SELECT * FROM '{DATA}/{f}' LIMIT 0").columns
        want |= {(f.removesuffix(".parquet"), n, c) for n, c in enumerate(names, 1)}
    assert got == want and len({t for t, _, _ in want}) >= 14
    types = {(r["table_name"], r["column_name"]): r["data_type"] for r in rows.where("schema_name = 'main'").collect()}
    for t in {t for t, _ in types}:
        for f in spark.read.parquet(f"{DATA}/{t}.parquet").schema:
            assert types[t, f.name] == f.dataType.simpleString()
    own = [tuple(r)[1:] for r in rows.where("schema_name = 'own'").orderBy("column_order").collect()]
    assert own == [("own", "t", "", 1, "id", "bigint", "key"), ("own", "t", "", 2, "v", "array<double>", "")]
    assert catalog_text.schema_cards(rows.where("schema_name = 'own'")).first()["card"].startswith("表名: own.t")
