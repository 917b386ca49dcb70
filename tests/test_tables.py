"""Diffs, versions, sync, sources, guarded SQL and streams."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.operators import catalog_text, diff, filters, logs, upsert
from tablescout.plans import guarded_sql, sync
from tablescout.sources import catalog, ingest, lineage, log_sink, relational, snapshots
from tablescout.streaming import admission as stream_admission
from tablescout.streaming import log_append, monitor
from tests.test_folds import plain_admit

ITEM = "db_name string, schema_name string, table_name string, vector_text string"


def items(spark, rows):
    return spark.createDataFrame(rows, ITEM)


def now():
    return F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")


FIRST = [("d", "a", "t1", "text one"), ("d", None, "t2", "text two"), ("e", "a", "t1", "other tenant")]
SECOND = [("d", "a", "t1", "text one changed"), ("d", "a", "t3", "text three"), ("e", "a", "t1", "other tenant")]


def statuses(df):
    return {(r["db_name"], r["schema_name"], r["table_name"], r["provider"]): r["status"] for r in df.collect()}


def test_sync_classes_and_idempotence(spark):
    empty = spark.createDataFrame([], sync.STORED)
    one = lineage.cut_lineage(sync.incremental_sync(items(spark, FIRST), empty, now()))
    assert set(statuses(one).values()) == {"new"} and one.count() == 6
    two = lineage.cut_lineage(sync.incremental_sync(items(spark, SECOND), sync.store(one), now()))
    got = statuses(two)
    assert got[("d", "a", "t1", "local")] == "changed"
    assert got[("d", "", "t2", "api")] == "removed"
    assert got[("d", "a", "t3", "api")] == "new"
    assert got[("e", "a", "t1", "local")] == "unchanged"
    assert two.where("status = 'removed' AND embedding IS NOT NULL").count() == 0
    three = sync.incremental_sync(items(spark, SECOND), sync.store(two), now())
    assert set(statuses(three).values()) == {"unchanged", "gone"}
    kept = {tuple(r[:4]): r["embedding"] for r in three.select(*sync.ITEM, "embedding").collect()}
    assert kept == {tuple(r[:4]): r["embedding"] for r in two.select(*sync.ITEM, "embedding").collect()}


def test_hash_per_provider(spark):
    """A change seen by one provider is still a change for the other."""
    stored = spark.createDataFrame(
        [("d", "a", "t", "local", "new-hash", True), ("d", "a", "t", "api", "old-hash", True)],
        "db_name string, schema_name string, table_name string, provider string, text_hash string, has_vector boolean",
    )
    current = spark.createDataFrame([("d", "a", "t", "new-hash")], "db_name string, schema_name string, table_name string, text_hash string")
    got = {r["provider"]: r["status"] for r in diff.classify(current, stored).collect()}
    assert got == {"local": "unchanged", "api": "changed"}
    lost = diff.classify(current, stored.withColumn("has_vector", F.lit(False)), "local").first()
    assert lost["status"] == "changed"


def test_diff_classes_cover_the_key_union(spark):
    cur, old = items(spark, FIRST), items(spark, SECOND)
    h = lambda df: df.select(*diff.KEY, F.md5("vector_text").alias("hash"))
    out = diff.snapshot_diff(h(cur), h(old))
    counts = {r["change"]: r["count"] for r in out.groupBy("change").count().collect()}
    assert counts == {"added": 1, "deleted": 1, "modified": 1, "same": 1}
    null_hash = h(old).withColumn("hash", F.lit(None).cast("string"))
    assert diff.snapshot_diff(h(cur), null_hash).where("change = 'modified'").count() == 2


def test_fingerprint_changes_with_any_edit(spark):
    def mark(rows):
        return {r["db_name"]: r["fingerprint"] for r in diff.fingerprint(items(spark, rows), ["db_name"]).collect()}

    base = mark(FIRST)
    assert mark(list(reversed(FIRST))) == base
    assert mark(SECOND)["e"] == base["e"] and mark(SECOND)["d"] != base["d"]
    # Texts swapped between two items are a change too.
    swapped = [("d", "a", "t1", "text two"), ("d", None, "t2", "text one")]
    assert mark(swapped)["d"] != base["d"]


def test_gate_actions_and_check_and_sync(spark):
    first = items(spark, FIRST)
    vectors = sync.store(sync.rebuild_all(first, now()))
    stored = lineage.cut_lineage(vectors.unionByName(vectors.limit(1).withColumn("schema_name", F.lit("hg_recyclebin"))))
    prints = lineage.cut_lineage(diff.fingerprint(first, ["db_name"]))
    quiet = {r["db_name"]: r["action"] for r in sync.check_tenants(first, stored, prints).collect()}
    assert quiet == {"d": "none", "e": "none"}
    holes = stored.withColumn("embedding", F.when(~((F.col("db_name") == "e") & (F.col("provider") == "api")), F.col("embedding")))
    assert {r["db_name"]: r["action"] for r in sync.check_tenants(first, holes, prints).collect()} == {"d": "none", "e": "fill"}
    after = sync.check_and_sync(items(spark, SECOND), holes, prints, now())
    assert after.where("schema_name = 'hg_recyclebin'").count() == 0
    live = {tuple(r) for r in after.where("embedding IS NOT NULL").select("db_name", "table_name", "provider").collect()}
    assert live == {(d, t, p) for d, t in (("d", "t1"), ("d", "t3"), ("e", "t1")) for p in ("local", "api")}


def test_upserts(spark):
    key = ["schema_name", "table_name"]
    t = "schema_name string, table_name string, note string, extra int, updated_at timestamp_ntz"
    stored = spark.createDataFrame([(None, "a", "old", 1, None), ("s", "b", "keep", 2, None)], t)
    new = spark.createDataFrame([("", "a", "new"), ("s", "c", "add")], "schema_name string, table_name string, note string")
    got = {r["table_name"]: (r["note"], r["extra"], r["updated_at"] is not None) for r in upsert.bulk_upsert(stored, new, key, now()).collect()}
    assert got == {"a": ("new", 1, True), "b": ("keep", 2, False), "c": ("add", None, True)}
    pk = spark.createDataFrame([("k", 1, "x"), ("k", 3, "z"), ("m", 1, "y")], "id string, at int, v string")
    upd = spark.createDataFrame([("k", 2, "w"), ("n", 1, "q")], "id string, at int, v string")
    assert {r["id"]: r["v"] for r in upsert.pk_upsert(pk, upd, ["id"], "at").collect()} == {"k": "z", "m": "y", "n": "q"}
    nulls = spark.createDataFrame([("a", None), ("b", "x"), ("c", "y")], "k string, s string")
    assert {r["k"] for r in upsert.delete_where(nulls, F.col("s") == "x").collect()} == {"a", "c"}
    wide = upsert.add_missing_columns(nulls, T.StructType([T.StructField("s", T.IntegerType()), T.StructField("z", T.LongType())]))
    assert wide.schema["s"].dataType == T.StringType() and wide.schema["z"].dataType == T.LongType()


def test_resolve_strict_and_loose(spark):
    tables = spark.createDataFrame([("d", "a", "t"), ("d", "b", "t"), ("d", "b", "u")], "db_name string, schema_name string, table_name string")
    wanted = spark.createDataFrame(
        [(1, 0, "d", "b.t"), (1, 1, "d", "t"), (1, 2, "d", "a.u"), (1, 3, "d", "zz.u"), (1, 4, "d", "none")],
        "request_id int, pos int, db_name string, name string",
    )
    loose = {r["pos"]: (r["schema_name"], r["match"]) for r in catalog_text.resolve_names(wanted, tables).collect()}
    assert loose == {0: ("b", "exact"), 1: ("a", "fallback"), 2: ("b", "fallback"), 3: ("b", "fallback"), 4: (None, "missing")}
    strict = {r["pos"]: r["match"] for r in catalog_text.resolve_names(wanted, tables, strict_schema=True).collect()}
    assert strict == {0: "exact", 1: "fallback", 2: "missing", 3: "fallback", 4: "missing"}


def test_filters(spark):
    df = spark.createDataFrame([("bi", "x"), ("BI", "y"), (None, "z")], "s string, t string")
    assert [r["t"] for r in df.where(filters.in_list(F.col("s"), " bi, ")).collect()] == ["x"]
    assert {r["t"] for r in df.where(filters.in_list(F.col("s"), "Bi", ignore_case=True)).collect()} == {"x", "y"}
    assert df.where(filters.in_list(F.col("s"), " , ")).count() == 3
    hidden = spark.createDataFrame([("pg_toast", "a"), ("pgx", "a"), ("s", "a_middle_b"), ("s", "amiddle"), ("s", "amiddleb"), ("knowledge", "a")], "s string, t string")
    # In a LIKE pattern "_" stands for any one character.
    assert {(r["s"], r["t"]) for r in hidden.where(filters.visible_items(F.col("s"), F.col("t"))).collect()} == set()
    assert hidden.where(filters.visible_items(F.col("s"), F.col("t"), schema_like=["pg!_%"], table_like=[])).count() >= 3
    odd = spark.createDataFrame([(float("nan"), 1.0), (float("inf"), None), (1.5, float("-inf"))], "a double, b double")
    assert [tuple(r) for r in filters.finite_or_null(odd).collect()] == [(None, 1.0), (None, None), (1.5, None)]
    assert filters.any_row(odd) and not filters.any_row(odd.where("a = 7"))
    shown = filters.preview(spark.range(1200).withColumnRenamed("id", "n"), ["n"]).collect()
    assert len(shown) == 500 and shown[0]["total_rows"] == 1200


def test_snapshots_are_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    assert snapshots.current_version(spark, root) == 0
    with pytest.raises(ValueError):
        snapshots.read_snapshot(spark, root)
    assert snapshots.write_snapshot(spark.range(3).toDF("id"), root) == 1
    held = snapshots.read_snapshot(spark, root)
    assert snapshots.write_snapshot(held.where("id < 2"), root) == 2
    # A version that was read stays readable.
    assert held.count() == 3 and snapshots.read_snapshot(spark, root).count() == 2
    # An unfinished version has no commit and is not seen.
    spark.range(9).write.parquet(f"{root}/v=00000003")
    assert snapshots.current_version(spark, root) == 2
    assert snapshots.write_snapshot(spark.range(5).toDF("id"), root) == 3
    assert snapshots.read_snapshot(spark, root).count() == 5


def test_parts_keep_other_tenants(spark, tmp_path):
    root, schema = str(tmp_path / "p"), "db_name string, v long"
    make = lambda rows: spark.createDataFrame(rows, schema)
    read = lambda w=None: {tuple(r) for r in snapshots.read_parts(spark, root, schema, "db_name", w).collect()}
    assert read() == set()
    snapshots.write_parts(make([("007", 1), ("a/b", 2), ("c", 3)]), root, "db_name", make([("007", 0), ("a/b", 0), ("c", 0)]))
    snapshots.write_parts(make([("007", 9)]), root, "db_name", make([("007", 0), ("c", 0)]))
    assert read() == {("007", 9), ("a/b", 2)}
    assert read(make([("a/b", 0), ("zz", 0)])) == {("a/b", 2)}


def test_ingest(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write(" order id,amount,is_ok,at,名称\n1,2.5,true,2024-01-02 03:04:05,甲\n2,3.5,false,2024-01-03 00:00:00,乙\n")
    out = ingest.ingest(spark, path, "my upload-1!")
    assert out == {"table_name": "tmp.my_upload_1", "row_count": 2, "columns": ["order_id", "amount", "is_ok", "at", "名称"]}
    types = dict(spark.table("tmp.my_upload_1").dtypes)
    assert types["order_id"] == "bigint" and types["amount"] == "double" and types["is_ok"] == "boolean"
    assert types["at"].startswith("timestamp") and types["名称"] == "string"
    with open(path, "w") as f:
        f.write("a,b\n")
    with pytest.raises(ValueError):
        ingest.ingest(spark, path, "x")
    with pytest.raises(ValueError):
        ingest.clean_table_name("!!")
    cols = catalog.session_columns(spark, "d", "tmp")
    assert [r["column_name"] for r in cols.where("table_name = 'my_upload_1'").orderBy("column_order").collect()] == out["columns"]
    spark.sql("DROP TABLE tmp.my_upload_1")


def test_catalog_reads_comments(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS cat1")
    spark.sql("CREATE TABLE cat1.t (id BIGINT COMMENT 'key', v STRING) USING parquet COMMENT 'a table'")
    rows = [tuple(r) for r in catalog.session_columns(spark, "d", "cat1").orderBy("column_order").collect()]
    assert rows == [("d", "cat1", "t", "a table", 1, "id", "bigint", "key"), ("d", "cat1", "t", "a table", 2, "v", "string", "")]
    spark.sql("DROP TABLE cat1.t")
    plain = catalog.frame_columns(spark, "d", {"r": spark.range(1)})
    assert catalog_text.table_list(plain).first()["columns"] == ["id"]
    assert catalog_text.schema_cards(plain).first()["card"] == "表名: r\n列:\n    id [bigint]"


def test_relational_options():
    reg = relational.Registry(
        {
            "pg": {"type": "postgresql", "host": "h", "name": "db", "user": "u", "password": "p"},
            "none": {"type": "postgresql", "host": "None", "name": "x"},
            "lite": {"type": "sqlite", "file_path": "/x.db"},
            "off": {"type": "sqlite", "file_path": "/y.db"},
        },
        excluded={"off"},
    )
    assert reg.available() == ["pg", "lite"]
    o = relational.jdbc_options(reg.get("pg"), "s.t")
    assert o["url"] == "jdbc:postgresql://h:5432/db?sslmode=prefer" and o["user"] == "u" and o["dbtable"] == "s.t"
    assert relational.jdbc_options(reg.get("lite"), "t")["url"] == "jdbc:sqlite:/x.db"
    with pytest.raises(ValueError):
        reg.get("zz")
    with pytest.raises(ValueError):
        relational.jdbc_options({"type": "oracle"}, "t")


def test_log_sink_and_history(spark, tmp_path):
    path = str(tmp_path / "log")
    runs = spark.createDataFrame(
        [(i, "d", f"2024-01-{1 + i % 3:02d} 10:00:00", "vector" if i % 2 else "all") for i in range(30)],
        "id int, db_name string, at string, mode string",
    ).select(
        "id", "db_name", F.col("at").cast("timestamp_ntz").alias("created_at"), F.col("mode").alias("search_mode"),
        F.lit(None).cast("string").alias("selected_table"), F.lit(True).alias("use_vectors"), F.lit(7).alias("top_k"),
        F.array(F.lit("s.表")).alias("matched_tables"), F.repeat(F.lit("e"), 2000).alias("error_message"),
    )
    log_sink.append_runs(runs, path)
    log = spark.read.parquet(path)
    row = log.where("id = 1").first()
    assert json.loads(row["matched_tables"]) == ["s.表"] and len(row["error_message"]) == 1000 and row["top_k"] == 7
    page = logs.history(log, "d", 500, "2024-01-02", "2024-01-02", tie="id").collect()
    assert len(page) == 10 and all(str(r["created_at"]).startswith("2024-01-02") for r in page)
    assert len(logs.history(log, "d", 0).collect()) == 1
    assert logs.history(log, "d", 9, search_mode="all").where("search_mode <> 'all'").count() == 0


@pytest.mark.parametrize(
    "sql", ["", "delete from t", "selection", "select 1; drop table x", "with a as (select 1) insert into t select 1", "hello select 1",
     "with q as (select 1 as a) insert overwrite table t select a from q", "with q as (select 1) merge into t using q on true when matched then delete",
     "with q as (select 1) update a.b x set c = 1"]
)
def test_guard_rejects(spark, sql):
    with pytest.raises(ValueError):
        guarded_sql.run_sql(spark, sql)


def test_guard_reads_no_literals_for_the_statement_test(spark):
    assert guarded_sql.run_sql(spark, "select 'merge into t' as a, 'insert overwrite' as b").count() == 1


def test_guard_runs_and_restores_settings(spark):
    before = spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers")
    df = guarded_sql.run_sql(spark, '```sql\nselect 1 as "26x" -- c\n```')
    assert df.columns == ["26x"] and df.first()[0] == 1
    with pytest.raises(Exception):
        guarded_sql.run_sql(spark, "select nothing_here")
    assert spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers") == before
    assert guarded_sql.date_pattern("YYYY-MM-DD HH24:MI:SS") == "yyyy-MM-dd HH:mm:ss"
    out = guarded_sql.spark_names("select x::text, cast(y as int8) from t where a similar to 'b%' and unnest(z)")
    assert out == "select x::string, cast(y as bigint) from t where a rlike '^(?:b.*)$' and explode(z)"


def test_run_logged(spark, tmp_path):
    path = str(tmp_path / "log")
    df = guarded_sql.run_logged(spark, "select id, cast('NaN' as double) as x, timestamp_ntz'2024-01-02 03:04:05' as t from range(3)", "d", path)
    assert [tuple(r) for r in df.orderBy("id").limit(1).collect()] == [(0, None, "2024-01-02 03:04:05")]
    with pytest.raises(ValueError):
        guarded_sql.run_logged(spark, "drop table x", "d", path)
    rows = {r["execute_status"]: (r["result_rows"], r["search_mode"]) for r in spark.read.parquet(path).collect()}
    assert rows == {"success": (3, "manual_sql"), "failed": (0, "manual_sql")}


def _announce(folder, name, at, path):
    with open(f"{folder}/{name}.json", "w") as f:
        f.write(json.dumps({"snapshot_at": at, "path": path}) + "\n")


def test_monitor_applies_snapshots_once(spark, tmp_path):
    markers = tmp_path / "markers"
    markers.mkdir()
    root, check = str(tmp_path / "vectors"), str(tmp_path / "check")
    for n, rows in ((1, FIRST), (2, SECOND)):
        items(spark, rows).write.parquet(str(tmp_path / f"s{n}"))
        _announce(markers, f"m{n}", f"2024-01-0{n} 00:00:00", str(tmp_path / f"s{n}"))
    monitor.watch(spark, str(markers), root, check, once=True).awaitTermination(120)
    got = snapshots.read_parts(spark, root, sync.STORED, "db_name")
    assert {(r["db_name"], r["table_name"]) for r in got.collect()} == {("d", "t1"), ("d", "t3"), ("e", "t1")}
    assert got.count() == 6
    # The unchanged tenant stays in the folder of the first version.
    folders = {f.split("/v=")[1].split("-")[0] for f in got.inputFiles()}
    assert folders == {"00000001", "00000002"}
    version = snapshots.current_version(spark, root)
    # The same content again writes no version, and seen markers are not read twice.
    _announce(markers, "m3", "2024-01-03 00:00:00", str(tmp_path / "s2"))
    monitor.watch(spark, str(markers), root, check, once=True).awaitTermination(120)
    assert snapshots.current_version(spark, root) == version


def test_stream_admission_matches_the_plain_loop(spark, tmp_path):
    rows = [(k, t * 3 + k, 100 * k + t) for k in (1, 2) for t in range(40)]
    src, out, check = str(tmp_path / "ev"), str(tmp_path / "out"), str(tmp_path / "check")
    df = spark.createDataFrame(rows, "k long, s long, id long").select("k", F.timestamp_seconds("s").alias("ts"), "id")
    df.where("id % 100 < 20").coalesce(1).write.parquet(src)

    def drain():
        stream = spark.readStream.schema("k long, ts timestamp, id long").parquet(src)
        decided = stream_admission.admit_stream(stream, "k", "ts", "id", limit=2, seconds=10)
        decided.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out).awaitTermination(180)

    drain()
    # The second run goes on from the stored state.
    df.where("id % 100 >= 20").coalesce(1).write.mode("append").parquet(src)
    drain()
    got = {r["id"]: r["admitted"] for r in spark.read.parquet(out).collect()}
    assert got == plain_admit(rows, 2, 10)


def test_log_stream_appends(spark, tmp_path):
    src, out, check = str(tmp_path / "runs"), str(tmp_path / "log"), str(tmp_path / "check")
    runs = spark.range(5).select(
        F.col("id"), F.lit("d").alias("db_name"), F.lit("2024-01-02 00:00:00").cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("string").alias("search_mode"), F.lit("t").alias("selected_table"), F.lit(True).alias("use_vectors"),
        F.lit(3).alias("top_k"), F.array(F.lit("a")).alias("matched_tables"), F.lit("x").alias("error_message"),
    )
    runs.write.parquet(src)
    for _ in range(2):
        stream = spark.readStream.schema(runs.schema).parquet(src)
        log_append.append_stream(stream, out, check, once=True).awaitTermination(120)
    log = spark.read.parquet(out)
    assert log.count() == 5 and log.where("search_mode = 'selected_table' AND top_k IS NULL").count() == 5


def test_checkpoint_folder_of_the_session_is_kept(spark):
    folder = lineage.checkpoint_folder(spark)
    assert folder and lineage.checkpoint_folder(spark) == folder
    assert lineage.cut_lineage(spark.range(3)).count() == 3
