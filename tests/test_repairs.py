"""Rows that used to be lost, ties, and texts that are more than queries."""

import pytest
from pyspark.sql import functions as F

from tablescout.operators import admission, encode, filters, logs, packing, sized, upsert
from tablescout.plans import guarded_sql, sync
from tablescout.sources import lineage
from tablescout.streaming import monitor

ATTACKS = (
    "WITH x AS (SELECT 1 a) INSERT/**/INTO guarded_target SELECT a FROM x",
    r"WITH x AS (SELECT '\'' s) INSERT OVERWRITE TABLE guarded_target SELECT 7 FROM x WHERE s <> '\''",
    "WITH x AS (SELECT 1 a) MERGE/**/INTO guarded_target USING x ON guarded_target.a = x.a WHEN MATCHED THEN DELETE",
    "WITH x AS (SELECT 1 a) FROM x INSERT/**/INTO guarded_target SELECT a",
    "SELECT TRANSFORM(a) USING 'id -u' AS (u string) FROM guarded_target",
    "WITH x AS (SELECT TRANSFORM(a) USING 'id' AS (u string) FROM guarded_target) SELECT * FROM x",
    "SELECT reflect('java.lang.System', 'nanoTime')",
    "SELECT (SELECT max(java_method('java.lang.System', 'nanoTime')) FROM guarded_target)",
    "SELECT 1 WHERE EXISTS (SELECT system.builtin.try_reflect('java.lang.System', 'nanoTime'))",
    "SELECT * FROM text.`/etc/hostname`",
    "SELECT (",
)


@pytest.mark.parametrize("sql", ATTACKS)
def test_only_queries_run(spark, sql):
    spark.sql("CREATE TABLE IF NOT EXISTS guarded_target (a INT) USING parquet")
    with pytest.raises(Exception, match="only SELECT queries|TABLE_OR_VIEW_NOT_FOUND|cannot be parsed"):
        guarded_sql.run_sql(spark, sql)
    assert spark.table("guarded_target").count() == 0
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"


def test_names_are_mapped_outside_literals_only(spark):
    sql = "SELECT 'unnest(x) a::text' AS a, \"as int8)\", 1::int8 /* ::text */ -- ::text"
    assert guarded_sql.spark_names(sql) == "SELECT 'unnest(x) a::text' AS a, \"as int8)\", 1::bigint /* ::text */ -- ::text"
    q = "SELECT 'axb' SIMILAR TO 'a.b%' AS no, 'a.bc' SIMILAR TO 'a.b%' AS yes, 'x^' SIMILAR TO '_^' AS hat, 'b' SIMILAR TO '[a-c]|q' AS any"
    assert tuple(guarded_sql.run_sql(spark, q, compat=True).first()) == (False, True, True, True)


def test_null_schemas_pass_the_check(spark):
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    items = spark.createDataFrame([("d", "s", "t1", "x")], "db_name string, schema_name string, table_name string, vector_text string")
    rows = [("e", None, "t2", "local", "h", [1.0], None), ("e", "pg_toast", "t3", "local", "h", [1.0], None)]
    stored = spark.createDataFrame(rows, sync.STORED)
    prints = spark.createDataFrame([], "db_name string, fingerprint string")
    got = {(r["db_name"], r["schema_name"], r["table_name"]) for r in sync.check_and_sync(items, stored, prints, now).collect()}
    assert got == {("d", "s", "t1"), ("e", "", "t2")}


def test_unknown_providers_keep_their_rows(spark):
    rows = spark.createDataFrame([("local", "abc"), ("other", "abc"), (None, "abc")], "provider string, x string")
    got = {r["provider"]: r["embedding"] is not None for r in encode.encode_for_providers(rows, "x", {"local": encode.hashed_ngrams}).collect()}
    assert got == {"local": True, "other": False, None: False}


def test_batched_grams_equal_single_texts():
    texts = ["abcd", "", None, "ab", "日本語日本語", "a😀b😀", "abc" * 50]
    make = encode.hashed_ngrams(16)
    assert all((make(texts)[i] == make([t])[0]).all() for i, t in enumerate(texts))
    assert make([]).shape == (0, 16) and make(["", None]).shape == (2, 16)


def test_times_keep_their_fraction(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00.123456' AS a, timestamp_ntz'2024-01-01 00:00:00' AS b, date'2024-01-02' AS c")
    assert tuple(filters.finite_or_null(df).first()) == ("2024-01-01 00:00:00.123456", "2024-01-01 00:00:00", "2024-01-02")


def test_upserts_name_unknown_columns_and_settle_ties(spark):
    stored = spark.createDataFrame([("k", 1, "zzz")], "id string, at int, v string")
    new = spark.createDataFrame([("k", 1, "aaa")], "id string, at int, v string")
    assert upsert.pk_upsert(stored, new, ["id"], "at").first()["v"] == "aaa"
    with pytest.raises(ValueError, match="extra"):
        upsert.bulk_upsert(stored, new.withColumn("extra", F.lit(1)), ["id"], F.current_timestamp())


def test_null_keys_and_times_get_decisions(spark):
    rows = [(None, i * 30, i) for i in range(41)] + [("a", 0, 100), ("a", None, 101), ("", 5, 102)]
    df = spark.createDataFrame(rows, "k string, s long, id long").select("k", F.timestamp_seconds("s").cast("timestamp_ntz").alias("t"), "id")
    got = {r["id"]: (r["k"], r["admitted"]) for r in admission.admit_events(df, "k", "t", "id", limit=1, seconds=60, pieces=2).collect()}
    assert len(got) == 44
    assert all(got[i] == (None, i % 2 == 0) for i in range(41))
    assert got[100] == ("a", True) and got[101] == ("a", False) and got[102] == ("", True)
    counts = {(r["k"], r["t"] is None): (r["n"], r["trailing"]) for r in logs.trailing_counts(df.where("k = 'a'"), "k", "t", 60).collect()}
    assert counts == {("a", False): (1, 1), ("a", True): (1, None)}


def test_groups_without_headers_are_cut_by_length(spark):
    rows = [("g", i, "x" * (i % 7) + chr(97 + i % 26) * 5) for i in range(300)] + [("h", 1, "表名: a"), ("h", 2, "tail"), ("n", 5, None)]
    df = spark.createDataFrame(rows, "g string, pos long, block string")
    parts = packing.headerless_parts(df, "g", "pos", "block", 100, 16)
    got = {(r["g"], r["batch_no"]): r["batch_text"] for r in packing.headerless_texts(parts, "g", "pos").collect()}
    whole = "\n\n".join(b for g, _, b in rows if g == "g")
    assert got == {("g", i // 100): whole[i : i + 100] for i in range(0, len(whole), 100)}


def test_keys_are_measured_in_bytes(spark):
    keys = spark.createDataFrame([("ab", 1), (None, 2)], "s string, n long")
    assert sized.measured_bytes(keys) == 2 * 16 + 2
    hinted = lambda df: "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(sized.broadcast_if_small(keys)) and not hinted(sized.broadcast_if_small(keys, 10))


def test_a_tenant_without_items_is_cleared(spark, tmp_path):
    schema = "db_name string, schema_name string, table_name string, vector_text string"
    root = str(tmp_path / "v")
    both = spark.createDataFrame([("d", "s", "t", "x"), ("e", "s", "t", "y")], schema)
    monitor.apply_snapshot(both, root)
    counts = monitor.apply_snapshot(both.where("db_name = 'd'"), root, tenants=["d", "e"])
    assert counts["removed"] == 2 and counts["new"] == 0
    from tablescout.sources import snapshots

    left = snapshots.read_parts(spark, root, sync.STORED, "db_name")
    assert {r["db_name"] for r in left.collect()} == {"d"}


def test_a_checkpoint_folder_must_be_named():
    class Context:
        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        lineage.checkpoint_folder(Session())


def test_contexts_and_their_none_texts(spark):
    from tablescout.operators import scoring
    from tablescout.plans import context

    cards = spark.createDataFrame([("d", "s", "a", "表名: s.a", 1), ("d", "s", "b", "表名: s.b", 2)], "db_name string, schema_name string, table_name string, card string, pos long")
    asked = spark.createDataFrame([(1, 0, "d", "s.b", "s", "b"), (1, 1, "d", "a", "s", "a"), (1, 2, "d", "x", None, None), (2, 0, "d", "x", None, None), (2, 1, "d", "y.z", None, None)],
        "request_id long, pos int, db_name string, name string, schema_name string, table_name string")
    got = {r["request_id"]: r["context"] for r in context.cards_selected(asked, cards).collect()}
    assert got == {1: "表名: s.b\n\n表名: s.a", 2: "未找到指定的表: x, y.z"}
    tenants = spark.createDataFrame([("d",), ("e",)], "db_name string")
    got = {r["db_name"]: r["context"] for r in context.tenant_contexts(cards, "pos", tenants).collect()}
    assert got == {"d": "表名: s.a\n\n表名: s.b", "e": "无可用表结构"}
    choice = spark.createDataFrame([(1, "named", 1, "s", "a"), (2, "nearest", 2, "s", "a"), (2, "nearest", 1, "s", "b"), (3, "nearest", 1, "q", "z"), (4, "named", 1, "q", "z"), (5, "all", None, None, None)],
        "request_id long, scope string, rank int, schema_name string, table_name string")
    requests = spark.createDataFrame([(i, "d") for i in range(1, 6)], "request_id long, db_name string")
    got = {r["request_id"]: (r["scope"], r["context"]) for r in context.question_context(choice, requests, cards).collect()}
    assert got == {1: ("named", "表名: s.a"), 2: ("nearest", "表名: s.b\n\n表名: s.a"), 3: ("nearest", "未找到指定的表: q.z"), 4: ("all", None), 5: ("all", None)}
    none = spark.createDataFrame([], "db_name string, id long, term string, definition string, question string, sql string")
    assert {r["db_name"]: r["examples"] for r in scoring.few_shot(none, tenants=tenants).collect()} == {"d": "无可用知识库示例", "e": "无可用知识库示例"}
    assert {r["glossary"] for r in scoring.glossary_text(none, tenants=tenants).collect()} == {"无业务名词配置"}


def test_a_second_pass_finds_nothing_to_do(spark):
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    rows = [("d", None, "t1", "x"), ("d", "s", "t2", "y"), ("e", "pg_temp", "t3", "z"), ("e", "s", "t4", "w")]
    items = spark.createDataFrame(rows, "db_name string, schema_name string, table_name string, vector_text string")
    stored = spark.createDataFrame([], sync.STORED)
    prints = spark.createDataFrame([("gone", "f")], "db_name string, fingerprint string")
    vectors, after = sync.sync_pass(items, stored, prints, now)
    vectors, after = lineage.cut_lineage(vectors), lineage.cut_lineage(after)
    assert {r["table_name"] for r in vectors.collect()} == {"t1", "t2", "t4"}
    assert {r["db_name"] for r in after.collect()} == {"d", "e", "gone"}
    shown = items.where("table_name <> 't3'")
    assert {r["action"] for r in sync.check_tenants(shown, vectors, after).collect()} == {"none"}
    again, _ = sync.sync_pass(items, vectors, after, now)
    assert sorted(map(str, again.collect())) == sorted(map(str, vectors.collect()))


def test_a_version_is_named_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from tablescout.sources import snapshots

    root = str(tmp_path / "t")
    assert snapshots.write_snapshot(spark.range(3), root) == 1
    with pytest.raises(snapshots.Conflict, match="another writer"):
        snapshots._name(spark, root, 1, "v=00000001-late")
    # Many writers at once: each number has one winner, and what it wrote is what is read.
    with ThreadPoolExecutor(16) as pool:
        won = list(pool.map(lambda i: snapshots.create_exclusively(spark, f"{root}/commits/00000002.txt", f"2 w{i}\n"), range(16)))
    assert won.count(True) == 1
    assert snapshots._commits(spark, root).where("version = 2").first()["folder"] == f"w{won.index(True)}"


def test_of_two_writers_one_wins_and_none_is_lost(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from tablescout.sources import snapshots

    root = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "db string, x long")

    def write(name):
        tries = 0
        while True:
            try:
                return snapshots.write_parts(make([(name, 1), (name, 2)]), root, "db", make([(name, 0)])), tries
            except snapshots.Conflict:
                tries += 1

    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(write, "abcd"))
    assert sorted(n for n, _ in done) == [1, 2, 3, 4]
    got = sorted((r["db"], r["x"]) for r in snapshots.read_parts(spark, root, "db string, x long", "db").collect())
    assert got == [(n, x) for n in "abcd" for x in (1, 2)]
    # A folder and pointer rows without a commit are never read.
    real, snapshots._name = snapshots._name, lambda *a: (_ for _ in ()).throw(snapshots.Conflict("late"))
    try:
        with pytest.raises(snapshots.Conflict):
            snapshots.write_parts(make([("a", 9)]), root, "db", make([("a", 0)]))
    finally:
        snapshots._name = real
    assert snapshots.read_parts(spark, root, "db string, x long", "db").where("x = 9").count() == 0


def test_compaction_keeps_the_rows_in_fewer_files(spark, tmp_path):
    from tablescout.sources import snapshots

    root, schema = str(tmp_path / "t"), "db string, x long"
    make = lambda rows: spark.createDataFrame(rows, schema)
    assert snapshots.compact_parts(spark, root, schema, "db") == 0
    rows = [("ab"[i % 2], i) for i in range(200)]
    snapshots.write_parts(make(rows).repartition(12), root, "db", make([("a", 0), ("b", 0)]))
    snapshots.write_parts(make([("c", 1)]), root, "db", make([("c", 0)]))
    before = snapshots.read_parts(spark, root, schema, "db")
    files, held = len(before.inputFiles()), sorted(map(tuple, before.collect()))
    assert snapshots.compact_parts(spark, root, schema, "db") == 3
    after = snapshots.read_parts(spark, root, schema, "db")
    assert sorted(map(tuple, after.collect())) == held
    assert len(after.inputFiles()) == 3 < files
    # What was made from an older version cannot replace a newer one.
    with pytest.raises(snapshots.Conflict):
        snapshots.write_parts(make([("a", 5)]), root, "db", make([("a", 0)]), base=2)
