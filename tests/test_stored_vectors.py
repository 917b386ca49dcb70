"""The stored vectors are put together from hashes, so no join moves a text."""

import pytest

from pyspark.sql import functions as F

from tablescout.operators import encode, sized
from tablescout.plans import sync
from workload import inputs
from workload import sync_queries

TEXTS = {"text", "html", "vector_text"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    tables = {
        "documents": ("doc_id long, text string, lang string, source string, n_chars long", [
            (1, "one", "en", "src0", 3), (2, "two", "de", "src1", 3), (2, "again", "en", "src2", 5), (3, None, "en", None, 0),
            (4, "four", "es", "src1", 4), (5, "five", None, "src1", 4), (None, "none", "en", "src3", 4), (6, "six", "fr", "src2", 3),
        ]),
        "labels": ("doc_id long, quality int, toxic int", [(1, 0, 0), (2, 0, 0), (2, 1, 0), (3, 0, 1), (6, None, 0), (None, 0, 0)]),
        "pages": ("page_id long, url string, html string", [(1, "u", "<p>"), (7, "v", None), (None, "w", "<b>")]),
        "embeddings": ("vec_id long, embedding array<float>, label int", [
            (1, [1.0, 0.0], 0), (2, [0.0, 1.0], 1), (2, [0.5, 0.5], 1), (3, None, 0), (None, [1.0, 1.0], 0),
        ]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture
def shuffled(spark):
    """Joins by shuffling, as with large tables, and whole plans to look at."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "-1")
    spark.conf.set(names[1], "false")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def text_exchanges(df):
    """Exchanges of the plan that carry a text."""
    found = []

    def visit(node):
        if node.nodeName() == "Exchange":
            columns = {node.output().apply(i).name() for i in range(node.output().size())}
            found.extend([columns & TEXTS] if columns & TEXTS else [])
        for i in range(node.children().size()):
            visit(node.children().apply(i))

    visit(df._jdf.queryExecution().executedPlan())
    return found


def test_rows_are_those_of_the_select(spark, folder):
    built, plain = inputs.frame(spark, folder, "stored_vectors"), inputs.selected(spark, folder, "stored_vectors")
    assert built.dtypes == plain.dtypes
    assert plain.count() > 10
    assert built.exceptAll(plain).count() == 0 and plain.exceptAll(built).count() == 0


def test_no_join_of_the_stored_vectors_moves_a_text(spark, folder, shuffled):
    assert text_exchanges(inputs.frame(spark, folder, "stored_vectors")) == []


@pytest.mark.parametrize("query", ["incremental_sync", "check_and_sync"])
def test_sync_moves_the_texts_of_the_items_at_most_once(spark, folder, shuffled, query):
    assert len(text_exchanges(sync_queries.Q[query][0](spark, folder))) <= 1


@pytest.mark.parametrize("query", ["incremental_sync", "check_and_sync"])
def test_sync_moves_no_text_however_many_items_moved(spark, folder, shuffled, query, monkeypatch):
    few = sync_queries.Q[query][0](spark, folder)
    rows = few.collect()
    monkeypatch.setattr(sync, "BROADCAST_BYTES", -1)
    many = sync_queries.Q[query][0](spark, folder)
    assert text_exchanges(many) == []
    assert len(rows) > 5 and sorted(map(str, many.collect())) == sorted(map(str, rows))


def flat(dim):
    return lambda texts: encode.hashed_ngrams(dim)(texts)


@pytest.mark.parametrize("makers", [
    {"local": lambda: flat(4), "api": lambda: flat(8)}, {"local": encode.hashed_ngrams, "api": encode.hashed_ngrams},
    {"local": lambda: flat(4), "other": lambda: flat(8)},
])
def test_texts_encoded_in_place_give_the_same_vectors(spark, folder, monkeypatch, makers):
    items, stored = inputs.frame(spark, folder, "items").drop("ref"), inputs.frame(spark, folder, "stored_vectors")
    now = F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")
    few = sync.incremental_sync(items, stored, now, makers)
    rows, kinds = few.collect(), few.dtypes
    monkeypatch.setattr(sync, "BROADCAST_BYTES", -1)
    many = sync.incremental_sync(items, stored, now, makers)
    assert many.dtypes == kinds
    assert len(rows) > 5 and sorted(map(str, many.collect())) == sorted(map(str, rows))


def test_rows_likely_among_keys(spark):
    key = lambda n: spark.range(n).select("id", F.concat(F.lit("k"), "id").alias("a"), F.nullif(F.col("id") % 7, F.lit(3)).alias("b"))
    rows, keys = key(50_000), key(50_000).where("id % 10 = 1").drop("id")
    got = sized.likely_among(rows, keys, ["a", "b"])
    assert got.columns == rows.columns
    assert got.where("id % 10 = 1").count() == 5_000
    assert got.where("id % 10 <> 1").count() < 45_000 / 32
    assert sized.likely_among(rows, keys.limit(0), ["a", "b"]).count() == 0


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_a_join_on_the_tenant_has_a_key(spark, folder, how):
    tenants = spark.createDataFrame([("en",), ("fr",)], "db_name string")
    for hinted in (tenants, tenants.hint("broadcast")):
        plan = inputs.frame(spark, folder, "stored_vectors").join(hinted, "db_name", how)
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text
