"""Language and quality: gradients, tables, held-out accuracy and awkward rows."""

import os
import tracemalloc
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tablescout.llm import language, quality, textbytes
from tests.llm import cases as C

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001").replace("sf0.001", "sf0.01")


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_windows_hold_every_byte():
    texts = ["", None, "a", "b" * 256, "c" * 257, "é" * 300]
    data, offsets = language.B.buffer_of(pa.array(texts))
    rows, text, held = language.windows(data, offsets)
    assert text.tolist() == [2, 3, 4, 4, 5, 5, 5] and held.tolist() == [1, 256, 256, 1, 256, 256, 88]
    for i, t in enumerate(texts):
        assert b"".join(r.tobytes()[:h] for r, h in zip(rows[text == i], held[text == i])) == (t or "").encode()


def direct(net, row):
    """The network, byte by byte."""
    peaks = []
    for f in net.filters:
        width = len(f)
        responses = [
            sum(net.vectors[row[at + j]] @ f[j] for j in range(width)) for at in range(language.WINDOW - width + 1)
        ]
        peaks.append(np.max(responses, axis=0))
    kept = np.maximum(np.concatenate(peaks) + net.bias, 0)
    out = np.exp(kept @ net.weight + net.offset)
    return out / out.sum()


@pytest.fixture(scope="module")
def small_net():
    rng = np.random.default_rng(1)
    rows = rng.integers(97, 123, (60, language.WINDOW)).astype(np.uint8)
    rows[::2, 40] = 33
    return language.train(rows, np.arange(60) % 2, ["x", "y"], epochs=2), rows


def test_tables_equal_the_network(small_net):
    net, rows = small_net
    assert np.allclose(language.Tables(net).probabilities(rows[:5]), [direct(net, r) for r in rows[:5]], atol=1e-4)


def test_gradient_is_the_slope(small_net):
    net, rows = small_net
    labels = np.arange(8) % 2
    parts = {"vectors": net.vectors, "bias": net.bias, "weight": net.weight, "offset": net.offset}
    parts |= {f"f{w}": f.reshape(-1, language.FILTERS) for w, f in zip(language.WIDTHS, net.filters)}
    parts = {k: v.astype(np.float64) for k, v in parts.items()}

    def loss(p):
        made = language.Network(
            net.languages, p["vectors"], [p[f"f{w}"].reshape(w, -1, language.FILTERS) for w in language.WIDTHS],
            p["bias"], p["weight"], p["offset"],
        )
        return -np.mean([np.log(direct(made, r)[y]) for r, y in zip(rows[:8], labels)])

    gradient = language._gradient(parts, rows[:8], labels)
    for name, g in gradient.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        up, down = ({k: v.copy() for k, v in parts.items()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        assert (loss(up) - loss(down)) / 2e-5 == pytest.approx(g[at], rel=0.05, abs=1e-5), name


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    net = language.fit(docs)
    got = language.identify(docs, net).collect()
    right = [r["lang_pred"] == r["lang"] for r in got if held_out(r["doc_id"]) and r["lang"]]
    assert np.mean(right) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    again = language.fit(docs.repartition(5))
    assert all(np.array_equal(a, b) for a, b in zip(net.filters, again.filters))


def test_repeated_ids_count_once(spark, monkeypatch):
    ids = [i for i in range(100) if not held_out(i)]
    # One language of many rows and few ids, one of many ids with copies.
    rows = [(ids[i % 4], f"wort {i}", "xx") for i in range(4000)]
    rows += [(i, f"mot {i}", "yy") for i in ids[4:34]] + [(i, f"mot {n}", "yy") for i in ids[4:34] for n in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    seen = {}
    monkeypatch.setattr(language, "train", lambda x, y, languages: seen.update(n=np.bincount(y).tolist(), names=languages))
    language.fit(docs, per_language=5)
    # Every text is one window.
    assert seen == {"names": ["xx", "yy"], "n": [4, 5]}


def test_awkward_texts_and_no_model(spark, small_net):
    net, _ = small_net
    docs = C.documents(spark, C.awkward()).drop("score")
    got = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in language.identify(docs, net).collect()}
    assert got[0, None] == got[1, ""] == got[2, " \n\t "] == ("und", 0.0)
    assert all(p in ("x", "y") for (_, t), (p, _) in got.items() if t and t.strip())
    assert language.identify(docs, None).where("lang_pred != 'und'").count() == 0
    assert language.identify(docs.where("false"), net).count() == 0
    assert language.fit(docs.where("false")) is None


def test_quality_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = quality.fit(docs, labels)
    assert len(model.labels) <= quality.LABELLED
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    right = [(got[i] >= 0.5) == bool(q) for i, q in marks.items() if held_out(i) and q is not None and i in got]
    assert np.mean(right) >= 0.97
    again = quality.fit(docs.repartition(6), labels)
    assert np.allclose(model.vectors, again.vectors, atol=1e-5)
    kept = {r["doc_id"] for r in quality.good_documents(docs, model).collect()}
    assert kept == {i for i, s in got.items() if s >= 0.5}


def test_held_out_labels_change_nothing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    own = [i for i in range(1000) if held_out(i)]
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(F.col("doc_id").isin(own), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = quality.fit(docs, labels, 200), quality.fit(docs, turned, 200)
    assert len(one.labels) == 200 and (one.labels == two.labels).all() and np.array_equal(one.vectors, two.vectors)


def test_votes_equal_a_plain_loop():
    rng = np.random.default_rng(3)
    terms = rng.random((80, 30)).astype(np.float32)
    labels = rng.integers(0, 2, 80)
    model = quality.learn(terms, labels, latent=6)
    asked = rng.random((10, 30)).astype(np.float32)
    got = quality.vote(model, np.vstack([asked, np.zeros((1, 30), np.float32)]), k=7)
    for x, s in zip(asked, got):
        mine = (x * model.weight) @ model.directions
        near = model.vectors @ (mine / np.linalg.norm(mine))
        top = np.argsort(-near)[:7]
        w = np.maximum(near[top], 1e-6) ** 8
        assert s == pytest.approx((w * labels[top]).sum() / w.sum(), abs=1e-4)
    assert got[-1] == pytest.approx(labels.mean())


def test_quality_of_awkward_rows(spark):
    docs = C.documents(spark, C.awkward()).drop("score")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, none)
    assert {r["score"] for r in quality.score(docs, model).collect()} == {0.5}
    some = spark.createDataFrame([(i, i % 2) for i in range(10, 50)] + [(10, 0), (999, 1), (11, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, some)
    out = quality.score(docs, model)
    assert out.columns == [*docs.columns, "score"] and out.count() == docs.count()
    assert quality.score(docs.where("false"), model).count() == 0


def test_many_short_texts_take_little_memory():
    rng = np.random.default_rng(4)
    texts = pa.array([None, ""] + [f"Line {i} of {rng.integers(99)} words." for i in range(6000)])
    model = quality.learn(quality.features(texts[:900]), rng.integers(0, 2, 900))
    model = model._replace(
        vectors=np.tile(model.vectors, (5, 1))[:4000], labels=np.tile(model.labels, 5)[:4000]
    )
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], names=["doc_id", "text"])
    run = quality._scored(SimpleNamespace(value=tuple(model)), 1, ["doc_id", "text", "score"], quality.NEIGHBOURS)
    tracemalloc.start()
    try:
        got = pa.Table.from_batches(run(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 64e6, most  # 6,002 rows at once take 441 MB
    assert got.select(["doc_id", "text"]).equals(pa.table(batch.to_pydict()))
    want = np.concatenate([quality.vote(model, quality.features(texts[i : i + 1])) for i in (0, 1, 2, 500, 6001)])
    assert np.allclose(got["score"].to_numpy()[[0, 1, 2, 500, 6001]], want, atol=1e-4)


@pytest.mark.parametrize("size, rows", [(1, None), (10**6, 3), (40, 3), (40, 10**6)])
def test_chunks_hold_each_text_once(size, rows):
    texts = pa.array(["", None, "a" * 100, "bc", "", "", "", "d" * 39, "ef"])
    parts = list(textbytes.chunks(texts, size, rows))
    assert [t for _, p in parts for t in p.to_pylist()] == texts.to_pylist()
    assert [at for at, _ in parts] == [sum(len(p) for _, p in parts[:i]) for i in range(len(parts))]
    assert all(0 < len(p) <= (rows or len(texts)) for _, p in parts)
    assert list(textbytes.chunks(texts[:0], size, rows)) == []
