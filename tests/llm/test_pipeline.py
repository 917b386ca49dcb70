"""The pipeline's stages against plain loops, each on its own input."""

import os
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tablescout.llm import mixing, quality
from tests.llm import cases as C

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """What goes into each stage and comes out of the last."""
    folder = tmp_path_factory.mktemp("stages")
    docs = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs[-1], FOLDER).write.parquet(f"{folder}/{i}")
        docs.append(spark.read.parquet(f"{folder}/{i}"))
    return docs


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_all_but_the_last_keep_the_columns(tables):
    assert [n for n, _ in corpus_pipeline.STAGES][1] == "MinHash near-dedup"
    assert all(t.columns == COLUMNS for t in tables[:-1])


def test_quality_keeps_what_is_not_voted_down(spark, tables):
    model = quality.fit(tables[0], spark.read.parquet(f"{FOLDER}/labels.parquet"))
    want = [r["doc_id"] for r in quality.score(tables[0], model).where("score >= 0.5").collect()]
    assert sorted(r["doc_id"] for r in rows(tables[1])) == sorted(want)


def test_one_document_of_each_group_stays(tables):
    before = sorted(rows(tables[1]), key=lambda r: r["doc_id"])
    group = C.near_groups([r["text"] for r in before], 0.8)
    want = [r["doc_id"] for i, r in enumerate(before) if group[i] == i]
    assert sorted(r["doc_id"] for r in rows(tables[2])) == want


def test_no_identifier_is_left(tables):
    before = {r["doc_id"]: r["text"] for r in rows(tables[2])}
    after = rows(tables[3])
    assert len(after) == len(before)
    touched = 0
    for r in after:
        assert C.base_spans(r["text"], C.PERSONAL) == [] and r["n_chars"] == len(r["text"])
        spans = C.base_spans(before[r["doc_id"]], C.PERSONAL)
        touched += bool(spans)
        assert spans or r["text"] == before[r["doc_id"]]
    assert touched


def test_sources_come_near_their_targets(tables):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    size = lambda r: len(word.findall(r["text"] or ""))
    before, after = rows(tables[3]), rows(tables[4])
    sizes, taken = Counter(), Counter()
    largest = Counter()
    for r in before:
        sizes[r["source"]] += size(r)
        largest[r["source"]] = max(largest[r["source"]], size(r))
    for r in after:
        taken[r["source"]] += size(r)
    goal = mixing.targets(list(sizes.items()))
    assert all(abs(taken[s] - goal[s]) <= 0.55 * largest[s] + 5 for s in goal)
    ids = Counter(r["doc_id"] for r in after)
    assert max(ids.values()) <= 3 and set(ids) <= {r["doc_id"] for r in before}


def test_pieces_fill_sequences(tables):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in rows(tables[4]):
        ids = plain.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) - (len(ids) - 1) // 1024 * 1024, len(ids) + 1, 1024)]
        want.update((r["doc_id"], p, a, C.crc(ids[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:])))
    got = rows(tables[5])
    assert Counter((r["doc_id"], r["piece"], r["start"], r["ids_crc32"]) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024


def test_run_gives_the_same_rows(spark, tables):
    key = lambda df: sorted((r["doc_id"], r["piece"], r["sequence_id"], r["offset"]) for r in rows(df))
    assert key(corpus_pipeline.run(spark, FOLDER)) == key(tables[5])
    assert corpus_pipeline.ORACLE_SQL is None
