"""Registered queries of the corpus operators, with DuckDB counterparts where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.llm import (
    binary_packing,
    embedding_dedup,
    hard_negatives,
    language,
    minhash,
    mixing,
    neighbours,
    packing,
    pii,
    quality,
    secrets,
    spelling,
    wavelet,
)
from tablescout.llm import spans as S
from tablescout.llm.common import held_out
from tablescout.sources.tables import read_table


def tokenizer_file(name: str) -> str:
    """Place of an installed public tokenizer file, the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _matches_sql(kinds: list[tuple[str, str, str]], source: str) -> str:
    """Rows ``id, kind, rank, start, stop, hit`` of each kind's matches that pass its test.

    ``kinds`` are name, pattern and a test of ``hit``. Gaps and matches, added up, give the places.
    """
    parts = [
        f"""SELECT id, '{kind}' AS kind, {rank} AS rank, string_split_regex(t, $p${pattern}$p$) AS gaps, regexp_extract_all(t, $p${pattern}$p$) AS hits
            FROM {source} WHERE regexp_matches(t, $p${pattern}$p$)""" for rank, (kind, pattern, _) in enumerate(kinds)
    ]
    tests = " ".join(f"WHEN kind = '{kind}' THEN {test}" for kind, _, test in kinds)
    return f"""(SELECT id, kind, rank, start, start + length(hit) AS stop, hit FROM (
        SELECT id, kind, rank, hits[i] AS hit, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
          + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
        FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM ({" UNION ALL ".join(parts)}))) WHERE CASE {tests} END)"""


_WRITTEN = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
_SECRETS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
     r"""length(regexp_extract(hit, $p$^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$p$, 1)) >= 6"""),
    ("access", "AKIA[A-Z0-9]+", "length(hit) >= 20"),
    ("hex", "[0-9a-f]{24,}", "true"),
    ("private_key", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", "true"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true"),
    ("forge_token", "gh[pousr]_[A-Za-z0-9]{36,}", "true"),
]
_OP3_SQL = f"""WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents)
  , m AS (SELECT * FROM {_matches_sql(_SECRETS, "d")})
  , g AS (SELECT id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      {_WRITTEN} FILTER (kind IN ('assign', 'access', 'hex')) AS base, {_WRITTEN} AS spans FROM m GROUP BY id)
  SELECT d.id AS doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON g.id = d.id"""


_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INTEGER)
    ELSE CAST(c AS INTEGER) * 2 - CASE WHEN CAST(c AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
_PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
     "len(list_filter(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INTEGER), 0) > 255)) = 0"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
]
_TERM = r"$p$\p{L}{3,}$p$"


def op4_sql(min_support: int = pii.MIN_SUPPORT) -> str:
    """The rule of ``pii.find_pii``: a text holds a pair wherever its identifier and its term stand in it."""
    return rf"""WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents)
  , m AS (SELECT * FROM {_matches_sql(_PERSONAL, "d")})
  , texts AS (SELECT t, min(id) AS id, count(*) AS n FROM d WHERE id IN (SELECT id FROM m) GROUP BY t)
  , held AS (SELECT DISTINCT t, n, kind || ':' || lower(hit) AS entity FROM m JOIN texts USING (id))
  , entities AS (SELECT entity, sum(n) AS n_e FROM held GROUP BY 1 HAVING count(*) >= {min_support} AND sum(n) < (SELECT count(*) FROM d))
  , own AS (SELECT t, unnest(list_distinct(regexp_extract_all(lower(t), {_TERM}))) AS term FROM texts
      WHERE t IN (SELECT t FROM held JOIN entities USING (entity)))
  , words AS (SELECT t, n, entity, term FROM held JOIN entities USING (entity) JOIN own USING (t))
  , pairs AS (SELECT entity, term, sum(n) AS n_et FROM words GROUP BY ALL HAVING count(*) >= {min_support})
  , seen AS (SELECT term, count(*) AS n_t FROM (SELECT id, unnest(list_distinct(regexp_extract_all(lower(t), {_TERM}))) AS term FROM d) GROUP BY 1)
  , reveals AS (SELECT entity, term, ln(n_et * (SELECT count(*) FROM d)::DOUBLE / (n_e * n_t)) / ln((SELECT count(*) FROM d)::DOUBLE / n_e) AS x
      FROM pairs JOIN entities USING (entity) JOIN seen USING (term))
  , shown AS (SELECT t, term, max(x) AS x FROM words JOIN reveals USING (entity, term) WHERE x >= {pii.THRESHOLD} GROUP BY ALL)
  , runs AS (SELECT id, t, hits[i] AS hit, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: length(g))), 0) AS BIGINT) AS start
      FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT id, t, string_split_regex(t, '\p{{L}}+') AS gaps, regexp_extract_all(t, '\p{{L}}+') AS hits
        FROM d WHERE t IN (SELECT t FROM shown))))
  , more AS (SELECT id, CASE WHEN x >= {pii.REMOVE_AT} THEN 'cut' ELSE 'term' END AS kind, CASE WHEN x >= {pii.REMOVE_AT} THEN 5 ELSE 4 END AS rank,
      start, start + length(hit) AS stop FROM runs JOIN shown ON shown.t = runs.t AND shown.term = lower(hit))
  , spans AS (SELECT id, kind, rank, start, stop FROM m UNION ALL SELECT id, kind, rank, start, stop FROM more
      WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.id = more.id AND more.start < m.stop AND m.start < more.stop))
  , g AS (SELECT id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.KINDS)}, {_WRITTEN} FILTER (rank < 4) AS base, {_WRITTEN} AS spans FROM spans GROUP BY id)
  SELECT d.id AS doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.KINDS)}, sha256(coalesce(base, '')) AS base_sha256,
    coalesce(spans, '') AS spans FROM d LEFT JOIN g ON g.id = d.id"""


_OP12_SQL = """WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
  , scored AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM r a JOIN r b ON a.id % 50 = 0 AND a.id <> b.id)
  , positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
  SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
  WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3"""

# The checksum byte by byte, with its table made by the usual rule; near words by equal remains: one word's
# letters without the i-th are another word, or two words without their i-th are alike.
_OP13_SQL = r"""WITH RECURSIVE steps(i, k, c) AS (SELECT range, 0, range FROM range(256)
      UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8)
  , crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8)
  , runs AS (SELECT doc_id, row, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM
      (SELECT doc_id, row, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM (SELECT *, row_number() OVER () AS row FROM documents)))
  , own AS (SELECT row, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key, run, count(*) AS n FROM runs GROUP BY ALL)
  , bytes AS (SELECT run, n, flatten(list_transform(string_split(key, ''), lambda x:
      CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 | (unicode(x) >> 6), 128 | (unicode(x) & 63)] END)) AS b FROM own)
  , hashed AS (SELECT run, n, xor(list_reduce(list_transform(b, lambda x: CAST(x AS BIGINT)),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM bytes, crc)
  , words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 31 <> 0 THEN run
        ELSE left(run, h % length(run)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) END AS word FROM hashed)
      WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2)
  , less AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS remains
      FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words))
  , longer AS (SELECT DISTINCT less.word AS a, less.n AS a_n, words.word AS b, words.n AS b_n FROM less JOIN words ON words.word = less.remains)
  , near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.remains = b.remains AND a.word <> b.word
      UNION ALL SELECT a, b, b_n FROM longer UNION ALL SELECT b, a, a_n FROM longer)
  , best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word)
  , forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form,
      CASE WHEN other_n >= 10 * n THEN other_n END AS form_n FROM words LEFT JOIN best USING (word))
  , up(word, root, next) AS (SELECT word, word, form FROM forms UNION ALL SELECT up.word, up.next, f.form FROM up JOIN forms f ON f.word = up.next)
  SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM forms f JOIN up ON up.word = f.word AND up.next IS NULL"""


def op1_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "embeddings")
    return neighbours.MultiIndex(rows).search(rows.where(F.col("vec_id") % 50 == 0))


def op6_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(read_table(spark, folder, "embeddings"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), end_id=2, with_ids=False)


def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    ledger, paths = secrets.advance(read_table(spark, folder, "documents"))
    rows = secrets.findings(ledger, paths)
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return rows.select(
        F.col("id").alias("doc_id"),
        *[S.count(F.col("spans"), r.kind).alias(f"n_{r.kind}") for r in secrets.BASE_RULES],
        S.digest(base).alias("base_sha256"), S.written(F.col("spans")).alias("spans"),
    )


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    rows = pii.find_pii(read_table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", *[S.count(F.col("base_spans"), k).alias(f"n_{k}") for k in pii.KINDS],
        S.digest(F.col("base_spans")).alias("base_sha256"), S.written(F.col("spans")).alias("spans"),
    )


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    rows = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    rows = quality.score(docs, quality.fit(docs, read_table(spark, folder, "labels")))
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op8_wavelet(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    path = wavelet.write_shards(docs, tokenizer_file("word_bpe_49k.json"), end_id=1)
    return wavelet.read_shards(spark.read.parquet(path), with_ids=False)


def op9_dart_minhash(spark: SparkSession, folder: str) -> DataFrame:
    rows = minhash.near_duplicates(read_table(spark, folder, "documents"))
    return rows.select("doc_id", "component_id", "kept")


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read_table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies"
    )


def op11_binary_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return binary_packing.pack_binary(docs, tokenizer_file("byte_bpe_50k.json"), end_id=1, with_ids=False)


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read_table(spark, folder, "embeddings").withColumn("label", moved)
    return hard_negatives.mine_negatives(rows, F.col("vec_id") % 50 == 0)


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(read_table(spark, folder, "documents"), slips=31)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


Q = {
    "op1_multi_index": (op1_multi_index, None),
    "op2_packing": (op2_packing, None),
    "op3_secrets": (op3_secrets, _OP3_SQL),
    "op4_pii": (op4_pii, op4_sql()),
    "op5_language": (op5_language, None),
    "op6_vector_dedup": (op6_vector_dedup, None),
    "op7_quality": (op7_quality, None),
    "op8_wavelet": (op8_wavelet, None),
    "op9_dart_minhash": (op9_dart_minhash, None),
    "op10_mixing": (op10_mixing, None),
    "op11_binary_packing": (op11_binary_packing, None),
    "op12_hard_negatives": (op12_hard_negatives, _OP12_SQL),
    "op13_spelling": (op13_spelling, _OP13_SQL),
    "pipeline": (pipeline, None),
}
