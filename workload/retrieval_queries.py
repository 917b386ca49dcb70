"""Vector search, encoding, chunking and packing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tablescout.functions import text
from tablescout.functions import vectors as V
from tablescout.operators import encode, graph_index, nearest, packing
from tablescout.plans import search
from workload.inputs import table

Q: dict = {}


def add(name, fn, sql=None):
    Q[name] = (fn, sql)


def _label_queries(s, d):
    """One query vector per label: the mean of its rows."""
    c = nearest.group_centroids(table(s, d, "embeddings"), "label")
    return c.select(F.col("label").cast("long").alias("query_id"), F.col("centroid").alias("query_vector"))


def _center(s, d):
    return nearest.centroid(table(s, d, "embeddings")).scalar()


_PARTS = """parts AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings)"""
_CENTER = _PARTS + """, center AS (SELECT list(x ORDER BY p) AS q FROM (SELECT p, avg(x) AS x FROM parts GROUP BY p))"""
_LABELS = _PARTS + """, queries AS (SELECT label::BIGINT AS query_id, list(x ORDER BY p) AS q FROM (SELECT label, p, avg(x) AS x FROM parts GROUP BY label, p) GROUP BY label)
 , dists AS (SELECT query_id, vec_id, label, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS score
     FROM queries CROSS JOIN embeddings)
 , ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM dists)"""
_SCORED = """, scored AS (SELECT vec_id, label, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS score,
   round(list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda z: z[1] * z[2])), 9) AS dot FROM embeddings, center)"""


def _round(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


add(
    "topk_exact",
    lambda s, d: _round(nearest.topk_exact(table(s, d, "embeddings"), _center(s, d), 10, condition=F.col("label") != 3), "score"),
    f"WITH {_CENTER}{_SCORED} SELECT vec_id, label, round(score, 6) AS score, row_number() OVER (ORDER BY scored.score, vec_id) AS rank FROM scored WHERE label <> 3 ORDER BY scored.score, vec_id LIMIT 10",
)
add(
    "topk_inner_product",
    lambda s, d: _round(nearest.topk_inner_product(table(s, d, "embeddings"), _center(s, d), 5, 0.001), "score"),
    f"WITH {_CENTER}{_SCORED} SELECT vec_id, label, round(dot, 6) AS score FROM scored WHERE dot >= 0.001 ORDER BY dot DESC, vec_id LIMIT 5",
)
add(
    "knn_batch",
    lambda s, d: _round(nearest.knn_batch(table(s, d, "embeddings"), _label_queries(s, d), 10), "score"),
    f"WITH {_LABELS} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10",
)
add(
    "knn_all",
    lambda s, d: nearest.knn_batch(
        table(s, d, "embeddings"),
        table(s, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), 5,
    ).select("query_id", "vec_id", "rank"),
    """WITH dists AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),
         lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS score FROM embeddings a CROSS JOIN embeddings b)
       SELECT query_id, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM dists) WHERE rank <= 5""",
)


def _approx(s, d):
    corpus = table(s, d, "embeddings")
    centers = nearest.fit_cells(corpus, 8)
    return nearest.knn_approx(nearest.assign_cells(corpus, centers), _label_queries(s, d), centers, 10, 4)


add("knn_approx", _approx)


def _graph(s, d):
    graph = graph_index.build_graph(table(s, d, "embeddings"))
    return graph_index.search_graph(graph, _label_queries(s, d), 10, compared=True)


add("knn_graph", _graph)


def _own_k(s, d):
    """Label queries with the label as tenant, a k of their own and a list of visible labels."""
    q = _label_queries(s, d)
    return q.select(
        "query_id", "query_vector", F.col("query_id").cast("int").alias("label"), (3 + F.col("query_id") % 4).alias("k"),
        F.when(F.col("query_id") != 0, F.array(F.col("query_id").cast("string"), (F.col("query_id") + 1).cast("string"))).alias("listed"),
    )


add(
    "knn_tenant",
    lambda s, d: _round(nearest.knn_batch(table(s, d, "embeddings"), _own_k(s, d), by=["label"], k_col="k"), "score"),
    f"""WITH {_LABELS}, own AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS n FROM dists WHERE label = query_id)
        SELECT query_id, vec_id, round(score, 6) AS score, n AS rank FROM own WHERE n <= 3 + query_id % 4""",
)
add(
    "knn_filtered",
    lambda s, d: _round(
        nearest.knn_batch(
            table(s, d, "embeddings").withColumn("schema_name", F.col("label").cast("string")), _own_k(s, d), 7,
            F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 9, "0")), listed="listed",
        ), "score",
    ),
    f"""WITH {_LABELS}, own AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS n FROM dists WHERE query_id = 0 OR label IN (query_id, query_id + 1))
        SELECT query_id, 'v' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS vec_id, round(score, 6) AS score, n AS rank FROM own WHERE n <= 7""",
)


def _cells(s, d):
    corpus = table(s, d, "embeddings")
    # Label means as centres: a row per label.
    means = nearest.group_centroids(corpus, "label").orderBy("label").collect()
    centers = np.array([r["centroid"] for r in means])
    return nearest.knn_approx(nearest.assign_cells(corpus, centers), _label_queries(s, d), centers, 10, 4)


add(
    "knn_cells",
    lambda s, d: _round(_cells(s, d), "score"),
    f"""WITH {_LABELS}, dc AS (SELECT e.vec_id, c.query_id AS cell, list_sum(list_transform(list_zip(e.embedding::DOUBLE[], c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS x
          FROM embeddings e CROSS JOIN queries c), home AS (SELECT vec_id, arg_min(cell, x) AS cell FROM dc GROUP BY vec_id)
      , qc AS (SELECT a.query_id, b.query_id AS cell, row_number() OVER (PARTITION BY a.query_id ORDER BY list_sum(list_transform(list_zip(a.q, b.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS n
          FROM queries a CROSS JOIN queries b)
      , cand AS (SELECT r.query_id, r.vec_id, r.score, row_number() OVER (PARTITION BY r.query_id ORDER BY r.score, r.vec_id) AS rank, count(*) OVER (PARTITION BY r.query_id) AS have
          FROM dists r JOIN home USING (vec_id) JOIN qc ON qc.query_id = r.query_id AND qc.cell = home.cell AND qc.n <= 4)
      SELECT query_id, vec_id, round(score, 6) AS score, rank FROM cand WHERE rank <= 10 AND have >= 10
      UNION ALL SELECT query_id, vec_id, round(score, 6), rank FROM ranked WHERE rank <= 10 AND query_id NOT IN (SELECT query_id FROM cand WHERE have >= 10)""",
)


def _targets(s, d):
    last = table(s, d, "embeddings").groupBy(F.col("label").cast("long").alias("query_id")).agg(F.max("vec_id").alias("target_id"))
    return _label_queries(s, d).join(last, "query_id")


add(
    "rank_explain",
    lambda s, d: _round(nearest.rank_explain(table(s, d, "embeddings"), _targets(s, d)), "target_score", "gap"),
    f"""WITH {_LABELS}, t AS (SELECT label::BIGINT AS query_id, max(vec_id) AS target_id FROM embeddings GROUP BY label)
      , near AS (SELECT query_id, min(score) AS best, count(*) AS population FROM dists GROUP BY query_id)
      SELECT r.query_id, t.target_id, round(r.score, 6) AS target_score, r.rank AS target_rank, round(r.score - near.best, 6) AS gap, near.population
      FROM ranked r JOIN t ON t.query_id = r.query_id AND t.target_id = r.vec_id JOIN near ON near.query_id = r.query_id""",
)
add(
    "rank_explain_top",
    lambda s, d: nearest.rank_explain(table(s, d, "embeddings").where("label <> 3"), _targets(s, d).where("query_id <> 3"), first=15).select(
        "query_id", "target_id", "target_rank", F.concat_ws(",", F.transform("first_hits", lambda x: x.cast("string"))).alias("first_hits")
    ),
    f"""WITH {_LABELS}, seen AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS n FROM dists WHERE label <> 3 AND query_id <> 3)
      , t AS (SELECT label::BIGINT AS query_id, max(vec_id) AS target_id FROM embeddings GROUP BY label)
      , top AS (SELECT query_id, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY n) AS first_hits FROM seen WHERE n <= 15 GROUP BY 1)
      SELECT query_id, target_id, seen.n AS target_rank, first_hits FROM t JOIN seen USING (query_id) JOIN top USING (query_id) WHERE seen.vec_id = t.target_id""",
)
add(
    "hits_with_cards",
    lambda s, d: nearest.hits_with_cards(
        nearest.knn_batch(table(s, d, "embeddings"), _label_queries(s, d), 10).select("query_id", "rank", F.col("vec_id").alias("doc_id")),
        table(s, d, "documents").select("doc_id", "lang", text.display_name(F.col("source"), F.concat(F.lit("doc_"), "doc_id")).alias("name"), F.md5("text").alias("card")),
        ["doc_id"],
    ),
    f"""WITH {_LABELS} SELECT query_id, rank, doc_id, lang, source || '.doc_' || doc_id AS name, md5(text) AS card
        FROM ranked JOIN documents ON doc_id = vec_id WHERE rank <= 10""",
)


def _normalized(s, d):
    raw = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * F.col("label")).alias("v"))
    unit = raw.withColumn("u", V.normalize(F.col("v")))
    return unit.select(
        "vec_id", F.round(V.l2_norm(F.col("v")), 6).alias("norm"), F.round(V.l2_norm(F.col("u")), 6).alias("unit_norm"),
        F.round(F.element_at("u", 1), 6).alias("first"),
    )


add(
    "normalize_vectors",
    _normalized,
    """WITH r AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * label) AS v FROM embeddings)
       , n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM r)
       SELECT vec_id, round(n, 6) AS norm, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS unit_norm, round(CASE WHEN n > 0 THEN v[1] / n ELSE v[1] END, 6) AS first FROM n""",
)


def _encoded(s, d):
    out = encode.encode(table(s, d, "documents").select("doc_id", "text"), "text", encode.hashed_ngrams)
    parts = out.select("doc_id", F.posexplode("embedding").alias("part", "value"))
    return parts.where("value <> 0").select("doc_id", "part", F.round(F.col("value").cast("double"), 5).alias("value"))


add(
    "encode_hashed",
    _encoded,
    """WITH c AS (SELECT doc_id, list_transform(string_split(text, ''), lambda ch: unicode(ch)::BIGINT) AS u FROM documents)
       , g AS (SELECT doc_id, unnest(list_transform(range(1, len(u) - 1), lambda i: ((u[i] * 961 + u[i + 1] * 31 + u[i + 2]) % 1000003) % 64)) AS part FROM c WHERE len(u) >= 3)
       , n AS (SELECT doc_id, part, count(*)::DOUBLE AS n FROM g GROUP BY ALL)
       SELECT doc_id, part, round(CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE), 5) AS value FROM n""",
)


def _asked(s, d):
    """Questions of users, each put to the documents of one language and, in part, to two sources."""
    tenants = F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")])
    return table(s, d, "conversations").where("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("question"),
        F.element_at(tenants, (F.col("conv_id") % 4 + 1).cast("int")).alias("lang"),
        F.when(F.col("turn") == 0, F.array(F.lit("src1"), F.lit("src2"))).alias("listed"),
        (F.col("conv_id") % 3 + 1).cast("int").alias("k"),
    )


def _tenant_hits(s, d):
    docs = table(s, d, "documents").select("doc_id", "lang", "source", "text")
    items = encode.encode(docs, "text").select(F.col("doc_id").alias("vec_id"), "lang", "source", "embedding")
    hits = search.search_questions(_asked(s, d), items, by=["lang"], listed="listed", mark="source", k_col="k")
    return hits.select("query_id", "vec_id", "rank", F.round("score", 5).alias("score"))


def _coded_sql(source, key):
    """Vectors of 64 numbers in the single precision that they are stored in."""
    return f"""SELECT {key}, list(coalesce(x, 0) ORDER BY p) AS v FROM (
        SELECT ids.{key}, p, CAST(CAST(c / nullif(sqrt(sum(c * c) OVER (PARTITION BY ids.{key})), 0) AS FLOAT) AS DOUBLE) AS x FROM
          (SELECT {key}, unnest(range(64)) AS p FROM {source}) ids LEFT JOIN
          (SELECT {key}, part, count(*)::DOUBLE AS c FROM (SELECT {key}, unnest(list_transform(range(1, len(u) - 1), lambda i: ((u[i] * 961 + u[i + 1] * 31 + u[i + 2]) % 1000003) % 64)) AS part
             FROM (SELECT {key}, list_transform(string_split(text, ''), lambda ch: unicode(ch)::BIGINT) AS u FROM {source}) WHERE len(u) >= 3) GROUP BY ALL) g
          ON g.{key} = ids.{key} AND g.part = ids.p) GROUP BY {key}"""


add(
    "search_tenants",
    _tenant_hits,
    f"""WITH docs AS (SELECT doc_id, lang, source, text FROM documents)
      , asked AS (SELECT conv_id * 1000 + turn AS query_id, text, ['de', 'en', 'es', 'fr'][CAST(conv_id % 4 + 1 AS INTEGER)] AS lang,
          CASE WHEN turn = 0 THEN ['src1', 'src2'] END AS listed, conv_id % 3 + 1 AS k FROM conversations WHERE role = 'user')
      , dv AS ({_coded_sql("docs", "doc_id")}), qv AS ({_coded_sql("asked", "query_id")})
      , dists AS (SELECT query_id, doc_id AS vec_id, k, round(list_sum(list_transform(list_zip(qv.v, dv.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS score
          FROM asked JOIN qv USING (query_id) JOIN docs USING (lang) JOIN dv USING (doc_id) WHERE listed IS NULL OR list_contains(listed, source))
      SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM dists) WHERE rank <= k""",
)
add(
    "chunk_text",
    lambda s, d: packing.chunk_text(table(s, d, "documents"), ["doc_id"], "text").withColumn("chunk", F.md5("chunk")),
    """SELECT doc_id, i AS chunk_no, md5(substr(text, i * 462 + 1, 512)) AS chunk FROM (SELECT doc_id, text, unnest(range((length(text) - 1) // 462 + 1)) AS i FROM documents WHERE length(text) > 0)""",
)
add(
    "split_by_length",
    lambda s, d: packing.split_by_length(table(s, d, "documents"), ["doc_id"], "text", 2000).withColumn("part", F.md5("part")),
    """SELECT doc_id, i AS batch_no, md5(substr(text, i * 2000 + 1, 2000)) AS part FROM (SELECT doc_id, text, unnest(range((length(text) - 1) // 2000 + 1)) AS i FROM documents WHERE length(text) > 0)""",
)
add(
    "truncate_text",
    lambda s, d: table(s, d, "documents").select(
        "doc_id", F.md5(text.display_text(F.col("text"))).alias("shown"), F.md5(text.context_text(F.col("text"))).alias("context"),
        F.left("text", F.lit(100)).alias("head"), F.md5(F.left("text", F.lit(1000))).alias("error"),
    ),
    """SELECT doc_id, md5(CASE WHEN length(text) > 800 THEN substr(text, 1, 800) || chr(10) || '  ...(后面还有 ' || (length(text) - 800) || ' 字符)' ELSE text END) AS shown,
       md5(CASE WHEN length(text) > 20000 THEN substr(text, 1, 20000) || chr(10) || '...(表结构已截断)' ELSE text END) AS context,
       substr(text, 1, 100) AS head, md5(substr(text, 1, 1000)) AS error FROM documents""",
)


def _cards(s, d):
    return table(s, d, "documents").select(
        "source", "doc_id",
        F.concat(F.when(F.col("lang") == "de", F.lit("表 ")).otherwise(F.lit("表名: ")), "source", F.lit(".doc_"), "doc_id", F.lit("\n列:\n"), "text").alias("card"),
    )


_PACK = """WITH RECURSIVE b AS (SELECT source, doc_id, length('表名: ' || source || '.doc_' || doc_id || chr(10) || '列:' || chr(10) || text) AS chars,
      row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE lang <> 'de')
  , f(source, n, doc_id, chars, batch_no, c, l) AS (
      SELECT source, n, doc_id, chars, 0, 1, chars FROM b WHERE n = 1
      UNION ALL
      SELECT b.source, b.n, b.doc_id, b.chars,
        CASE WHEN f.c = 0 OR f.l + b.chars + 2 <= 20000 OR f.c < 2 THEN f.batch_no + CASE WHEN f.c = 0 THEN 1 ELSE 0 END ELSE f.batch_no + 1 END,
        CASE WHEN f.c = 0 THEN 1 WHEN f.l + b.chars + 2 <= 20000 THEN f.c + 1 WHEN f.c >= 2 THEN 1 ELSE 0 END,
        CASE WHEN f.c = 0 THEN b.chars WHEN f.l + b.chars + 2 <= 20000 THEN f.l + b.chars + 2 WHEN f.c >= 2 THEN b.chars ELSE 0 END
      FROM f JOIN b ON b.source = f.source AND b.n = f.n + 1)
  """
add(
    "pack_no_header",
    lambda s, d: packing.headerless_texts(
        packing.headerless_parts(table(s, d, "documents"), "source", "doc_id", "text"), "source", "doc_id"
    ).select("source", "batch_no", F.md5("batch_text").alias("batch_text")),
    """WITH j AS (SELECT source, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY doc_id) AS t FROM documents GROUP BY 1)
       , n AS (SELECT source, t, unnest(range(0, CAST(ceil(length(t) / 20000) AS BIGINT))) AS batch_no FROM j)
       SELECT source, batch_no, md5(substr(t, batch_no * 20000 + 1, 20000)) AS batch_text FROM n""",
)
add(
    "pack_blocks",
    lambda s, d: packing.pack_blocks(_cards(s, d), "source", "doc_id", "card"),
    _PACK + "SELECT source, doc_id, chars, batch_no FROM f",
)


def _merged(s, d):
    packed = packing.pack_blocks(_cards(s, d), "source", "doc_id", "card", max_chars=20000)
    return packing.merge_batches(packing.batch_sizes(packed, "source"), "source")


add(
    "merge_batches",
    _merged,
    _PACK + """, s AS (SELECT source, batch_no, count(*) AS blocks, sum(chars) + 2 * (count(*) - 1) AS batch_chars, max(max(batch_no)) OVER (PARTITION BY source) + 1 AS n FROM f GROUP BY source, batch_no)
      SELECT source, batch_no, blocks, batch_chars::BIGINT AS batch_chars, CASE WHEN n > 5 THEN least(batch_no // (n // 5), 4) ELSE batch_no END AS merged_no FROM s""",
)
add(
    "batch_texts",
    lambda s, d: packing.batch_texts(_cards(s, d), packing.pack_blocks(_cards(s, d), "source", "doc_id", "card"), "source", "doc_id", "card").withColumn("batch_text", F.md5("batch_text")),
    _PACK + """SELECT source, batch_no, md5(string_agg('表名: ' || source || '.doc_' || doc_id || chr(10) || '列:' || chr(10) || text, chr(10) || chr(10) ORDER BY doc_id)) AS batch_text
      FROM f JOIN documents USING (source, doc_id) GROUP BY ALL""",
)
