"""Queries of chunkers, embeddings, vector and lexical search, fusion and question generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions.security import point_id
from corvane.operators import chunking, embedding, fusion, lexical, questions, vector
from corvane.plans import experiment
from corvane.queries import common as C
from corvane.sources.files import table


def chk_fixed(s, d):
    return chunking.fixed(C.documents(s, d).where("text is not null")).select("chunk_id", "doc_id", "ordinal", "start_char", "end_char", F.md5("text").alias("body"))


def chk_sentence(s, d):
    return chunking.sentence(C.sections(s, d))


def chk_semantic(s, d):
    return chunking.semantic(C.sections(s, d))


def chk_parent(s, d):
    return chunking.parent_child(C.sections(s, d))


def chk_stats(s, d):
    return chunking.statistics(C.chunks(s, d))


def chk_context(s, d):
    c = C.chunks(s, d)
    up = c.select(F.col("chunk_id").alias("parent_id"), F.col("text").alias("parent_text"))
    return c.join(up, "parent_id", "left").select("chunk_id", F.md5(F.coalesce("parent_text", "text")).alias("context"), F.col("parent_text").isNotNull().alias("from_parent"))


def emb_hash(s, d):
    return C.documents(s, d).select("doc_id", embedding.embedder()(F.coalesce("title", F.lit(""))).alias("vec"))


def _embedded(s, d):
    e = table(s, d, "embeddings")
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))


def _top(s, d, metric, k=10):
    q, b = _embedded(s, d)
    return vector.search(q, b, k, metric, digits=6)


def vec_dot(s, d):
    return _top(s, d, "dot")


def vec_cos(s, d):
    return _top(s, d, "cosine")


def vec_l2(s, d):
    return _top(s, d, "euclidean")


def vec_topk(s, d):
    """The 20 nearest others of each query."""
    q, b = _embedded(s, d)
    return vector.search(q, b, 20, "cosine", skip_self=True, digits=6)


def vec_upsert(s, d):
    v = vector.upserted(table(s, d, "vectors"))
    return v.select("chunk_id", "collection_name", F.size("vec").alias("dim"), F.round(F.aggregate(F.coalesce("vec", F.array().cast("array<float>")), F.lit(0.0), lambda a, x: a + F.when(F.isnan(x), 0.0).otherwise(x.cast("double"))), 4).alias("total"))


def vec_coll(s, d):
    return vector.upserted(table(s, d, "vectors"), dim=64).groupBy("collection_name").agg(F.count(F.lit(1)).alias("n_vectors"))


def vec_points(s, d):
    """Stable point ids and payloads of the collections."""
    c = C.chunks(s, d).select("chunk_id", "doc_id", "ordinal")
    return c.join(vector.upserted(table(s, d, "vectors"), dim=64).select("chunk_id", "collection_name"), "chunk_id").select(point_id(F.col("chunk_id")).alias("point_id"), "collection_name", "doc_id", "ordinal")


def emb_st(s, d):
    """The hook for model backends with a stand-in model that counts letters."""

    def load():
        return lambda texts: [[float(x.count("e")), float(len(x))] for x in texts]

    e = embedding.model_embedder(load, "e5")
    v = C.documents(s, d).select("doc_id", e(F.coalesce("title", F.lit(""))).alias("v"))
    return v.select("doc_id", F.get("v", 0).cast("double").alias("n_e"), F.get("v", 1).cast("double").alias("n_chars"))


def vec_dense(s, d):
    """Titles of the query set against titles of all documents by the hashing embedding."""
    embed = embedding.embedder()
    q = C.query_set(s, d).select("query_id", embed(F.col("text")).alias("vec"))
    b = C.documents(s, d).where("title is not null").select(F.col("doc_id").alias("item_id"), embed(F.col("title")).alias("vec"))
    return vector.search(q, b, 10, "cosine", digits=6)


def vec_ann(s, d):
    q, b = _embedded(s, d)
    return vector.approximate(q, b, 10)


def bm25_index(s, d):
    items = C.chunks(s, d).select("strategy", F.col("chunk_id").alias("item_id"), "text")
    return lexical.term_statistics(items, ["strategy"]).withColumn("idf", F.round("idf", 9))


def bm25_score(s, d):
    items = table(s, d, "chunks").select("strategy", F.col("chunk_id").alias("item_id"), "text")
    return lexical.scores(C.query_set(s, d), items, by=["strategy"], repeated=True).withColumn("score", F.round("score", 6))


def bm25_topk(s, d):
    return experiment.lexical_rankings(C.query_set(s, d), C.chunks(s, d)).withColumnRenamed("condition", "strategy").withColumn("score", F.round("score", 6))


def _arms(s, d, k):
    """Two arms over one collection: cosine and dot product of the embeddings, of unequal depth."""
    q, b = _embedded(s, d)
    return vector.search(q, b, k, "cosine", digits=6), vector.search(q, b, k, "euclidean", skip_self=True, digits=6)


def fus_rrf(s, d):
    return fusion.reciprocal_rank(*_arms(s, d, 10))


def fus_weighted(s, d):
    return fusion.weighted(*_arms(s, d, 10), 0.3).withColumn("score", F.round("score", 6))


def fus_alpha(s, d):
    return fusion.weighted(*_arms(s, d, 10), [0.0, 0.25, 0.5, 0.75, 1.0]).withColumn("score", F.round("score", 6))


def fus_hybrid(s, d):
    q, b = _embedded(s, d)
    return fusion.hybrid(lambda k: vector.search(q, b, k, "cosine", digits=6), lambda k: vector.search(q, b, k, "euclidean", skip_self=True, digits=6), 5)


def fus_rerank(s, d):
    """The 50 best sentence chunks by BM25, reranked by the share of query terms."""
    items = C.chunks(s, d).where("strategy = 'sentence'").select(F.col("chunk_id").alias("item_id"), "text")
    base = lexical.search(C.query_set(s, d), items, 50)
    return fusion.rerank(base, C.query_set(s, d), items, 10)


def fus_renumber(s, d):
    return fusion.renumbered(_top(s, d, "cosine").where("item_id % 3 != 0"))


def _units(s, d):
    """The sentence chunks of the tables as generation units."""
    c = C.chunks(s, d).where("strategy = 'sentence'")
    return c.withColumn("long_enough", F.size(F.filter(F.split("text", r"(?U)\s+"), lambda x: x != "")) >= questions.MIN_WORDS)


def qg_units(s, d):
    return questions.units(C.sections(s, d)).select("chunk_id", "doc_id", "ordinal", "long_enough")


def qg_idf(s, d):
    return questions.idf(_units(s, d).where("long_enough")).withColumn("idf", F.round("idf", 9))


def qg_focus(s, d):
    return questions.focus(_units(s, d).where("long_enough"))


def qg_templates(s, d):
    u = _units(s, d)
    return u.select("chunk_id", F.explode(questions.questions_of(F.col("text"), F.lit("it"), 4)).alias("question"))


def qg_heuristic(s, d):
    return questions.generated(_units(s, d).where("long_enough"))


def qg_report(s, d):
    u = _units(s, d)
    return questions.report(u, questions.generated(u.where("long_enough")))


def qg_llm(s, d):
    """Prompts for a model, one per passage, and the answers read back from a canned response."""
    u = _units(s, d).join(C.documents(s, d).select("doc_id", "title"), "doc_id")
    p = questions.prompts(u)
    raw = F.concat(F.lit("```json\n[\"what is "), F.substring(F.md5("prompt"), 1, 6), F.lit("\"]\n```"))
    return p.select("chunk_id", F.char_length("prompt").alias("n_chars"), F.explode(questions.answers_of(raw)).alias("question"))


_E = "e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE)::DOUBLE[64] AS v FROM embeddings)"


def _near(expr: str, extra: str = "") -> str:
    return f"SELECT a.vec_id AS query_id, b.vec_id AS item_id, round({expr}, 6) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 {extra}"


_DOT, _COS, _L2 = "array_inner_product(a.v, b.v)", "array_cosine_similarity(a.v, b.v)", "-array_distance(a.v, b.v)"


def _ranked(inner: str, k: int, part: str = "query_id") -> str:
    return f"SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {part} ORDER BY score DESC, item_id) AS rank FROM ({inner})) WHERE rank <= {k}"


def _arm_sql(k: int) -> str:
    return f"{_E}, a1 AS ({_ranked(_near(_COS), k)}), a2 AS ({_ranked(_near(_L2, 'AND a.vec_id <> b.vec_id'), k)})"


_RRF = "SELECT query_id, item_id, round(SUM(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT query_id, item_id, rank FROM a1 UNION ALL SELECT query_id, item_id, rank FROM a2) GROUP BY 1, 2"
_SCALED = """
s1 AS (SELECT query_id, item_id, CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS x FROM (SELECT *, MIN(score) OVER (PARTITION BY query_id) AS lo, MAX(score) OVER (PARTITION BY query_id) AS hi FROM a1)),
s2 AS (SELECT query_id, item_id, CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS x FROM (SELECT *, MIN(score) OVER (PARTITION BY query_id) AS lo, MAX(score) OVER (PARTITION BY query_id) AS hi FROM a2)),
al AS (SELECT unnest([{alphas}])::DOUBLE AS alpha),
w AS (SELECT alpha, query_id, item_id, round(alpha * coalesce(s1.x, 0) + (1 - alpha) * coalesce(s2.x, 0), 9) AS score FROM s1 FULL JOIN s2 USING (query_id, item_id), al)"""


def _cues(i: int) -> str:
    return "(" + "|".join(questions.TEMPLATES[i][0]) + ")"


def _asked(focus: str, n: int) -> str:
    parts = []
    for i, (_, t) in enumerate(questions.TEMPLATES):
        a, b = t.split("{}")
        digit = " AND regexp_matches(text, '[0-9]')" if i == 0 else ""
        parts.append(f"CASE WHEN regexp_matches(lower(text), '{_cues(i)}'){digit} THEN '{a}' || {focus} || '{b}' END")
    got = f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)[1:{n}]"
    return f"CASE WHEN len({got}) > 0 THEN {got} ELSE ['what is ' || {focus}] END"


_UNITS = f"{C.CHUNKS}, u AS (SELECT *, len(list_filter(regexp_split_to_array(text, '[{C.SP}]+'), lambda x: x <> '')) >= 15 AS long_enough FROM c WHERE strategy = 'sentence')"
#: chunk_id, focus: the last heading, or of a headless passage the three most identifying terms of its first sentence.
_FOCUS = f"""{_UNITS},
bare AS (SELECT chunk_id, text FROM u WHERE long_enough AND coalesce(len(heading_path), 0) = 0), {C.SENTENCES.replace("doc_id", "chunk_id").replace("documents", "bare")},
tk AS (SELECT chunk_id, unnest(t) AS term, unnest(range(0, len(t))) AS pos FROM (SELECT b.chunk_id, {C.sql_tokens("coalesce(s.sentence, b.text)")} AS t FROM bare b LEFT JOIN sents s ON s.chunk_id = b.chunk_id AND s.sent_no = 1)),
tt AS (SELECT chunk_id, term, MIN(pos) AS pos, COUNT(*) AS tn FROM tk GROUP BY 1, 2),
nn AS (SELECT COUNT(*) AS n FROM u WHERE long_enough), dfs AS (SELECT term, COUNT(*) AS df FROM (SELECT unnest(list_distinct({C.sql_tokens("text")})) AS term FROM u WHERE long_enough) GROUP BY 1),
rk AS (SELECT chunk_id, term, pos, ROW_NUMBER() OVER (PARTITION BY chunk_id ORDER BY round(tn * ln((n + 1) / (df + 0.5)), 12) DESC, term) AS r FROM tt JOIN dfs USING (term), nn),
foc AS (SELECT chunk_id, lower(heading_path[-1]) AS focus FROM u WHERE long_enough AND len(heading_path) > 0 UNION ALL SELECT chunk_id, string_agg(term, ' ' ORDER BY pos) AS focus FROM rk WHERE r <= 3 GROUP BY 1)"""
_MADE = f"""{_FOCUS},
asked AS (SELECT chunk_id, doc_id, ordinal, start_char, end_char, text AS passage, {_asked("focus", 2)} AS qs FROM u JOIN foc USING (chunk_id) WHERE long_enough AND focus <> ''),
flat AS (SELECT *, unnest(qs) AS question, unnest(range(0, len(qs))) AS no FROM asked),
uniq AS (SELECT * FROM flat QUALIFY ROW_NUMBER() OVER (PARTITION BY question ORDER BY doc_id, ordinal, no, chunk_id) = 1),
made AS (SELECT *, CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_intersect(qt, {C.sql_tokens("passage")})) / len(qt) END AS o FROM (SELECT *, list_distinct({C.sql_tokens("question")}) AS qt FROM uniq))"""


def sql() -> dict[str, str]:
    return {
        "chk_fixed": f"""
SELECT doc_id::VARCHAR || ':fixed:' || printf('%04d', ordinal) || ':' || left(sha1(body), 10) AS chunk_id, doc_id, ordinal::INTEGER AS ordinal, sc::INTEGER AS start_char, (sc + length(body))::INTEGER AS end_char, md5(body) AS body
FROM (SELECT doc_id, k AS ordinal, array_to_string(w[pos + 1:pos + 256], ' ') AS body, CASE WHEN pos = 0 THEN 0 ELSE length(array_to_string(w[1:pos], ' ')) + 1 END AS sc
  FROM (SELECT doc_id, w, unnest(range(0, len(r))) AS k, unnest(r) AS pos FROM (SELECT doc_id, w, range(0, greatest(len(w) - 32, 1), 224) AS r FROM (SELECT doc_id, regexp_extract_all(text, '[^{C.SP}]+') AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 0)))""",
        "chk_stats": f"WITH {C.CHUNKS} SELECT strategy, COUNT(*) AS n, round(AVG(w), 6) AS mean, round(quantile_cont(w, 0.5), 6) AS median, round(quantile_cont(w, 0.1), 6) AS p10, round(quantile_cont(w, 0.9), 6) AS p90, SUM(w)::BIGINT AS total FROM (SELECT strategy, len(regexp_extract_all(text, '[^{C.SP}]+')) AS w FROM c) GROUP BY 1",
        "chk_context": f"WITH {C.CHUNKS} SELECT c.chunk_id, md5(coalesce(p.text, c.text)) AS context, p.text IS NOT NULL AS from_parent FROM c LEFT JOIN c p ON p.chunk_id = c.parent_id",
        "vec_dot": f"WITH {_E} {_ranked(_near(_DOT), 10)}",
        "vec_cos": f"WITH {_E} {_ranked(_near(_COS), 10)}",
        "vec_l2": f"WITH {_E} {_ranked(_near(_L2), 10)}",
        "vec_topk": f"WITH {_E} {_ranked(_near(_COS, 'AND a.vec_id <> b.vec_id'), 20)}",
        "vec_upsert": "SELECT chunk_id, collection_name, len(vec)::INTEGER AS dim, round(coalesce(list_sum(list_transform(coalesce(vec, []), lambda x: CASE WHEN isnan(x) THEN 0 ELSE x::DOUBLE END)), 0), 4) AS total FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY chunk_id ORDER BY upserted_at DESC) AS r FROM vectors) WHERE r = 1",
        "vec_coll": "SELECT collection_name, COUNT(*) AS n_vectors FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY chunk_id ORDER BY upserted_at DESC) AS r FROM vectors) WHERE r = 1 AND len(vec) = 64 GROUP BY 1",
        "vec_points": f"WITH {C.CHUNKS}, v AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY chunk_id ORDER BY upserted_at DESC) AS r FROM vectors) WHERE r = 1 AND len(vec) = 64), h AS (SELECT c.doc_id, c.ordinal, v.collection_name, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(c.chunk_id)) AS h FROM c JOIN v USING (chunk_id)) SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || printf('%02x', (('0x' || h[17:18])::INTEGER & 63) | 128) || h[19:20] || '-' || h[21:32] AS point_id, collection_name, doc_id, ordinal FROM h",
        "emb_st": "SELECT doc_id, (length(t) - length(replace(t, 'e', '')))::DOUBLE AS n_e, length(t)::DOUBLE AS n_chars FROM (SELECT doc_id, 'passage: ' || coalesce(title, '') AS t FROM documents)",
        "bm25_index": f"WITH {C.CHUNKS}, n AS (SELECT strategy, COUNT(*) AS n FROM c GROUP BY 1) SELECT strategy, term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) AS idf FROM (SELECT strategy, term, COUNT(*) AS df FROM (SELECT strategy, unnest(list_distinct({C.sql_tokens('text')})) AS term FROM c) GROUP BY 1, 2) JOIN n USING (strategy)",
        "bm25_score": f"WITH {C.BM25} SELECT strategy, query_id, item_id, round(score, 6) AS score FROM sc",
        "bm25_topk": f"WITH {C.BM25} SELECT strategy, query_id, item_id, round(score, 6) AS score, rank FROM bm",
        "fus_rrf": f"WITH {_arm_sql(10)} {_ranked(_RRF, 10**9)}",
        "fus_hybrid": f"WITH {_arm_sql(20)} {_ranked(_RRF, 5)}",
        "fus_weighted": f"WITH {_arm_sql(10)}, {_SCALED.format(alphas='0.3')} SELECT query_id, item_id, round(score, 6) AS score, rank FROM ({_ranked('SELECT query_id, item_id, score FROM w', 10**9)})",
        "fus_alpha": f"WITH {_arm_sql(10)}, {_SCALED.format(alphas='0.0, 0.25, 0.5, 0.75, 1.0')} SELECT alpha, query_id, item_id, round(score, 6) AS score, rank FROM ({_ranked('SELECT * FROM w', 10**9, 'alpha, query_id')})",
        "fus_renumber": f"WITH {_E} SELECT query_id, item_id, score, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY rank, item_id) AS rank FROM ({_ranked(_near(_COS), 10)}) WHERE item_id % 3 <> 0",
        "fus_rerank": f"""
WITH {C.BM25.replace("FROM chunks)", "FROM chunks WHERE strategy = 'sentence')", 1)}, b AS (SELECT query_id, item_id FROM ({_ranked("SELECT query_id, item_id, score FROM sc WHERE score > 0", 50)})),
r AS (SELECT b.query_id, b.item_id, round(CASE WHEN len(x) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(x) END, 9) AS score FROM (
  SELECT b.query_id, b.item_id, list_distinct({C.sql_tokens("q.text")}) AS x, {C.sql_tokens("c.text")} AS y FROM b JOIN q USING (query_id) JOIN c ON c.chunk_id = b.item_id) b)
{_ranked("SELECT * FROM r", 10)}""",
        "qg_focus": f"WITH {_FOCUS} SELECT chunk_id, focus FROM foc",
        "qg_idf": f"WITH {_UNITS}, n AS (SELECT COUNT(*) AS n FROM u WHERE long_enough) SELECT term, round(ln((n + 1) / (df + 0.5)), 9) AS idf FROM (SELECT term, COUNT(*) AS df FROM (SELECT unnest(list_distinct({C.sql_tokens('text')})) AS term FROM u WHERE long_enough) GROUP BY 1), n",
        "qg_templates": f"WITH {_UNITS} SELECT chunk_id, unnest({_asked(chr(39) + 'it' + chr(39), 4)}) AS question FROM u",
        "qg_heuristic": f"WITH {_MADE} SELECT 'h_' || left(sha1(chunk_id || '|' || question), 12) AS query_id, question AS text, doc_id, start_char, end_char, chunk_id, round(o, 4) AS overlap, o <= 0.8 AS kept FROM made",
        "qg_report": f"WITH {_MADE} SELECT (SELECT COUNT(*) FROM u WHERE long_enough) AS n_units, (SELECT COUNT(*) FROM u WHERE NOT long_enough) AS n_units_too_short, COUNT(*) FILTER (WHERE o <= 0.8) AS n_generated, COUNT(*) FILTER (WHERE o > 0.8) AS n_dropped_overlap, round(AVG(round(o, 4)), 6) AS mean_lexical_overlap FROM made",
    }
