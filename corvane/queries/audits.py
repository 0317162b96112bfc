"""Queries of content signals, scores, answers, visibility and calibration."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corvane.operators import answers, lexical, signals, statistics
from corvane.plans import audit
from corvane.queries import common as C
from corvane.queries.evaluation import _ND
from corvane.runtime import materialize, shared_dir
from corvane.sources.files import table


def _measured(s, d):
    docs = C.html_pages(s, d).select("doc_id", "html").join(C.documents(s, d).select("doc_id", "url", "text"), "doc_id")
    return signals.measured(docs, C.chunks(s, d).select("doc_id", "text"), "html")


def _one(name):
    def query(s, d):
        return _measured(s, d).select("doc_id", F.round(name, 6).alias(name))

    query.__module__ = __name__
    return query


sg_stat, sg_cite, sg_quote, sg_auth = _one("statistic_density"), _one("citation_density"), _one("quotation_density"), _one("authority_markers")
sg_schema, sg_heading, sg_self, sg_extract = _one("schema_coverage"), _one("heading_structure"), _one("self_containedness"), _one("extractability")
sg_direct, sg_fresh = _one("answer_directness"), _one("freshness")


def sg_saturate(s, d):
    return C.documents(s, d).select("doc_id", F.round(signals.saturated(F.col("n_chars"), 5000.0), 6).alias("saturated"))


def sg_report(s, d):
    m = _measured(s, d)
    return m.select("doc_id", "url", *[F.round(n, 6).alias(n) for n in signals.NAMES], "n_words", "n_sentences", "n_numbers", "n_statistics", "n_quotes", "n_citations", "n_authority", F.size("warnings").alias("n_warnings"))


def sc_run_audit(s, d):
    """The flagship: every page with its signals and score."""
    docs = C.html_pages(s, d).select("doc_id", "html").join(C.documents(s, d).select("doc_id", "url", "text"), "doc_id")
    a = audit.audit(docs, C.chunks(s, d).select("doc_id", "text"), "html")
    return a.select("doc_id", "url", "score", *[F.round(n, 6).alias(n) for n in signals.NAMES])


def sc_score(s, d):
    return signals.scored(_measured(s, d)).select("doc_id", "score")


#: Weights of the weighted score, before they are divided by their sum.
WEIGHTS = {"statistic_density": 3.0, "answer_directness": 2.0, "self_containedness": 4.0, "extractability": 1.0}


def sc_weights(s, d):
    return signals.scored(_measured(s, d), WEIGHTS).select("doc_id", "score", F.round(F.col("contributions")["self_containedness"], 3).alias("self_part"))


def sc_advice(s, d):
    return signals.scored(_measured(s, d)).select("doc_id", F.size("advice").alias("n_advice"), F.array_join(F.array_sort("advice"), ",").alias("advice"))


def snk_audit(s, d):
    """Page scores written under an audit's id and read back with the audit's mean."""
    path = f"{shared_dir(s)}/audit-{uuid.uuid4().hex}"
    signals.scored(_measured(s, d)).select(F.lit(1).alias("audit_id"), "doc_id", "score").write.mode("overwrite").partitionBy("audit_id").parquet(path)
    back = s.read.schema("doc_id long, score double, audit_id int").parquet(path).where("audit_id = 1")
    return back.groupBy("audit_id").agg(F.count(F.lit(1)).alias("n_pages"), F.round(F.avg("score"), 2).alias("overall"))


def sc_overall(s, d):
    return signals.overall(signals.scored(_measured(s, d)))


FITTED = list(signals.NAMES)


def _weights_rows(s, fit):
    w = fit["weights"] or {n: None for n in FITTED}
    return s.createDataFrame([(n, None if v is None else float(v), fit["r_squared"], int(fit["n"])) for n, v in w.items()], "signal string, weight double, r_squared double, n_rows long")


def sc_nnls(s, d):
    m = materialize(_measured(s, d).join(C.documents(s, d).select("doc_id", (F.col("n_chars") / 10_000).alias("y")), "doc_id"), "fit")
    return _weights_rows(s, statistics.fitted_weights(m, FITTED, "y"))


def sc_corr(s, d):
    return statistics.correlations(materialize(_measured(s, d), "signals"), list(FITTED)).withColumn("r", F.round("r", 6))


def cal_collinear(s, d):
    c = statistics.correlations(materialize(_measured(s, d), "signals"), list(FITTED))
    # a signal without variance correlates with none: NaN, which is above any bound here
    return c.select("a", "b", F.round("r", 6).alias("r")).where(~F.isnan("r") & (F.abs("r") >= 0.05))


def _retrieved(s, d):
    items = table(s, d, "chunks").select(F.col("chunk_id").alias("item_id"), "text")
    return lexical.search(C.query_set(s, d), items, 5, repeated=True)


def _answers(s, d):
    """Answers of six sentences that cite two sources each, some beyond the five retrieved."""
    t = F.regexp_replace("text", r"[.!?\[\]]", "")
    parts = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.concat(F.lit("Point "), i.cast("string"), F.lit(" on "), t, F.lit(" ["), i.cast("string"), F.lit("]["), (i * 3 % 8).cast("string"), F.lit("].")))
    return C.query_set(s, d).select("query_id", F.array_join(parts, " ").alias("answer_text"))


def _sentences(s, d):
    return answers.answer_sentences(_answers(s, d), _retrieved(s, d))


def en_prompt(s, d):
    items = C.chunks(s, d).join(C.documents(s, d).select("doc_id", "url"), "doc_id").select(F.col("chunk_id").alias("item_id"), "url", "text")
    return answers.prompts(_retrieved(s, d), items).select("query_id", F.md5("sources").alias("sources"))


def en_cites(s, d):
    return _sentences(s, d).select("query_id", "sent_no", F.array_join("cited", ",").alias("cited"))


def _targets(s, d):
    return C.chunks(s, d).select(F.col("doc_id").alias("target"), F.col("chunk_id").alias("item_id"))


def vis_metrics(s, d):
    return answers.impressions(_sentences(s, d), _targets(s, d))


def vis_linear(s, d):
    return answers.impressions(_sentences(s, d), _targets(s, d), "linear").select("query_id", "target", "position_share")


def vis_doc(s, d):
    """Shares of the document a query's title was taken from."""
    q = C.query_set(s, d).select("query_id", F.col("doc_id").alias("target"))
    return vis_metrics(s, d).join(q, ["query_id", "target"]).select("query_id", "target", "word_share", "citation_share")


def cal_visibility(s, d):
    return answers.visibility(answers.impressions(_sentences(s, d), _targets(s, d)), _targets(s, d), C.query_set(s, d))


def cal_fit(s, d):
    v = cal_visibility(s, d).withColumnRenamed("target", "doc_id")
    return _weights_rows(s, statistics.fitted_weights(materialize(_measured(s, d).join(v, "doc_id"), "calibration"), FITTED, "visibility"))


def cal_dict(s, d):
    return cal_visibility(s, d).select(F.to_json(F.struct("target", "visibility")).alias("line"))


def _count(pattern: str, text: str = "text") -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _times(marker: str, text: str) -> str:
    return f"((length({text}) - length(replace({text}, '{marker}', ''))) // {len(marker)})"


#: Letters of any script as ASCII ones, for word boundaries of an engine that knows ASCII only.
_PLAIN = r"regexp_replace(d.text, '\p{L}', 'x', 'g')"
_SIG = rf"""{C.HTML}, {C.CHUNKS}, {C.SENTENCES},
dir AS (SELECT doc_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE {" OR ".join(f"contains(' ' || lower(sentence) || ' ', '{m}')" for m in signals.DIRECT)}) AS k FROM sents GROUP BY 1),
slf AS (SELECT doc_id, AVG(CASE WHEN w <> '' AND NOT coalesce(list_contains([{", ".join(f"'{o}'" for o in signals.OPENERS)}], o), FALSE) THEN 1.0 ELSE 0.0 END) AS v FROM (
  SELECT doc_id, w, regexp_extract(lower(w), '[a-z0-9]+') AS o FROM (SELECT doc_id, regexp_extract(text, '[^{C.SP}]+') AS w FROM c)) GROUP BY 1),
raw AS (
  SELECT hp.doc_id, d.url, hp.html, d.text, lower(d.text) AS low, len(regexp_extract_all(lower(d.text), '[a-z0-9]+')) AS n_words,
    {_count(r"(?i)\b\d[\d,]*(?:\.\d+)?[" + C.SP + r"]*(?:%|percent|million|billion|thousand|k|x|hours?|days?|years?)\b", "d.text")} AS n_statistics, {_count(r"\b\d[\d,]*(?:\.\d+)?%?\b", _PLAIN)} AS n_numbers,
    {_count('["“][^"“”]{20,}["”]', "d.text")} AS n_quotes,
    len(list_filter(regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1), lambda x: regexp_matches(x, '^https?://'))) + {_times("source:", "lower(d.text)")} + {_times("according to", "lower(d.text)")} AS n_citations,
    {" + ".join(_times(m, "lower(d.text)") for m in signals.AUTHORITY)} AS n_authority,
    list_transform(regexp_extract_all(html, '(?i)<h([1-6])\b', 1), lambda x: x::INTEGER) AS lv,
    length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '[{C.SP}]+', ' ', 'g'))) AS total
  FROM hp JOIN documents d USING (doc_id)),
sig AS (
  SELECT raw.*, 100.0::DOUBLE / greatest(1, n_words) AS per, coalesce(dir.n, 0) AS n_sentences, coalesce(dir.k, 0) AS k, slf.v AS sv,
    len(list_filter(lv, lambda x: x = 1)) AS ones, len(list_filter(range(2, len(lv) + 1), lambda i: lv[i] - lv[i - 1] > 1)) AS skips
  FROM raw LEFT JOIN dir USING (doc_id) LEFT JOIN slf USING (doc_id)),
m AS (
  SELECT doc_id, url, n_words, n_sentences, n_numbers, n_statistics, n_quotes, n_citations, n_authority, sv,
    round(least(1.0, n_statistics * per / 4.0), 9) AS statistic_density, round(least(1.0, n_citations * per / 2.0), 9) AS citation_density, round(least(1.0, n_quotes * per / 1.5), 9) AS quotation_density, round(least(1.0, n_authority * per / 2.0), 9) AS authority_markers,
    (CASE WHEN doc_id % 10 = 0 THEN 0.5 WHEN doc_id % 5 = 0 THEN 0.25 ELSE 0 END)::DOUBLE AS schema_coverage,
    round(CASE WHEN len(lv) = 0 THEN 0 ELSE least(1.0, (CASE WHEN ones = 1 THEN 0.4 WHEN ones > 1 THEN 0.1 ELSE 0 END)::DOUBLE + (CASE WHEN list_contains(lv, 2) THEN 0.3 ELSE 0 END)::DOUBLE + 0.3::DOUBLE * greatest(0.0, 1 - skips / greatest(1, len(lv) - 1))) END, 9) AS heading_structure,
    round(coalesce(sv, 0), 9)::DOUBLE AS self_containedness, round(CASE WHEN total = 0 THEN 0 ELSE least(1.0, length(text) / total) END, 9)::DOUBLE AS extractability,
    round(CASE WHEN n_sentences = 0 THEN 0 ELSE k / n_sentences END, 9)::DOUBLE AS answer_directness, (CASE WHEN regexp_matches({_PLAIN.replace('d.text', 'text')}, '\b(?:19|20)\d{{2}}\b') THEN 0.5 ELSE 0 END)::DOUBLE AS freshness
  FROM sig)"""
_SCORE = "round(" + " + ".join(f"10.0::DOUBLE * {n}" for n in signals.NAMES) + ", 2)"
_W = signals.weights(WEIGHTS)
_CORR = " UNION ALL ".join(
    f"SELECT '{x}' AS a, '{y}' AS b, CASE WHEN var_pop({x}) < 1e-15 OR var_pop({y}) < 1e-15 THEN 'nan'::DOUBLE ELSE round(covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})), 6) END AS r FROM m" for i, x in enumerate(FITTED) for y in FITTED[i + 1 :]
)
_ANS = f"""{_ND},
ret AS (SELECT query_id, item_id, rank FROM bm WHERE condition = 'b75' AND rank <= 5), items AS (SELECT query_id, array_agg(item_id ORDER BY rank) AS r FROM ret GROUP BY 1),
ans AS (SELECT query_id, i AS sent_no, 'Point ' || i || ' on ' || regexp_replace(text, '[.!?\\[\\]]', '', 'g') || ' [' || i || '][' || (i * 3 % 8) || '].' AS text, list_distinct([i, i * 3 % 8]) AS mk, CASE WHEN i = i * 3 % 8 THEN [i] ELSE [i, i * 3 % 8] END AS marks FROM q, (SELECT unnest(range(1, 7))::INTEGER AS i)),
cit AS (SELECT query_id, sent_no, ans.text, list_filter(list_transform(marks, lambda x: CASE WHEN x >= 1 THEN r[x] END), lambda x: x IS NOT NULL) AS cited FROM ans LEFT JOIN items USING (query_id))"""
_VIS = f"""{_ANS},
ws AS (SELECT query_id, sent_no, cited, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w, 2.0::DOUBLE ** (-(sent_no - 1) / 5.0::DOUBLE) AS d, 1.0::DOUBLE / sent_no AS ld FROM cit),
tot2 AS (SELECT query_id, COUNT(*) AS n_sentences, SUM(w)::BIGINT AS n_words, SUM(w * d) AS ww, SUM(w * ld) AS lw, SUM(coalesce(len(cited), 0)) AS nc FROM ws GROUP BY 1),
hit AS (SELECT query_id, doc_id AS target, sent_no, w, d, ld, COUNT(*) AS c FROM (SELECT query_id, sent_no, w, d, ld, unnest(cited) AS chunk_id FROM ws) JOIN c USING (chunk_id) GROUP BY 1, 2, 3, 4, 5, 6),
vis AS (SELECT hit.query_id, target, n_sentences, n_words, round(SUM(w) / n_words, 9) AS word_share, round(SUM(w * d) / ww, 9) AS position_share, round(SUM(w * ld) / lw, 9) AS linear_share, round(SUM(c) / nc, 9) AS citation_share, MIN(sent_no) AS first_position
  FROM hit JOIN tot2 USING (query_id) GROUP BY hit.query_id, target, n_sentences, n_words, ww, lw, nc),
calv AS (SELECT t.target, round(coalesce(x.s, 0) / (SELECT COUNT(*) FROM q), 9) AS visibility FROM (SELECT DISTINCT doc_id AS target FROM c) t LEFT JOIN (SELECT target, SUM(position_share) AS s FROM vis GROUP BY 1) x USING (target))"""


def sql() -> dict[str, str]:
    one = {"sg_stat": "statistic_density", "sg_cite": "citation_density", "sg_quote": "quotation_density", "sg_auth": "authority_markers", "sg_schema": "schema_coverage", "sg_heading": "heading_structure", "sg_self": "self_containedness", "sg_extract": "extractability", "sg_direct": "answer_directness", "sg_fresh": "freshness"}
    listed = ", ".join(f"round({n}, 6) AS {n}" for n in signals.NAMES)
    gaps = "list_sort(list_filter([" + ", ".join(f"CASE WHEN {n} < 0.5 THEN '{n}' END" for n in signals.NAMES) + "], lambda x: x IS NOT NULL))"
    weighted = " + ".join(f"{100 * _W[n]!r}::DOUBLE * {n}" for n in signals.NAMES)
    return {k: f"WITH {_SIG} SELECT doc_id, round({n}, 6) AS {n} FROM m" for k, n in one.items()} | {
        "sg_saturate": "SELECT doc_id, round(least(1.0, n_chars / 5000.0::DOUBLE), 6)::DOUBLE AS saturated FROM documents",
        "sg_report": f"WITH {_SIG} SELECT doc_id, url, {listed}, n_words, n_sentences, n_numbers, n_statistics, n_quotes, n_citations, n_authority, CASE WHEN sv IS NULL THEN 1 ELSE 0 END AS n_warnings FROM m",
        "sc_run_audit": f"WITH {_SIG} SELECT doc_id, url, {_SCORE} AS score, {listed} FROM m",
        "sc_score": f"WITH {_SIG} SELECT doc_id, {_SCORE} AS score FROM m",
        "sc_weights": f"WITH {_SIG} SELECT doc_id, round({weighted}, 2) AS score, round({100 * _W['self_containedness']!r}::DOUBLE * self_containedness, 3) AS self_part FROM m",
        "sc_advice": f"WITH {_SIG} SELECT doc_id, len({gaps})::INTEGER AS n_advice, array_to_string({gaps}, ',') AS advice FROM m",
        "sc_overall": f"WITH {_SIG} SELECT COUNT(*) AS n_pages, round(AVG({_SCORE}), 2) AS overall FROM m",
        "snk_audit": f"WITH {_SIG} SELECT 1 AS audit_id, COUNT(*) AS n_pages, round(AVG({_SCORE}), 2) AS overall FROM m",
        "sc_corr": f"WITH {_SIG} SELECT * FROM ({_CORR})",
        "cal_collinear": f"WITH {_SIG} SELECT * FROM ({_CORR}) WHERE NOT isnan(r) AND abs(r) >= 0.05",
        "en_prompt": f"WITH {_ANS} SELECT query_id, md5(string_agg('[' || rank || '] (' || coalesce(d.url, '') || ')' || chr(10) || left(c.text, 1500), chr(10) || chr(10) ORDER BY rank)) AS sources FROM ret JOIN c ON c.chunk_id = item_id JOIN documents d ON d.doc_id = c.doc_id GROUP BY 1",
        "en_cites": f"WITH {_ANS} SELECT query_id, sent_no, coalesce(array_to_string(cited, ','), '') AS cited FROM cit",
        "vis_metrics": f"WITH {_VIS} SELECT query_id, target, n_sentences, n_words, word_share, position_share, citation_share, first_position FROM vis",
        "vis_linear": f"WITH {_VIS} SELECT query_id, target, linear_share AS position_share FROM vis",
        "vis_doc": f"WITH {_VIS} SELECT vis.query_id, target, word_share, citation_share FROM vis JOIN q ON q.query_id = vis.query_id AND q.doc_id = target",
        "cal_visibility": f"WITH {_VIS} SELECT * FROM calv",
    }
