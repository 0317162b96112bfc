"""Inputs that several queries share, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.metering import newest
from corvane.sources.files import table

#: White space as Unicode has it, inside a character class of the SQL engine.
SP = r"\t\n\v\f\r \x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def sql_tokens(text: str, stop: bool = True) -> str:
    t = f"regexp_extract_all(lower({text}), '[a-z0-9]+')"
    return f"list_filter({t}, lambda x: NOT list_contains({STOP}, x))" if stop else t


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{SP}]+|[{SP}]+$', '', 'g')"


def sql_norm(text: str) -> str:
    return f"lower(trim(regexp_replace({text}, '[{SP}]+', ' ', 'g')))"


SITE = r"regexp_replace(regexp_extract(lower(trim({u})), '^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', '')"


def sql_site(u: str) -> str:
    return SITE.replace("{u}", u)


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks without repeated rows."""
    return table(spark, d, "chunks").dropDuplicates(["chunk_id"])


CHUNKS = "c AS (SELECT DISTINCT chunk_id, doc_id, strategy, ordinal, text, start_char, end_char, heading_path, parent_id FROM chunks)"


def pages(spark: SparkSession, d: str) -> DataFrame:
    """The newest crawl record of each document."""
    return newest(table(spark, d, "pages").select("doc_id", "fetched_at", "id", "url", "title", "sections"), ["doc_id"], ["fetched_at", "id"])


PAGES = """pg AS (SELECT doc_id, id, url, title, sections FROM (SELECT DISTINCT * FROM pages)
  QUALIFY ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY fetched_at DESC NULLS LAST, id DESC) = 1)"""


def sections(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, section_no, text, heading_path, start_char; a document without sections is one of its own."""
    p = pages(spark, d).select("doc_id", "sections")
    both = documents(spark, d).select("doc_id", "text").join(p, "doc_id", "left").where("text is not null")
    whole = F.array(F.struct(F.array().cast("array<string>").alias("heading_path"), F.lit(0).alias("start_char"), F.char_length("text").cast("int").alias("end_char")))
    listed = F.when(F.coalesce(F.size("sections"), F.lit(0)) > 0, F.col("sections")).otherwise(whole)
    flat = both.select("doc_id", "text", F.posexplode(listed).alias("section_no", "s"))
    return flat.select("doc_id", "section_no", F.substring(F.col("text"), F.col("s.start_char") + 1, F.col("s.end_char") - F.col("s.start_char")).alias("text"), "s.heading_path", "s.start_char")


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


#: Linked data of every fifth page (one type) and every tenth (two types, one inside a graph).
LINKED = (
    '<script type="application/ld+json">{"@type": "Article", "name": "x"}</script>',
    '<script type="application/ld+json">{"@graph": [{"@type": "Article"}, {"@type": ["FAQPage", "Article"]}]}</script>',
)


def html_pages(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, url, html: the tables hold no HTML, so pages are written from titles and sections."""
    both = pages(spark, d).join(documents(spark, d).select("doc_id", "text"), "doc_id").where("text is not null")
    level = lambda s: F.greatest(F.lit(1), F.least(F.lit(6), F.size(s["heading_path"]))).cast("string")
    part = F.transform("sections", lambda s: F.concat(
        F.lit("<h"), level(s), F.lit(' class="x">'), _escaped(F.coalesce(F.element_at(s["heading_path"], -1), F.lit(""))), F.lit("</h"), level(s), F.lit(">\n<p>"),
        _escaped(F.substring(F.col("text"), s["start_char"] + 1, s["end_char"] - s["start_char"])), F.lit("</p>\n")))
    body = F.coalesce(F.array_join(part, ""), F.concat(F.lit("<p>"), _escaped(F.col("text")), F.lit("</p>")))
    html = F.concat(
        F.lit("<html><head><title>"), _escaped(F.coalesce("title", F.lit(""))), F.lit("</title>"), F.when(F.col("doc_id") % 10 == 0, LINKED[1]).when(F.col("doc_id") % 5 == 0, LINKED[0]).otherwise(""), F.lit('<script>var a = "</p>";</script></head><body><nav><a href="/">Home</a></nav>'), body,
        F.lit('<p>More: <a href="/more">more</a> <a class="b" href="'), _escaped(F.col("url")), F.lit('">here</a> <a href="mailto:x@y.example">mail</a></p><footer>&copy; all</footer></body></html>'))
    return both.select("doc_id", "url", html.alias("html"))


def _sql_escaped(c: str) -> str:
    return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


HTML = f"""{PAGES},
hp AS (
  SELECT pg.doc_id, pg.url, '<html><head><title>' || {_sql_escaped("coalesce(pg.title, '')")} || '</title>' || CASE WHEN pg.doc_id % 10 = 0 THEN '{LINKED[1]}' WHEN pg.doc_id % 5 = 0 THEN '{LINKED[0]}' ELSE '' END || '<script>var a = "</p>";</script></head><body><nav><a href="/">Home</a></nav>'
    || CASE WHEN sections IS NULL THEN '<p>' || {_sql_escaped("d.text")} || '</p>' ELSE coalesce(array_to_string(list_transform(sections, lambda s:
      '<h' || greatest(1, least(6, len(s.heading_path)))::VARCHAR || ' class="x">' || {_sql_escaped("coalesce(s.heading_path[-1], '')")} || '</h' || greatest(1, least(6, len(s.heading_path)))::VARCHAR || '>' || chr(10) || '<p>'
      || {_sql_escaped("substring(d.text, s.start_char + 1, s.end_char - s.start_char)")} || '</p>' || chr(10)), ''), '') END
    || '<p>More: <a href="/more">more</a> <a class="b" href="' || {_sql_escaped("pg.url")} || '">here</a> <a href="mailto:x@y.example">mail</a></p><footer>&copy; all</footer></body></html>' AS html
  FROM pg JOIN documents d ON d.doc_id = pg.doc_id WHERE d.text IS NOT NULL)"""

DROPPED = ("script", "style", "nav", "footer", "header", "aside", "noscript", "form")


def sql_without_dropped(page: str) -> str:
    for tag in DROPPED:
        page = rf"regexp_replace({page}, '(?is)<{tag}\b.*?</{tag}>', ' ', 'g')"
    return page


def sql_plain(fragment: str) -> str:
    s = f"regexp_replace({fragment}, '(?s)<[^>]+>', ' ', 'g')"
    s = f"replace(replace(replace(replace({s}, '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&amp;', '&')"
    s = rf"regexp_replace(regexp_replace({s}, '[ \t\r\f\v]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return sql_strip(s)


#: Sentences of documents: doc_id, sent_no, sentence.
SENTENCES = rf"""
pieces AS (
  SELECT doc_id, i, {sql_strip("piece")} AS piece FROM (
    SELECT doc_id, unnest(ps) AS piece, unnest(range(1, len(ps) + 1)) AS i FROM (
      SELECT doc_id, string_split(regexp_replace({sql_strip("text")}, '([.!?])["''\)\]]*[{SP}]+', '\1' || chr(31), 'g'), chr(31)) AS ps FROM documents WHERE text IS NOT NULL))),
flagged AS (
  SELECT doc_id, i, piece, lower(regexp_extract(CASE WHEN rtrim(piece, '"'')]') LIKE '%.' THEN left(rtrim(piece, '"'')]'), -1) ELSE '' END, '([^{SP}]+)[{SP}]*$', 1)) AS last
  FROM pieces WHERE piece <> ''),
grouped AS (
  SELECT doc_id, i, piece, SUM(CASE WHEN held THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (
    SELECT *, coalesce(lag(list_contains([{", ".join(f"'{a}'" for a in T.ABBREVIATIONS)}], last) OR (length(last) = 1 AND regexp_full_match(last, '\p{{L}}'))) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS held FROM flagged)),
sents AS (SELECT doc_id, CAST(g AS INTEGER) AS sent_no, string_agg(piece, ' ' ORDER BY i) AS sentence FROM grouped GROUP BY doc_id, g)"""


def query_set(spark: SparkSession, d: str) -> DataFrame:
    """query_id, text, doc_id: the titles of documents whose id is divisible by 100, the stated query set."""
    q = documents(spark, d).where("doc_id % 100 = 0 and title is not null")
    return q.select(F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("query_id"), F.col("title").alias("text"), "doc_id")


QUERIES = "q AS (SELECT 'q' || doc_id::VARCHAR AS query_id, title AS text, doc_id FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL)"


def span_set(spark: SparkSession, d: str) -> DataFrame:
    """query_id, doc_id, start_char, end_char, grade, text: the first section of a query's document (grade 2) and the second (grade 1)."""
    s = sections(spark, d).where("section_no < 2 and doc_id % 100 = 0")
    return query_set(spark, d).select("query_id", "doc_id").join(s, "doc_id").select(
        "query_id", "doc_id", "start_char", (F.col("start_char") + F.char_length("text")).cast("int").alias("end_char"), (2 - F.col("section_no")).alias("grade"), F.lit(None).cast("string").alias("text")
    )


SPANS = f"""{PAGES}, {QUERIES},
sp AS (
  SELECT 'q' || d.doc_id::VARCHAR AS query_id, d.doc_id, s.start_char, least(s.end_char, length(d.text)) AS end_char, 3 - i AS grade FROM (
    SELECT d.doc_id, d.text, unnest([1, 2]) AS i, CASE WHEN coalesce(len(sections), 0) > 0 THEN sections ELSE [{{'heading_path': []::VARCHAR[], 'start_char': 0, 'end_char': length(d.text)::INTEGER}}] END AS ss
    FROM documents d LEFT JOIN pg ON pg.doc_id = d.doc_id WHERE d.doc_id % 100 = 0 AND d.title IS NOT NULL AND d.text IS NOT NULL) d, LATERAL (SELECT unnest(ss[d.i : d.i]) AS s))"""

#: BM25 of the query set over chunks, by strategy: strategy, query_id, item_id, score, rank.
BM25 = f"""{CHUNKS}, {QUERIES},
tok AS (SELECT strategy, chunk_id, {sql_tokens("text")} AS t FROM c),
tot AS (SELECT strategy, COUNT(*) AS n, AVG(len(t)) AS mean FROM tok GROUP BY 1),
qt AS (SELECT query_id, term, COUNT(*) AS qtf FROM (SELECT query_id, unnest({sql_tokens("text")}) AS term FROM q) GROUP BY 1, 2),
post AS (SELECT strategy, chunk_id, len, term, COUNT(*) AS tf FROM (SELECT strategy, chunk_id, len(t) AS len, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2, 3, 4),
idf AS (SELECT p.strategy, term, ln(1 + (n - COUNT(*) + 0.5) / (COUNT(*) + 0.5)) AS idf, mean FROM post p JOIN tot USING (strategy) GROUP BY p.strategy, term, n, mean),
sc AS (SELECT post.strategy, query_id, chunk_id AS item_id, round(SUM(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 9) AS score
  FROM qt JOIN post USING (term) JOIN idf ON idf.term = post.term AND idf.strategy = post.strategy GROUP BY 1, 2, 3),
bm AS (SELECT * FROM (SELECT strategy, query_id, item_id, score, ROW_NUMBER() OVER (PARTITION BY strategy, query_id ORDER BY score DESC, item_id) AS rank FROM sc WHERE score > 0) WHERE rank <= 10)"""
