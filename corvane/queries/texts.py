"""Queries of text, url, html and crawl operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import html as H
from corvane.functions import text as T
from corvane.functions import urls as U
from corvane.operators import extraction as X
from corvane.queries import common as C
from corvane.runtime import shared_dir
from corvane.sources import files, page_cache
from corvane.sources.files import table


def txt_words(s, d):
    return C.documents(s, d).select("doc_id", T.word_count(F.col("text")).alias("n_words"), F.size(T.words(F.col("text"))).alias("n_split"))


def txt_tokenize(s, d):
    t, u = T.tokens(F.col("text"), stop=False), T.tokens(F.col("text"))
    return C.documents(s, d).select("doc_id", F.size(t).alias("n_tokens"), F.size(u).alias("n_content"), F.size(F.array_distinct(u)).alias("n_distinct"), F.md5(F.array_join(u, " ")).alias("content"))


def txt_sentences(s, d):
    x = C.documents(s, d).where("text is not null").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("p", "sentence"))
    return x.select("doc_id", (F.col("p") + 1).alias("sent_no"), "sentence")


def txt_norm(s, d):
    n = T.normalised(F.col("text"))
    return C.documents(s, d).select("doc_id", F.char_length(n).alias("n_chars_norm"), F.md5(n).alias("norm"))


def txt_chunkid(s, d):
    c = C.chunks(s, d)
    return c.select("chunk_id", T.chunk_id(F.col("doc_id"), F.col("strategy"), F.col("ordinal"), F.col("text")).alias("made_id"))


def txt_qid(s, d):
    return C.documents(s, d).where("title is not null").select("doc_id", T.query_id(F.col("doc_id").cast("string"), F.col("title")).alias("query_id"))


def txt_overlap(s, d):
    return C.documents(s, d).where("title is not null").select("doc_id", F.round(T.lexical_overlap(F.col("title"), F.col("text")), 9).alias("overlap"))


def txt_prefixcov(s, d):
    return C.documents(s, d).where("title is not null").select("doc_id", F.round(T.edge_coverage(F.col("title"), F.col("text")), 9).alias("coverage"))


def txt_ngrams(s, d):
    g = T.ngrams(F.coalesce("title", F.lit("")))
    return C.documents(s, d).select("doc_id", F.size(g).alias("n_features"), F.size(F.array_distinct(g)).alias("n_distinct"), F.md5(F.array_join(g, "|")).alias("features"))


def txt_slug(s, d):
    return table(s, d, "sites").select("id", T.slug(F.coalesce("name", F.lit(""))).alias("slug")).unionByName(C.documents(s, d).select(F.col("doc_id").alias("id"), T.slug(F.coalesce("title", F.lit(""))).alias("slug")))


def txt_redact(s, d):
    p = table(s, d, "pages").dropDuplicates(["id"]).where("extra is not null")
    m = T.redacted_map(F.from_json("extra", "map<string,string>"), ("extractor",))
    return p.select("id", m["extractor"].alias("extractor"), m["text_length"].alias("text_length"))


def ext_docid(s, d):
    return C.documents(s, d).select("doc_id", F.substring(F.sha1("url"), 1, 16).alias("doc_key"))


def ext_drop(s, d):
    x = H.without_dropped(F.col("html"))
    return C.html_pages(s, d).select("doc_id", F.char_length(x).alias("n_chars"), F.md5(x).alias("page"))


def ext_title(s, d):
    return C.html_pages(s, d).select("doc_id", H.title(F.col("html")).alias("title"))


def ext_text(s, d):
    return C.html_pages(s, d).select("doc_id", H.text(F.col("html")).alias("text"))


def ext_plain(s, d):
    return C.html_pages(s, d).select("doc_id", F.md5(H.plain(F.col("html"))).alias("plain"))


def ext_norm(s, d):
    return C.documents(s, d).select("doc_id", F.md5(H.tidy(F.col("text"))).alias("tidy"))


def ext_sections(s, d):
    return X.sections(C.html_pages(s, d), "doc_id").withColumn("heading_path", F.array_join("heading_path", " > ")).withColumn("text", F.md5("text"))


def ext_document(s, d):
    return X.documents(C.html_pages(s, d))


def src_links(s, d):
    return X.links(C.html_pages(s, d))


def src_canon(s, d):
    return C.documents(s, d).select("doc_id", U.canonical(F.col("url")).alias("canonical"))


def src_fprint(s, d):
    return X.first_of_each_text(C.documents(s, d)).select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"))


def _edges(s, d):
    """A link graph over each site's documents: the n-th links to the 2n-th and the next one."""
    r = C.documents(s, d).select("doc_id", U.site_of(F.col("url")).alias("site")).where("site is not null")
    n = r.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("doc_id")))
    e = n.select("site", F.col("doc_id").alias("src"), F.explode(F.array(F.col("n") * 2, F.col("n") * 2 + 1)).alias("m")).join(n.select("site", F.col("n").alias("m"), F.col("doc_id").alias("dst")), ["site", "m"])
    return e.select("src", "dst"), n.where("n = 1").select(F.col("doc_id").alias("node"))


def src_crawl(s, d):
    edges, seeds = _edges(s, d)
    return X.reachable(edges, seeds)


def src_frontier(s, d):
    docs = C.documents(s, d).where("url is not null")
    found = docs.select("url", F.col("url").alias("src"), F.col("doc_id").alias("seen_at"))
    return X.frontier(found, docs.where("doc_id % 3 = 0"), 50)


def src_stats(s, d):
    c = table(s, d, "crawls").dropDuplicates()
    return c.groupBy(F.lower("status").alias("state")).agg(F.count(F.lit(1)).alias("n_crawls"), F.sum("pages_fetched").alias("pages_fetched"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("n_errors"), F.count_if(F.col("finished_at").isNull()).alias("n_open"))


#: Rules of the robots queries: general ones and one site's own.
RULES = [(None, 1, "/p/page-1", True), (None, 2, "/p/", False), (None, 3, "/blog/", False), ("kesvontgi-yard.example", 1, "/blog/ith", True), ("kesvontgi-yard.example", 2, "/", False)]


def src_robots(s, d):
    rules = s.createDataFrame(RULES, "host string, rule_no int, path string, allow boolean")
    return X.robots_allowed(C.documents(s, d).where("url is not null"), rules)


def src_delay(s, d):
    declared = F.when(F.col("id") % 3 == 0, F.col("id") % 7).cast("double")
    return table(s, d, "sites").select("id", F.greatest(F.lit(1.0), F.coalesce(declared, F.lit(1.0))).alias("delay"))


def src_urlpolicy(s, d):
    return C.documents(s, d).select("doc_id", U.refusal(F.col("url")).alias("reason"))


def _ip(c):
    n = F.pmod(c * F.lit(2654435761), F.lit(4294967296))
    return F.concat_ws(".", *[F.pmod(F.shiftrightunsigned(n, b), F.lit(256)).cast("string") for b in (24, 16, 8, 0)])


def src_ipblock(s, d):
    ip = _ip(F.col("event_id"))
    return table(s, d, "events").select("event_id", ip.alias("ip"), U.blocked_ipv4(ip).alias("blocked"))


def src_safeget(s, d):
    hops = C.documents(s, d).select(F.col("doc_id").alias("url"), F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") + 1).alias("location"))
    ok = hops.join(hops.select(F.col("url").alias("location")), "location", "left_semi").select("url", "location")
    ends = hops.join(ok, "url", "left_anti").select("url", F.lit(None).cast("long").alias("location"))
    return X.redirect_chains(ok.unionByName(ends))


def src_cap(s, d):
    n = F.octet_length("text")
    return C.documents(s, d).select("doc_id", n.alias("n_bytes"), (n <= 20_000).alias("within"))


def src_rehydrate(s, d):
    x = C.sections(s, d)
    return x.select("doc_id", "section_no", F.array_join("heading_path", " > ").alias("heading"), "start_char", F.char_length("text").alias("n_chars"), F.md5("text").alias("section"))


def src_jsonl(s, d):
    q = C.query_set(s, d).select("query_id", "text", F.lit("human").alias("provenance"), F.col("doc_id").alias("source_doc_id"))
    path = f"{shared_dir(s)}/query-set-{uuid.uuid4().hex}"
    files.write_query_set(q, path)
    return files.read_query_set(s, path).select("query_id", "text", "provenance", "source_doc_id")


def _by_url(s, d):
    """One page a url: that of the smallest doc_id."""
    return C.html_pages(s, d).groupBy("url").agg(F.min(F.struct("doc_id", "html")).alias("p")).select("url", "p.html")


def src_cache(s, d):
    folder = f"{shared_dir(s).removeprefix('file://')}/cache-{uuid.uuid4().hex}"
    p = _by_url(s, d)
    files.write_page_cache(p, folder).count()
    return files.read_page_cache(s, folder, p).select("url", F.md5("html").alias("page"), "status")


def src_sitemaps(s, d):
    """Sitemaps of robots files written for the sites."""
    body = F.concat(F.lit("User-agent: *\nDisallow: /x\nSitemap: https://"), F.lower("host"), F.lit("/sitemap.xml\nsitemap:https://"), F.lower("host"), F.lit("/news.xml\n"))
    return X.sitemaps(table(s, d, "sites").select("host", body.alias("body")))


def src_fetch(s, d):
    """All pages from a cache folder through the data source; two documents of one url share a file."""
    folder = f"{shared_dir(s).removeprefix('file://')}/fetch-{uuid.uuid4().hex}"
    files.write_page_cache(_by_url(s, d), folder).count()
    page_cache.register(s)
    return s.read.format("page_cache").option("folder", folder).load().select("name", F.md5("html").alias("page"), "status")


_EDGE_SQL = f"""
n AS (SELECT doc_id, site, ROW_NUMBER() OVER (PARTITION BY site ORDER BY doc_id) AS n FROM (SELECT doc_id, {C.sql_site("url")} AS site FROM documents) WHERE site <> ''),
e AS (SELECT a.doc_id AS src, b.doc_id AS dst FROM n a JOIN n b ON a.site = b.site AND b.n IN (2 * a.n, 2 * a.n + 1))"""

_PATH = r"CASE WHEN regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1) END"
_PARTS = r"""SELECT {key}, lower(regexp_extract(trim({u}), '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS sch, regexp_extract(trim({u}), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1) AS auth,
  regexp_extract(trim({u}), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS path, regexp_extract(trim({u}), '^[^?#]*\?([^#]*)', 1) AS qs"""
_CANON = r"sch || '://' || lower(auth) || CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END || CASE WHEN qs = '' THEN '' ELSE '?' || qs END"


def _ip_sql():
    n = "(event_id::HUGEINT * 2654435761) % 4294967296"
    rng = " OR ".join(f"n BETWEEN {a} AND {b}" for a, b in U.network_ranges())
    return f"SELECT event_id, (n // 16777216)::VARCHAR || '.' || (n // 65536 % 256)::VARCHAR || '.' || (n // 256 % 256)::VARCHAR || '.' || (n % 256)::VARCHAR AS ip, ({rng}) AS blocked FROM (SELECT event_id, {n} AS n FROM events)"


def _rules_sql():
    own = [r for r in RULES if r[0]]
    gen = [r for r in RULES if not r[0]]
    case = lambda rs, last: "CASE " + " ".join(f"WHEN starts_with(path, '{r[2]}') THEN {r[3]}" for r in rs) + f" ELSE {last} END"
    return f"SELECT url, CASE WHEN site = '{own[0][0]}' THEN {case(own, case(gen, True))} ELSE {case(gen, True)} END AS allowed FROM (SELECT DISTINCT url, {C.sql_site('url')} AS site, {_PATH} AS path FROM documents WHERE url IS NOT NULL)"


_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
_TIDY = r"regexp_replace(regexp_replace(text, '[ \t\r\f\v]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"


def sql() -> dict[str, str]:
    sp = C.SP
    toks = C.sql_tokens
    return {
        "txt_words": f"SELECT doc_id, len(regexp_extract_all(text, '[^{sp}]+'))::INTEGER AS n_words, len(regexp_extract_all(text, '[^{sp}]+'))::INTEGER AS n_split FROM documents",
        "txt_tokenize": f"SELECT doc_id, len({toks('text', False)})::INTEGER AS n_tokens, len({toks('text')})::INTEGER AS n_content, len(list_distinct({toks('text')}))::INTEGER AS n_distinct, md5(array_to_string({toks('text')}, ' ')) AS content FROM documents",
        "txt_sentences": f"WITH {C.SENTENCES} SELECT doc_id, sent_no, sentence FROM sents",
        "txt_norm": f"SELECT doc_id, length({C.sql_norm('text')})::INTEGER AS n_chars_norm, md5({C.sql_norm('text')}) AS norm FROM documents",
        "txt_chunkid": f"WITH {C.CHUNKS} SELECT chunk_id, doc_id::VARCHAR || ':' || strategy || ':' || printf('%04d', ordinal) || ':' || left(sha1(text), 10) AS made_id FROM c",
        "txt_qid": "SELECT doc_id, 'h_' || left(sha1(doc_id::VARCHAR || '|' || title), 12) AS query_id FROM documents WHERE title IS NOT NULL",
        "txt_overlap": f"SELECT doc_id, round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, p)) / len(q) END, 9) AS overlap FROM (SELECT doc_id, list_distinct({toks('title')}) AS q, {toks('text')} AS p FROM documents WHERE title IS NOT NULL)",
        "txt_prefixcov": f"""
SELECT doc_id, round(CASE WHEN g = '' THEN 0 ELSE greatest(
  coalesce(list_max(list_filter(range(1, len(w) + 1), lambda i: contains(h, array_to_string(w[1:i], ' ')))), 0), coalesce(list_max(list_filter(range(1, len(w) + 1), lambda i: contains(h, array_to_string(w[len(w) - i + 1:len(w)], ' ')))), 0)) / len(w) END, 9) AS coverage
FROM (SELECT doc_id, {C.sql_norm('title')} AS g, string_split({C.sql_norm('title')}, ' ') AS w, {C.sql_norm('text')} AS h FROM documents WHERE title IS NOT NULL)""",
        "txt_ngrams": f"""
SELECT doc_id, len(f)::INTEGER AS n_features, len(list_distinct(f))::INTEGER AS n_distinct, md5(array_to_string(f, '|')) AS features FROM (
  SELECT doc_id, t || list_transform(range(1, len(t)), lambda i: array_to_string(t[i:i + 1], ' ')) || list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' ')) AS f
  FROM (SELECT doc_id, {toks("coalesce(title, '')", False)} AS t FROM documents))""",
        "txt_slug": "SELECT id, CASE WHEN length(s) >= 3 THEN s ELSE 'org' END AS slug FROM (SELECT id, left(trim(regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g'), '-'), 48) AS s FROM (SELECT id, coalesce(name, '') AS n FROM sites UNION ALL SELECT doc_id, coalesce(title, '') FROM documents))",
        "txt_redact": "SELECT DISTINCT id, '[redacted]' AS extractor, json_extract_string(extra, '$.text_length') AS text_length FROM pages WHERE extra IS NOT NULL",
        "ext_docid": "SELECT doc_id, left(sha1(url), 16) AS doc_key FROM documents",
        "ext_drop": f"WITH {C.HTML} SELECT doc_id, length({C.sql_without_dropped('html')})::INTEGER AS n_chars, md5({C.sql_without_dropped('html')}) AS page FROM hp",
        "ext_title": f"WITH {C.HTML} SELECT doc_id, {C.sql_plain(_TITLE)} AS title FROM hp",
        "ext_text": f"WITH {C.HTML} SELECT doc_id, {C.sql_plain(C.sql_without_dropped('html'))} AS text FROM hp",
        "ext_plain": f"WITH {C.HTML} SELECT doc_id, md5({C.sql_plain('html')}) AS plain FROM hp",
        "ext_norm": f"SELECT doc_id, md5({C.sql_strip(_TIDY)}) AS tidy FROM documents",
        "ext_document": f"WITH {C.HTML} SELECT doc_id, url, left(sha1(url), 16) AS doc_key, {C.sql_plain(_TITLE)} AS title, {C.sql_plain(C.sql_without_dropped('html'))} AS text FROM hp",
        "src_canon": f"SELECT doc_id, {_CANON} AS canonical FROM ({_PARTS.format(key='doc_id', u='url')} FROM documents)",
        "src_links": f"WITH {C.HTML}, r AS (SELECT url, replace(unnest(list_filter(regexp_extract_all(html, '(?i)<a\\b[^>]*href=[\"'']([^\"'']+)[\"'']', 1), lambda x: NOT regexp_matches(lower(x), '^(mailto:|tel:|javascript:|#)'))), '&amp;', '&amp;') AS ref FROM hp),"
        f" b AS ({_PARTS.format(key='url, ref', u='url')} FROM r), j AS (SELECT url, CASE WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN ref ELSE sch || '://' || auth || ref END AS t FROM b),"
        f" k AS ({_PARTS.format(key='url', u='t')} FROM j) SELECT DISTINCT url, {_CANON} AS target FROM k",
        "src_fprint": f"SELECT MIN(doc_id) AS doc_id, fp AS fingerprint FROM (SELECT doc_id, sha1(trim(regexp_replace(text, '[{sp}]+', ' ', 'g'))) AS fp FROM documents) WHERE fp IS NOT NULL GROUP BY fp",
        "src_crawl": f"WITH RECURSIVE {_EDGE_SQL}, r AS (SELECT doc_id AS node, 0 AS depth FROM n WHERE n = 1 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node) SELECT node, MIN(depth)::INTEGER AS depth FROM r GROUP BY node",
        "src_frontier": rf"""
SELECT * FROM (SELECT url, seen_at, ROW_NUMBER() OVER (PARTITION BY {C.sql_site('url')} ORDER BY seen_at, url) AS rank FROM (
  SELECT url, MIN(doc_id) AS seen_at FROM documents WHERE url IS NOT NULL AND {C.sql_site('url')} <> '' AND NOT regexp_matches(lower(url), '\.(pdf|jpg|jpeg|png|gif|svg|webp|ico|zip|gz|mp4|mp3|css|js|xml|json)$') GROUP BY url)
  WHERE url NOT IN (SELECT url FROM documents WHERE doc_id % 3 = 0 AND url IS NOT NULL)) WHERE rank <= 50""",
        "src_stats": "SELECT lower(status) AS state, COUNT(*) AS n_crawls, SUM(pages_fetched)::BIGINT AS pages_fetched, COUNT(*) FILTER (WHERE coalesce(error, '') <> '') AS n_errors, COUNT(*) FILTER (WHERE finished_at IS NULL) AS n_open FROM (SELECT DISTINCT * FROM crawls) GROUP BY 1",
        "src_robots": _rules_sql(),
        "src_delay": "SELECT id, greatest(1.0, coalesce(CASE WHEN id % 3 = 0 THEN id % 7 END, 1.0))::DOUBLE AS delay FROM sites",
        "src_urlpolicy": rf"""
SELECT doc_id, CASE WHEN sch NOT IN ('http', 'https') THEN 'scheme' WHEN host = '' THEN 'missing_host' WHEN port NOT IN (80, 443, 8080, 8443) THEN 'port' END AS reason
FROM (SELECT doc_id, sch, regexp_extract(lower(auth), '^(?:[^@]*@)?([^:]*)', 1) AS host, CASE WHEN regexp_matches(auth, ':[^:@]+$') THEN TRY_CAST(regexp_extract(auth, ':([^:@]*)$', 1) AS INTEGER) WHEN sch = 'https' THEN 443 ELSE 80 END AS port
  FROM ({_PARTS.format(key='doc_id', u='url')} FROM documents))""",
        "src_ipblock": _ip_sql(),
        "src_safeget": """
WITH h AS (SELECT doc_id AS url, CASE WHEN doc_id % 7 <> 0 AND doc_id + 1 IN (SELECT doc_id FROM documents) THEN doc_id + 1 END AS location FROM documents),
r AS (SELECT url, url AS at, 0 AS n FROM h)
SELECT url, CASE WHEN bad THEN NULL ELSE url + n END AS final, n::INTEGER AS n_hops, CASE WHEN bad THEN 'too_many_redirects' ELSE 'ok' END AS outcome FROM (
  SELECT url, least(5, k) AS n, k > 5 AS bad FROM (
    SELECT a.url, MIN(b.url) - a.url AS k FROM h a JOIN h b ON b.url >= a.url AND b.url <= a.url + 7 AND b.location IS NULL GROUP BY a.url))""",
        "src_cap": "SELECT doc_id, strlen(text)::INTEGER AS n_bytes, strlen(text) <= 20000 AS within FROM documents",
        "src_rehydrate": f"""
WITH {C.PAGES} SELECT doc_id, i - 1 AS section_no, array_to_string(s.heading_path, ' > ') AS heading, s.start_char, length(substring(text, s.start_char + 1, s.end_char - s.start_char))::INTEGER AS n_chars, md5(substring(text, s.start_char + 1, s.end_char - s.start_char)) AS section
FROM (SELECT doc_id, text, unnest(ss) AS s, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT d.doc_id, d.text, CASE WHEN coalesce(len(sections), 0) > 0 THEN sections ELSE [{{'heading_path': []::VARCHAR[], 'start_char': 0, 'end_char': length(d.text)::INTEGER}}] END AS ss FROM documents d LEFT JOIN pg ON pg.doc_id = d.doc_id WHERE d.text IS NOT NULL))""",
        "src_jsonl": "SELECT 'q' || doc_id::VARCHAR AS query_id, title AS text, 'human' AS provenance, doc_id AS source_doc_id FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL",
        "src_sitemaps": "SELECT host, 'https://' || lower(host) || unnest(['/sitemap.xml', '/news.xml']) AS sitemap FROM sites",
        "src_fetch": f"WITH {C.HTML} SELECT sha1(url) AS name, md5(arg_min(html, doc_id)) AS page, 'ok' AS status FROM hp GROUP BY url",
        "src_cache": f"WITH {C.HTML} SELECT url, md5(arg_min(html, doc_id)) AS page, 'ok' AS status FROM hp GROUP BY url",
    }
