"""Queries of metering, limits, sessions and the relational shapes of the service's reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import security
from corvane.operators import extraction, metering
from corvane.queries import common as C
from corvane.sources.files import table

METRICS = ["click", "view", "purchase", "refund"]


def qt_period(s, d):
    return table(s, d, "events").select("event_id", F.date_format("ts", "yyyy-MM").alias("period"))


def qt_record(s, d):
    return metering.usage(table(s, d, "events"), amount="value").withColumn("used", F.round("used", 4))


def qt_snapshot(s, d):
    """What is left of an allowance of 40 events of each kind and month."""
    u = metering.usage(table(s, d, "events"))
    return u.select("user_id", "period", "metric", "used", F.greatest(F.lit(0.0), 40 - F.col("used")).alias("remaining"))


def rel_usage(s, d):
    e = table(s, d, "events")
    return metering.zero_filled(metering.usage(e), e, METRICS, "user_id")


def rel_experiments(s, d):
    """Strategies of each site's chunks."""
    return table(s, d, "chunks").select("site_id", "strategy").distinct()


def rel_audits(s, d):
    """The second page of ten of the crawls with their sites, newest first."""
    c = table(s, d, "crawls").dropDuplicates().select("id", "site_id", F.lower("status").alias("status"), "pages_fetched")
    both = c.join(table(s, d, "sites").select(F.col("id").alias("site_id"), "host"), "site_id")
    return metering.page_of(both, [F.desc("id")], 10, 10)


def rel_audit(s, d):
    """The newest crawl of each site."""
    c = table(s, d, "crawls").dropDuplicates().select("site_id", "started_at", "id", F.lower("status").alias("status"), "pages_fetched")
    return metering.newest(c, ["site_id"], ["started_at", "id"]).select("site_id", "id", "status", "pages_fetched")


def rel_audit_del(s, d):
    """Pages left when failed crawls are deleted with what they fetched."""
    failed = table(s, d, "crawls").where("lower(status) = 'failed'").select(F.col("id").alias("crawl_id"))
    return metering.without(table(s, d, "pages").dropDuplicates(["id"]).select("id", "crawl_id", "doc_id"), failed, "crawl_id")


def snk_fail(s, d):
    """States of crawls after those with an error were marked failed: marks are appended, and of each crawl the newest holds."""
    c = table(s, d, "crawls").dropDuplicates().select("id", F.lower("status").alias("status"), "error")
    marks = c.where("coalesce(error, '') != ''").select("id", F.lit(1).alias("no"), F.lit("failed").alias("status"))
    return metering.newest(c.select("id", F.lit(0).alias("no"), "status").unionByName(marks), ["id"], ["no"]).select("id", "status")


def rel_default_org(s, d):
    return table(s, d, "sites").agg(F.min("org_id").alias("org_id"))


def rel_counts(s, d):
    c = table(s, d, "crawls").dropDuplicates()
    return c.groupBy("org_id").agg(F.countDistinct("site_id").alias("n_sites"), F.count_if(F.lower("status").isin("pending", "running")).alias("n_open"), F.count(F.lit(1)).alias("n_crawls"))


def rel_tenant(s, d):
    """Crawl and page counts by organisation, of the crawl or else of its site."""
    c = table(s, d, "crawls").dropDuplicates().select(F.col("id").alias("crawl_id"), "site_id", "org_id")
    org = c.join(table(s, d, "sites").select(F.col("id").alias("site_id"), F.col("org_id").alias("site_org")), "site_id", "left").select("crawl_id", F.coalesce("org_id", "site_org").alias("org"))
    p = table(s, d, "pages").dropDuplicates(["id"]).groupBy("crawl_id").agg(F.count(F.lit(1)).alias("n"))
    return org.join(p, "crawl_id", "left").groupBy("org").agg(F.count(F.lit(1)).alias("n_crawls"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pages"))


def rel_revenue(s, d):
    """A star join: turnover by region and year."""
    o, li = table(s, d, "orders"), table(s, d, "lineitem")
    c, n, r = table(s, d, "customer"), table(s, d, "nation"), table(s, d, "region")
    x = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return x.groupBy("r_name", F.year("o_orderdate").cast("long").alias("year")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


def _calls(s, d):
    return table(s, d, "events").select(F.col("event_id").alias("call_id"), F.col("user_id").alias("caller"), "ts")


def ev_bucket(s, d):
    """A bucket of one call per ten minutes and a burst of one."""
    return metering.token_bucket(_calls(s, d), per_minute=0.1, burst=1)


def ev_limitmw(s, d):
    key = F.when(F.col("event_type") != "view", F.concat(F.lit("c"), F.col("user_id").cast("string")))
    return table(s, d, "events").select("event_id", metering.caller_key(key, F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string"))).alias("caller"))


def ev_dedup(s, d):
    return extraction.first_of_each_text(C.documents(s, d), "doc_id").select("doc_id")


def ev_sessions(s, d):
    return metering.sessions(table(s, d, "events")).select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "n_events")


def ev_apply(s, d):
    """Events whose k is below the greatest k their user has had before."""
    e = table(s, d, "events").select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("arrived"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    return metering.latest_state(e, "user_id", "k").select("id", "stale")


def ev_parse(s, d):
    return table(s, d, "events").select("event_id", F.upper("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("k"))


def ev_verify(s, d):
    """Signed events, every second one changed after signing, every third one too old."""
    e = table(s, d, "events").select("event_id", "props", (F.lit(1_700_000_000) + F.col("event_id")).alias("at"))
    e = e.withColumn("sig", security.signature("key")(F.col("props"), F.col("at")))
    sent = F.when(F.col("event_id") % 2 == 1, F.concat("props", F.lit(" "))).otherwise(F.col("props"))
    return e.select("event_id", security.verified("key")(sent, F.col("at"), F.col("sig"), F.col("at") + F.when(F.col("event_id") % 3 == 0, 301).otherwise(300)).alias("valid"))


def ev_apikey(s, d):
    """Keys of the form gk_live_<lookup>.<secret>, parsed, the secret hashed."""
    raw = F.concat(F.lit("gk_live_"), F.substring(F.md5(F.col("id").cast("string")), 1, 8), F.lit("."), F.col("host"))
    return table(s, d, "sites").select("id", F.regexp_extract(raw, r"^gk_(?:live|test)_([A-Za-z0-9]+)\.(.+)$", 1).alias("lookup_id"), F.sha2(F.regexp_extract(raw, r"^gk_(?:live|test)_([A-Za-z0-9]+)\.(.+)$", 2), 256).alias("secret_hash"))


def sql() -> dict[str, str]:
    return {
        "qt_period": "SELECT event_id, strftime(ts, '%Y-%m') AS period FROM events",
        "qt_record": "SELECT user_id, strftime(ts, '%Y-%m') AS period, event_type AS metric, round(SUM(value), 4) AS used FROM events GROUP BY 1, 2, 3",
        "qt_snapshot": "SELECT user_id, period, metric, used, greatest(0.0, 40 - used)::DOUBLE AS remaining FROM (SELECT user_id, strftime(ts, '%Y-%m') AS period, event_type AS metric, COUNT(*)::DOUBLE AS used FROM events GROUP BY 1, 2, 3)",
        "rel_usage": "SELECT u.user_id, m.metric, coalesce(n, 0)::DOUBLE AS used FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(['click', 'view', 'purchase', 'refund']) AS metric) m LEFT JOIN (SELECT user_id, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2) e ON e.user_id = u.user_id AND e.event_type = m.metric",
        "rel_experiments": "SELECT DISTINCT site_id, strategy FROM chunks",
        "rel_audits": "SELECT c.id, c.site_id, lower(status) AS status, pages_fetched, host FROM (SELECT DISTINCT * FROM crawls) c JOIN sites s ON s.id = c.site_id ORDER BY c.id DESC LIMIT 10 OFFSET 10",
        "rel_audit": "SELECT site_id, id, lower(status) AS status, pages_fetched FROM (SELECT DISTINCT * FROM crawls) QUALIFY ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY started_at DESC NULLS LAST, id DESC) = 1",
        "rel_audit_del": "SELECT DISTINCT id, crawl_id, doc_id FROM pages WHERE crawl_id IS NULL OR crawl_id NOT IN (SELECT id FROM crawls WHERE lower(status) = 'failed')",
        "snk_fail": "SELECT id, CASE WHEN bool_or(coalesce(error, '') <> '') THEN 'failed' ELSE MAX(lower(status)) END AS status FROM crawls GROUP BY id",
        "rel_default_org": "SELECT MIN(org_id) AS org_id FROM sites",
        "rel_counts": "SELECT org_id, COUNT(DISTINCT site_id) AS n_sites, COUNT(*) FILTER (WHERE lower(status) IN ('pending', 'running')) AS n_open, COUNT(*) AS n_crawls FROM (SELECT DISTINCT * FROM crawls) GROUP BY 1",
        "rel_tenant": "WITH k AS (SELECT DISTINCT id, site_id, org_id FROM crawls), o AS (SELECT k.id AS crawl_id, coalesce(k.org_id, s.org_id) AS org FROM k LEFT JOIN sites s ON s.id = k.site_id), p AS (SELECT crawl_id, COUNT(DISTINCT id) AS n FROM pages GROUP BY 1) SELECT org, COUNT(*) AS n_crawls, coalesce(SUM(n), 0)::BIGINT AS n_pages FROM o LEFT JOIN p USING (crawl_id) GROUP BY 1",
        "rel_revenue": "SELECT r_name, year(o_orderdate)::BIGINT AS year, round(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
        "ev_limitmw": "SELECT event_id, CASE WHEN event_type <> 'view' THEN 'k:' || left(sha256('c' || user_id), 24) ELSE 'ip:10.0.0.' || (user_id % 250) END AS caller FROM events",
        "ev_dedup": f"SELECT MIN(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY trim(regexp_replace(text, '[{C.SP}]+', ' ', 'g'))",
        "ev_sessions": "SELECT user_id, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS started, COUNT(*) AS n_events FROM (SELECT user_id, ts, SUM(CASE WHEN ts < p + INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, g",
        "ev_apply": "SELECT event_id AS id, coalesce(k < MAX(k) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS stale FROM (SELECT event_id, user_id, ts, json_extract_string(props, '$.k')::INTEGER AS k FROM events)",
        "ev_parse": "SELECT event_id, upper(event_type) AS kind, json_extract_string(props, '$.k')::INTEGER AS k FROM events",
        "ev_verify": "SELECT event_id, event_id % 2 = 0 AND event_id % 3 <> 0 AS valid FROM events",
        "ev_apikey": "SELECT id, left(md5(id::VARCHAR), 8) AS lookup_id, sha256(host) AS secret_hash FROM sites",
    }
