"""HTML pages to documents and headed sections; link graphs, crawling order and content fingerprints."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import html as H
from corvane.functions import text as T
from corvane.functions import urls as U
from corvane.runtime import materialize


def documents(pages: DataFrame, page: str = "html") -> DataFrame:
    """The columns of ``pages`` but the page, with title, text and doc_key (first 16 digits of the url's sha1). Null pages give null text."""
    return pages.select(
        *[c for c in pages.columns if c != page], F.substring(F.sha1("url"), 1, 16).alias("doc_key"), H.title(F.col(page)).alias("title"), H.text(F.col(page)).alias("text")
    )


def sections(pages: DataFrame, key: str, page: str = "html") -> DataFrame:
    """key, section_no, heading_path, text, start_char: text below each heading, before the first one with an empty path.

    Sections without text are left out and have no number. The path holds the non-empty headings above, a heading ends
    those of its own and deeper levels. start_char counts the texts before it, each but the first with one blank more.
    A page without headings gives no section.
    """
    body = H.without_dropped(F.col(page))
    rx = r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>"
    heads = F.regexp_extract_all(body, F.lit(r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1>"), F.lit(1))
    names = F.regexp_extract_all(body, F.lit(r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1>"), F.lit(2))
    cut = pages.select(key, F.split(body, rx, -1).alias("pieces"), heads.alias("levels"), names.alias("names")).where(F.size("levels") > 0)
    flat = cut.select(key, "levels", "names", F.posexplode("pieces").alias("pos", "piece")).select(
        key, "pos", F.get("levels", F.col("pos") - 1).cast("int").alias("level"), H.plain(F.coalesce(F.get("names", F.col("pos") - 1), F.lit(""))).alias("heading"), H.plain(F.col("piece")).alias("text")
    )
    seen = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    path = []
    for k in range(1, 7):
        last = F.max(F.when((F.col("level") == k) & (F.col("heading") != ""), F.struct("pos", "heading"))).over(seen)
        ended = F.max(F.when(F.col("level") <= k, F.col("pos"))).over(seen)
        path.append(F.when(last["pos"] == ended, last["heading"]))
    width = F.when(F.col("pos") == 0, F.char_length("text")).when(F.col("text") != "", F.char_length("text") + 1).otherwise(0)
    placed = flat.withColumn("heading_path", F.filter(F.array(*path), lambda x: x.isNotNull())).withColumn("start_char", (F.sum(width).over(seen) - width).cast("int"))
    kept = placed.where("text != ''")
    no = F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1
    return kept.select(key, no.alias("section_no"), "heading_path", "text", "start_char")


def links(pages: DataFrame, page: str = "html") -> DataFrame:
    """url, target: canonical targets of the anchors of each page, each once."""
    flat = pages.select("url", F.explode(H.hrefs(F.col(page))).alias("ref"))
    return flat.select("url", U.canonical(U.joined(F.col("url"), F.trim("ref"))).alias("target")).distinct()


def first_of_each_text(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """Documents without later copies: of those with one text (white space aside) the first by ``order`` stays."""
    keep = docs.select(T.fingerprint(F.col("text")).alias("fp"), order).groupBy("fp").agg(F.min(order).alias(order))
    return docs.join(keep.where("fp is not null").select(order), order, "left_semi")


def frontier(found: DataFrame, visited: DataFrame, limit: int) -> DataFrame:
    """url of the same host as src, a page by its ending, not visited: the first ``limit`` of each host by order found (ties by url)."""
    ok = found.where((U.site_of(F.col("url")) == U.site_of(F.col("src"))) & ~U.skipped(F.col("url")))
    new = ok.groupBy("url").agg(F.min("seen_at").alias("seen_at")).join(visited.select("url"), "url", "left_anti")
    rank = F.row_number().over(Window.partitionBy(U.site_of(F.col("url"))).orderBy("seen_at", "url"))
    return new.withColumn("rank", rank).where(F.col("rank") <= limit)


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node, depth: breadth-first over edges (src, dst) from seeds (node), until a level is empty; each level is written once, cycles end by themselves."""
    level = materialize(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "bfs0")
    seen = level
    for depth in count(1):
        step = edges.join(level.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        level = materialize(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), f"bfs{depth}")
        if not level.head(1):
            return seen
        seen = seen.unionByName(level)
        if depth % 20 == 0:  # a plan of few parts
            seen = materialize(seen, "seen")


def redirect_chains(hops: DataFrame, max_redirects: int = 5) -> DataFrame:
    """url, final, n_hops, outcome (ok or too_many_redirects) over hops (url, location); a null location is an end.

    A loop is one of too many redirects; so is an end not reached within ``max_redirects``.
    """
    to = hops.select(F.col("url").alias("at"), "location")
    state = hops.select("url", F.col("url").alias("at"), F.lit(0).alias("n_hops"))
    for _ in range(max_redirects):
        state = state.join(to, "at", "left").select("url", F.coalesce("location", "at").alias("at"), (F.col("n_hops") + F.col("location").isNotNull().cast("int")).alias("n_hops"))
    last = state.join(to, "at", "left")
    bad = F.col("location").isNotNull()
    return last.select("url", F.when(~bad, F.col("at")).alias("final"), "n_hops", F.when(bad, "too_many_redirects").otherwise("ok").alias("outcome"))


def robots_allowed(urls: DataFrame, rules: DataFrame, default: bool = True) -> DataFrame:
    """url, allowed: the first rule (by rule_no) of the url's host whose path is a prefix decides; none: ``default``.

    rules: host (null: every host), rule_no, path, allow. An empty path of a disallow rule allows all. The rules of a
    host are few; they are joined by host.
    """
    path = F.when(U.url_part(F.col("url"), 3) == "", "/").otherwise(U.url_part(F.col("url"), 3))
    u = urls.select("url").distinct().withColumn("host", U.site_of(F.col("url"))).withColumn("path", path)
    r = rules.select(F.col("host").alias("rhost"), "rule_no", F.col("path").alias("rpath"), (F.col("allow") | (F.col("path") == "")).alias("allow"))
    own = u.join(r.where("rhost is not null"), (F.col("host") == F.col("rhost")) & F.col("path").startswith(F.col("rpath")), "left").groupBy("url").agg(F.min(F.when(F.col("rule_no").isNotNull(), F.struct("rule_no", "allow"))).alias("a"))
    every = [x for x in r.where("rhost is null").orderBy("rule_no").limit(1001).collect()]  # the general group of one file
    if len(every) > 1000:
        raise ValueError("more than 1,000 general rules")
    general = F.lit(default)
    for x in reversed(every):
        general = F.when(F.col("path").startswith(x.rpath), F.lit(x.allow)).otherwise(general)
    return u.join(own, "url", "left").select("url", F.coalesce("a.allow", general).alias("allowed"))


def sitemaps(robots: DataFrame) -> DataFrame:
    """host, sitemap: the sitemaps that robots files (host, body) declare."""
    found = F.regexp_extract_all("body", F.lit(r"(?im)^[ \t]*sitemap[ \t]*:[ \t]*(\S+)"), F.lit(1))
    return robots.select("host", F.explode(found).alias("sitemap")).distinct()
