"""Ten content signals of a page in 0..1, page scores and advice."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corvane.functions import html as H
from corvane.functions import text as T

#: Names, in the order of the report.
NAMES = ("statistic_density", "citation_density", "quotation_density", "authority_markers", "schema_coverage", "heading_structure", "self_containedness", "extractability", "answer_directness", "freshness")
#: Patterns, markers and openers.
STATISTIC = r"(?iU)\b\d[\d,]*(?:\.\d+)?\s*(?:%|percent|million|billion|thousand|k|x|hours?|days?|years?)\b"
NUMBER = r"(?U)\b\d[\d,]*(?:\.\d+)?%?\b"
QUOTE = r'["“][^"“”]{20,}["”]'
YEAR = r"(?U)\b(?:19|20)\d{2}\b"
AUTHORITY = ("according to", "research shows", "study found", "data from", "reported by", "survey of", "published in", "certified", "accredited", "peer-reviewed", "as of", "source:")
DIRECT = (" is ", " are ", " means ", " refers to ", " is defined as ", " works by ", " you can ", " to do this", " the answer is ")
OPENERS = "it this that these those they them he she we our its their his her there here such also however therefore moreover furthermore additionally consequently thus instead otherwise meanwhile besides".split()


def saturated(value: Column, ceiling: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value / ceiling))


def occurrences(text: Column, marker: str) -> Column:
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(marker), F.lit("")))) / len(marker)).cast("int")


def heading_structure(page: Column) -> Column:
    """0.4 for one first-level heading (0.1 for several), 0.3 for a second-level one, 0.3 less skipped levels; 0 without headings."""
    lv = H.heading_levels(page)
    ones = F.size(F.filter(lv, lambda x: x == 1))
    n = F.size(lv)
    skips = F.size(F.filter(F.zip_with(F.slice(lv, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(lv, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda b, a: b - a), lambda d: d > 1))
    s = F.when(ones == 1, 0.4).when(ones > 1, 0.1).otherwise(0.0) + F.when(F.exists(lv, lambda x: x == 2), 0.3).otherwise(0.0)
    s = s + 0.3 * F.greatest(F.lit(0.0), 1 - skips / F.greatest(n - 1, F.lit(1)))
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), s))


def extractability(text: Column, page: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(page, r"(?is)<script.*?</script>|<style.*?</style>", " "), r"(?s)<[^>]+>", " ")
    total = F.char_length(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")))
    return F.when(total == 0, 0.0).otherwise(F.least(F.lit(1.0), F.char_length(text) / total))


_LD = re.compile(r"""<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>""", re.I | re.S)


def schema_types(page: str | None) -> set[str]:
    """Distinct @type values, at any depth, of a page's valid JSON-LD blocks."""
    found: set[str] = set()
    for block in _LD.findall(page or ""):
        try:
            todo = [json.loads(block.strip())]
        except ValueError:
            continue
        while todo:
            x = todo.pop()
            if isinstance(x, dict):
                t = x.get("@type")
                found.update([t] if isinstance(t, str) else map(str, t) if isinstance(t, list) else [])
                todo += x.values()
            elif isinstance(x, list):
                todo += x
    return found


@F.pandas_udf(IntegerType())
def schema_count(page: pd.Series) -> pd.Series:
    return page.map(lambda x: len(schema_types(x)) if x else 0)


@F.pandas_udf(StructType([StructField("n", IntegerType()), StructField("direct", IntegerType())]))
def sentence_counts(text: pd.Series) -> pd.DataFrame:
    """Sentences of a text and those with a direct statement; only the two counts leave Python."""
    out = []
    for x in text:
        said = T.split_sentences(x)
        out.append((len(said), sum(any(m in f" {s.lower()} " for m in DIRECT) for s in said)))
    return pd.DataFrame(out, columns=["n", "direct"], dtype="int32")


def self_contained(chunks: DataFrame) -> DataFrame:
    """doc_id, self_containedness: share of a document's chunks whose first word is no reference to what came before; blank ones count as not."""
    word = F.regexp_extract(F.col("text"), r"(?U)(\S+)", 1)
    opener = F.get(T.tokens(word, stop=False), 0)
    good = (word != "") & (opener.isNull() | ~opener.isin(OPENERS))
    return chunks.groupBy("doc_id").agg(F.round(F.avg(F.coalesce(good, F.lit(False)).cast("double")), 9).alias("self_containedness"))


def measured(docs: DataFrame, chunks: DataFrame | None = None, page: str | None = None) -> DataFrame:
    """doc_id, url, the ten signals, n_words, n_sentences, n_numbers, n_statistics, n_quotes, n_citations, n_authority, warnings.

    ``page`` names a column with the HTML (signals of markup are 0 without it), ``chunks`` (doc_id, text) give
    self_containedness. Optional columns published_at and modified_at make freshness 1. A null text counts as empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    n = F.size(T.tokens(text, stop=False))
    per = 100.0 / F.greatest(n, F.lit(1))
    html = F.coalesce(F.col(page), F.lit("")) if page else None
    said = occurrences(low, "source:") + occurrences(low, "according to")
    links = F.size(F.filter(F.regexp_extract_all(html, F.lit(r"""(?i)href=["']([^"']+)["']"""), F.lit(1)), lambda x: x.rlike("^https?://"))) if page else F.col("outbound_links") if "outbound_links" in docs.columns else F.lit(0)
    dated = [F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in ("published_at", "modified_at") if c in docs.columns]
    dated_any = dated[0] if len(dated) == 1 else dated[0] | dated[1] if dated else F.lit(False)
    base = docs.withColumn("_s", sentence_counts(text)).withColumn("n_words", n).withColumn("n_statistics", F.regexp_count(text, F.lit(STATISTIC))).withColumn("n_quotes", F.regexp_count(text, F.lit(QUOTE)))
    base = base.withColumn("n_authority", sum((occurrences(low, m) for m in AUTHORITY), F.lit(0))).withColumn("n_citations", (links + said).cast("int"))
    out = base.select(
        "doc_id", "url",
        saturated(F.col("n_statistics") * per, 4.0).alias("statistic_density"), saturated(F.col("n_citations") * per, 2.0).alias("citation_density"), saturated(F.col("n_quotes") * per, 1.5).alias("quotation_density"),
        saturated(F.col("n_authority") * per, 2.0).alias("authority_markers"), (saturated(schema_count(F.when(F.contains(F.lower(html), F.lit("ld+json")), html)), 4.0) if page else F.lit(0.0)).alias("schema_coverage"),
        (heading_structure(html) if page else F.lit(0.0)).alias("heading_structure"), (extractability(text, html) if page else F.lit(0.0)).alias("extractability"),
        F.coalesce(F.try_divide(F.col("_s.direct"), F.col("_s.n")), F.lit(0.0)).alias("answer_directness"), F.when(dated_any, 1.0).when(text.rlike(YEAR), 0.5).otherwise(0.0).alias("freshness"),
        "n_words", F.col("_s.n").alias("n_sentences"), F.regexp_count(text, F.lit(NUMBER)).alias("n_numbers"), "n_statistics", "n_quotes", "n_citations", "n_authority",
    )
    if chunks is not None:
        out = out.join(self_contained(chunks), "doc_id", "left")
    else:
        out = out.withColumn("self_containedness", F.lit(None).cast("double"))
    notes = F.array(F.lit("no page: signals of markup are 0") if not page else F.lit(None).cast("string"), F.when(F.col("self_containedness").isNull(), "no chunks: self_containedness is 0"))
    out = out.withColumn("warnings", F.filter(notes, lambda x: x.isNotNull())).withColumn("self_containedness", F.coalesce("self_containedness", F.lit(0.0)))
    rounded = [F.round(c, 9).alias(c) for c in NAMES]
    return out.select("doc_id", "url", *rounded, *[c for c in out.columns if c not in (*NAMES, "doc_id", "url")])


def weights(given: dict[str, float] | None = None) -> dict[str, float]:
    """Weights of sum 1; equal ones where none are given or their sum is not positive."""
    total = sum((given or {}).values())
    return {n: 1 / len(NAMES) for n in NAMES} if total <= 0 else {n: (given or {}).get(n, 0.0) / total for n in NAMES}


def scored(signals: DataFrame, given: dict[str, float] | None = None, below: float = 0.5) -> DataFrame:
    """The signals with score (0..100, 2 digits), contributions (map, 3 digits) and advice: names of signals under ``below``, most to gain first."""
    w = weights(given)
    total = sum((F.lit(100 * w[n]) * F.coalesce(F.col(n), F.lit(0.0)) for n in NAMES), F.lit(0.0))
    gaps = F.array(*[F.when(F.coalesce(F.col(n), F.lit(0.0)) < below, F.struct(F.round(F.lit(w[n]) * (1 - F.coalesce(F.col(n), F.lit(0.0))), 12).alias("gain"), F.lit(n).alias("name"))) for n in NAMES])
    order = F.reverse(F.array_sort(F.filter(gaps, lambda x: x.isNotNull())))
    parts = F.create_map(*[x for n in NAMES for x in (F.lit(n), F.round(F.lit(100 * w[n]) * F.coalesce(F.col(n), F.lit(0.0)), 3))])
    return signals.withColumn("score", F.round(total, 2)).withColumn("contributions", parts).withColumn("advice", F.transform(order, lambda x: x["name"]))


def overall(pages: DataFrame) -> DataFrame:
    """n_pages, overall: mean score of the pages (2 digits), 0 without any."""
    return pages.agg(F.count("score").alias("n_pages"), F.coalesce(F.round(F.avg("score"), 2), F.lit(0.0)).alias("overall"))
