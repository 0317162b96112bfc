"""HTML expressions: a page's title, text, headed sections and links by patterns, inside the JVM where possible."""

from __future__ import annotations

import html as _html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Elements whose content is never text of the page.
DROPPED = ("script", "style", "nav", "footer", "header", "aside", "noscript", "form")
_HEADING = r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>"


def without_dropped(page: Column) -> Column:
    return F.regexp_replace(page, r"(?is)<(" + "|".join(DROPPED) + r")\b.*?</\1>", " ")


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else _html.unescape(s) if "&" in s else s)


def tidy(text: Column) -> Column:
    """Runs of blanks as one, at most one blank line in a row, no white space at the ends."""
    s = F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f\x0B]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def plain(fragment: Column) -> Column:
    """A fragment without tags, entities resolved, tidied."""
    return tidy(unescaped(F.regexp_replace(fragment, r"(?s)<[^>]+>", " ")))


def title(page: Column) -> Column:
    """The title element if there is one (an empty one counts), else the first heading, else ""."""
    t = F.regexp_extract_all(page, F.lit(r"(?is)<title[^>]*>(.*?)</title>"), F.lit(1))
    h = F.regexp_extract_all(page, F.lit(r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>"), F.lit(1))
    return plain(F.when(page.isNotNull(), F.coalesce(F.get(t, 0), F.get(h, 0), F.lit(""))))


def text(page: Column) -> Column:
    return plain(without_dropped(page))


def heading_levels(page: Column) -> Column:
    return F.transform(F.regexp_extract_all(page, F.lit(r"(?i)<h([1-6])\b"), F.lit(1)), lambda x: x.cast("int"))


def hrefs(page: Column) -> Column:
    """References of anchors that lead to pages."""
    refs = F.regexp_extract_all(page, F.lit(r"(?i)<a\b[^>]*href=[\"']([^\"']+)[\"']"), F.lit(1))
    return F.filter(refs, lambda r: ~F.lower(F.trim(r)).rlike("^(?:mailto:|tel:|javascript:|#)"))
