"""Text expressions. Null in, null out; an empty text has no words, tokens or sentences."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Words that lexical retrieval leaves out.
STOPWORDS = "a an and are as at be by for from has have in is it its of on or that the to was were with".split()
#: Abbreviations that end no sentence.
ABBREVIATIONS = "mr mrs ms dr prof sr jr st vs etc e.g i.e inc ltd co corp dept est fig no vol".split()
_BOUNDARY = re.compile(r"(?<=[.!?])[\"')\]]*\s+")


def stripped(text: Column) -> Column:
    """Without white space (of all kinds) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def tokens(text: Column, stop: bool = True) -> Column:
    """Lower-case runs of ASCII letters and digits, without stop words unless asked for."""
    t = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(t, lambda x: ~x.isin(STOPWORDS)) if stop else t


def normalised(text: Column) -> Column:
    """Lower case, white space runs as one blank, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def fingerprint(text: Column) -> Column:
    """sha1 of the text with white space collapsed; case counts."""
    return F.sha1(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def chunk_id(doc_id: Column, strategy: Column, ordinal: Column, text: Column) -> Column:
    return F.concat_ws(":", doc_id.cast("string"), strategy, F.format_string("%04d", ordinal), F.substring(F.sha1(text), 1, 10))


def query_id(unit_id: Column, question: Column, prefix: str = "h_") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", unit_id, question)), 1, 12))


def lexical_overlap(query: Column, passage: Column) -> Column:
    """Share of the query's distinct content terms that the passage has; 0 for a query without any."""
    q = F.array_distinct(tokens(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, tokens(passage))), F.size(q)), F.lit(0.0))


def edge_coverage(gold: Column, text: Column) -> Column:
    """Longest prefix or suffix of gold's words found in text, as a share of its words (both normalised); 0 without words."""
    hay, w = normalised(text), F.split(normalised(gold), " ")
    n = F.size(w)
    lengths = F.sequence(F.lit(1), n)
    pre = F.filter(lengths, lambda i: F.contains(hay, F.array_join(F.slice(w, F.lit(1), i), " ")))
    post = F.filter(lengths, lambda i: F.contains(hay, F.array_join(F.slice(w, n - i + 1, i), " ")))
    return F.when(normalised(gold) == "", 0.0).otherwise(F.greatest(F.coalesce(F.array_max(pre), F.lit(0)), F.coalesce(F.array_max(post), F.lit(0))) / n)


def ngrams(text: Column, n: int = 3) -> Column:
    """Tokens (stop words kept) and runs of 2 to ``n`` of them joined by blanks."""
    t = tokens(text, stop=False)

    def run(k):
        return lambda i: F.array_join(F.slice(t, i, F.lit(k)), " ")

    out = t
    for k in range(2, n + 1):
        runs = F.when(F.size(t) >= k, F.transform(F.sequence(F.lit(1), F.size(t) - k + 1), run(k)))
        out = F.concat(out, F.coalesce(runs, F.array().cast("array<string>")))
    return out


def slug(text: Column, default: str = "org", longest: int = 48) -> Column:
    s = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    s = F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, longest)
    return F.when(F.char_length(s) >= 3, s).otherwise(F.lit(default))


#: The end of a piece after which a sentence goes on: an abbreviation or a single letter and a full stop, closing marks aside.
_GOES_ON = re.compile(r"(?:^|(?<=\s))(?:" + "|".join(re.escape(a) for a in ABBREVIATIONS) + r"|[^\W\d_])\.[\"')\]]*$", re.IGNORECASE)


def split_sentences(text: str | None) -> list[str]:
    """Sentences of a text; a piece that ends in an abbreviation or a single letter goes on with the next."""
    pieces = [p for p in map(str.strip, _BOUNDARY.split((text or "").strip())) if p]
    ends = [i for i, p in enumerate(pieces) if not _GOES_ON.search(p)]
    if pieces and (not ends or ends[-1] < len(pieces) - 1):
        ends.append(len(pieces) - 1)
    return [" ".join(pieces[a + 1 : b + 1]) for a, b in zip([-1, *ends], ends)]


@F.pandas_udf(ArrayType(StringType()))
def sentences(text: pd.Series) -> pd.Series:
    """Arrow batches: a fold over pieces inside the JVM took several times as long."""
    return text.map(split_sentences)


#: Keys whose values never go to a log.
SECRET_KEYS = ("password", "secret", "token", "authorization", "api_key", "apikey", "cookie", "set-cookie")


def redacted_map(m: Column, keys: tuple[str, ...] = SECRET_KEYS) -> Column:
    """Values of the named keys of a map (any case) replaced."""
    return F.transform_values(m, lambda k, v: F.when(F.lower(k).isin(*keys), F.lit("[redacted]")).otherwise(v))
