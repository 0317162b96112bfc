"""Questions from templates over passages, with the spans they were made from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.chunking import sentence

#: Cues (substrings of the lower-cased passage) and questions, in the order they are tried.
TEMPLATES = (
    ("cost costs price prices priced fee fees pkr usd rate rates charge charges billed quote".split(), "how much does {} cost"),
    ("minutes hours days weeks months takes within turnaround lead response".split(), "how long does {} take"),
    ("covers covering includes included including offers provides available serves supports".split(), "what does {} include"),
    ("uses using process step steps works performed carried installed fitted measured".split(), "how is {} done"),
)
FALLBACK = "what is {}"
MIN_WORDS, MAX_OVERLAP, PER_UNIT = 15, 0.8, 2


def units(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Chunks of the generation chunker (180 words, no overlap) with a column long_enough."""
    return sentence(rows, most=180, overlap=0, least=25).withColumn("long_enough", F.size(F.filter(F.split("text", r"(?U)\s+"), lambda x: x != "")) >= min_words)


def idf(passages: DataFrame) -> DataFrame:
    """term, idf = ln((n + 1) / (df + 0.5)) over passages (text)."""
    n = passages.agg(F.count(F.lit(1)).alias("n"))
    df = passages.select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", F.log((F.col("n") + 1) / (F.col("df") + 0.5)).alias("idf"))  # one row


def focus(passages: DataFrame, terms: int = 3) -> DataFrame:
    """chunk_id, focus: the last heading in lower case, or the most identifying terms of the first sentence in reading order.

    Terms rank by count times idf, ties alphabetically. A passage without heading and terms has no row.
    """
    headed = passages.where(F.size("heading_path") > 0).select("chunk_id", F.lower(F.element_at("heading_path", -1)).alias("focus"))
    bare = passages.where(F.coalesce(F.size("heading_path"), F.lit(0)) <= 0).withColumn("head", F.coalesce(F.get(T.sentences(F.col("text")), 0), F.col("text")))
    t = bare.select("chunk_id", F.posexplode(T.tokens(F.col("head"))).alias("pos", "term")).groupBy("chunk_id", "term").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n"))
    scored = t.join(idf(passages), "term").withColumn("rank", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc(F.round(F.col("n") * F.col("idf"), 12)), "term")))
    best = scored.where(F.col("rank") <= terms).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("t"))
    return headed.unionByName(best.select("chunk_id", F.array_join(F.col("t.term"), " ").alias("focus")))


def questions_of(text, about, per_unit: int = PER_UNIT):
    """Array of questions of a passage: at most ``per_unit`` of the templates whose cues it has (cost only beside a digit), else the fallback."""
    low = F.lower(text)
    found = []
    for i, (cues, template) in enumerate(TEMPLATES):
        hit = low.rlike("|".join(cues))
        if i == 0:
            hit = hit & text.rlike("[0-9]")
        a, b = template.split("{}")
        found.append(F.when(hit, F.concat(F.lit(a), about, F.lit(b))))
    got = F.slice(F.filter(F.array(*found), lambda x: x.isNotNull()), 1, per_unit)
    return F.when(F.size(got) > 0, got).otherwise(F.array(F.concat(F.lit(FALLBACK[:-2]), about)))


def generated(passages: DataFrame, per_unit: int = PER_UNIT, max_overlap: float = MAX_OVERLAP) -> DataFrame:
    """query_id, text, doc_id, start_char, end_char, chunk_id, overlap, kept.

    Of one question made from several passages the first (by doc_id, ordinal) stays; kept is false where the question
    shares more than ``max_overlap`` of its terms with the passage.
    """
    asked = passages.join(focus(passages), "chunk_id").where("focus != ''")
    flat = asked.select("chunk_id", "doc_id", "ordinal", "start_char", "end_char", F.col("text").alias("passage"), F.posexplode(questions_of(F.col("text"), F.col("focus"), per_unit)).alias("no", "question"))
    first = flat.groupBy("question").agg(F.min(F.struct("doc_id", "ordinal", "no", "chunk_id", "start_char", "end_char", "passage")).alias("f")).select("question", "f.*")
    over = T.lexical_overlap(F.col("question"), F.col("passage"))
    return first.select(T.query_id(F.col("chunk_id"), F.col("question")).alias("query_id"), F.col("question").alias("text"), "doc_id", "start_char", "end_char", "chunk_id", F.round(over, 4).alias("overlap"), (over <= max_overlap).alias("kept"))


def report(all_units: DataFrame, made: DataFrame) -> DataFrame:
    """n_units, n_units_too_short, n_generated, n_dropped_overlap, mean_lexical_overlap (dropped ones included)."""
    u = all_units.agg(F.count_if("long_enough").alias("n_units"), F.count_if(~F.col("long_enough")).alias("n_units_too_short"))
    q = made.agg(F.count_if("kept").alias("n_generated"), F.count_if(~F.col("kept")).alias("n_dropped_overlap"), F.round(F.coalesce(F.avg("overlap"), F.lit(0.0)), 6).alias("mean_lexical_overlap"))
    return u.crossJoin(F.broadcast(q))  # one row each


PROMPT = "Write {n} question(s) that the passage answers, each clear without it. Return a JSON array of strings.\nPage: {title}\nPassage:\n{passage}"


def prompts(passages: DataFrame, per_unit: int = PER_UNIT) -> DataFrame:
    """chunk_id, prompt for a model that is asked outside (see answers_of)."""
    a, b = PROMPT.replace("{n}", str(per_unit)).split("{title}")
    return passages.select("chunk_id", F.concat(F.lit(a), F.coalesce("title", F.lit("")), F.lit(b.replace("{passage}", "")), F.col("text")).alias("prompt"))


def answers_of(raw):
    """Array of strings in a model's answer: code fences and talk before the first bracket are dropped; null if it holds none."""
    body = F.regexp_replace(raw, r"(?s)^\s*```[a-z]*\s*|\s*```\s*$", "")
    return F.from_json(F.regexp_extract(body, r"(?s)(\[.*\])", 1), "array<string>")
