"""The queries of problems 1 to 9 and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import blocks, mixing, near_duplicates, neighbours, packing, personal, repeated_lines, residue, splitting

#: Parameters of near-duplicate search as TESTDATA.md states them for documents.
P3 = {"run": 3, "similarity": 0.7, "min_words": 60}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark, d):
    """Ids of chunks that the splitter had to cut."""
    return splitting.split_oversized(_table(spark, d, "chunks")).where("oversized").select("chunk_id").distinct()


def p1_pieces(spark, d):
    """All chunks within the limit: small ones as they are, large ones as pieces."""
    return splitting.split_oversized(_table(spark, d, "chunks"))


def p2_found(spark, d):
    return neighbours.similar_pairs(_table(spark, d, "vectors"), 0.9)


def p2_neighbours(spark, d):
    """Each valid vector's five most similar chunks."""
    return neighbours.neighbours(_table(spark, d, "vectors")).withColumn("cosine", F.round("cosine", 6))


def p3_found(spark, d):
    return near_duplicates.similar_pairs(_table(spark, d, "documents"), **P3)


def p3_groups(spark, d):
    """Each document with its group of near-duplicates."""
    return near_duplicates.document_groups(_table(spark, d, "documents"), **P3)


def p4_found(spark, d):
    return residue.residue(_table(spark, d, "documents")).where("evidence is not null").select("doc_id")


def p4_flags(spark, d):
    """Every document with the evidence against it, null for the clean set."""
    return residue.residue(_table(spark, d, "documents"))


def p5_found(spark, d):
    return blocks.boilerplate_lines(_table(spark, d, "documents"))


def p5_bodies(spark, d):
    """Each page with its main body only."""
    return blocks.main_bodies(_table(spark, d, "documents"))


def p6_found(spark, d):
    return repeated_lines.repeated_lines(_table(spark, d, "documents"))[1].select("doc_id", "line_no")


def p6_lines(spark, d):
    """Lines a site repeats, with the number of documents and occurrences."""
    return repeated_lines.repeated_lines(_table(spark, d, "documents"))[0]


def p6_clean(spark, d):
    """Each document without its site's repeated lines."""
    return repeated_lines.without_repeated_lines(_table(spark, d, "documents"))


def p7_containers(spark, d):
    """Every text in containers of 2,048 tokens."""
    return packing.containers(_table(spark, d, "documents"))


def p7_fill(spark, d):
    """How full the containers are."""
    each = p7_containers(spark, d).groupBy("container_id").agg(F.sum("n_tokens").alias("t"))
    return each.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("n_tokens"), F.ceil(F.sum("t") / packing.CAPACITY).alias("least_containers"), F.round(F.avg("t") / packing.CAPACITY, 6).alias("mean_fill"))


def p8_mix(spark, d):
    """The documents of each mix with their repeats."""
    return mixing.mixtures(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))[0]


def p8_shares(spark, d):
    """The shares each mix reaches."""
    return mixing.mixtures(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))[1]


def p9_found(spark, d):
    return personal.personal_spans(_table(spark, d, "documents"), _table(spark, d, "person_names"))


def p9_redacted(spark, d):
    """Each text with personal data replaced by placeholders."""
    return personal.redacted(_table(spark, d, "documents"), _table(spark, d, "person_names"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit() and callable(f)}


#: White space as Unicode has it, for a character class of the SQL engine.
_SPACES = r"\t\n\v\f\r \x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SITE = r"regexp_replace(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', '')"
_LINES = f"""
lines AS (
  SELECT doc_id, {_SITE} AS site, i - 1 AS line_no, regexp_replace(lower(line), '[^\\p{{L}}]+', '', 'g') AS line_key
  FROM (SELECT doc_id, url, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
        FROM documents WHERE text IS NOT NULL)
  WHERE {_SITE} <> ''),
hot AS (
  SELECT site, line_key, COUNT(DISTINCT doc_id) AS n_docs, COUNT(*) AS n_occurrences
  FROM lines WHERE line_key <> '' GROUP BY 1, 2 HAVING COUNT(DISTINCT doc_id) >= 5)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 2000 OR len(regexp_extract_all(text, '[^{_SPACES}]+')) > 256",
        "p2_found": """
WITH ranked AS (
  SELECT collection_name, chunk_id, vec, ROW_NUMBER() OVER (PARTITION BY chunk_id ORDER BY upserted_at DESC) AS w FROM vectors),
valid AS (
  SELECT collection_name, chunk_id, list_transform(vec, lambda x: x::DOUBLE)::DOUBLE[64] AS v FROM ranked
  WHERE w = 1 AND vec IS NOT NULL AND len(vec) = 64
    AND NOT list_bool_or(list_transform(vec, lambda x: isnan(x))) AND list_bool_or(list_transform(vec, lambda x: x <> 0))),
near AS (
  SELECT a.chunk_id AS x, b.chunk_id AS y, array_cosine_similarity(a.v, b.v) AS c,
    ROW_NUMBER() OVER (PARTITION BY a.chunk_id ORDER BY round(array_cosine_similarity(a.v, b.v), 12) DESC, b.chunk_id) AS r
  FROM valid a JOIN valid b ON a.collection_name = b.collection_name AND a.chunk_id <> b.chunk_id
  QUALIFY r <= 5)
SELECT DISTINCT least(x, y) AS chunk_id_a, greatest(x, y) AS chunk_id_b FROM near WHERE c >= 0.9 - 1e-9""",
        "p3_found": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
runs AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 60)),
sizes AS (SELECT doc_id, COUNT(*) AS n FROM runs GROUP BY 1),
common AS (
  SELECT a.doc_id AS p, b.doc_id AS q, COUNT(*) AS c FROM runs a JOIN runs b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT p AS doc_id_a, q AS doc_id_b FROM common JOIN sizes s ON s.doc_id = p JOIN sizes t ON t.doc_id = q
WHERE c >= 0.7 * (s.n + t.n - c)""",
        "p6_found": f"WITH {_LINES} SELECT DISTINCT doc_id, CAST(line_no AS INTEGER) AS line_no FROM lines JOIN hot USING (site, line_key)",
        "p6_lines": f"WITH {_LINES} SELECT site, line_key, n_docs, n_occurrences FROM hot",
    }
