"""BM25: only words of query terms are kept, and an item is scored where it lies.

The asked terms go to every task, so the scores of a pair need no shuffle: words are counted once, and blocks of items are
multiplied with all queries. A search keeps the best of each query within a task before anything is exchanged. Queries of
more than ``ASKED_ROWS`` terms are joined with an inverted index instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.runtime import materialize, small_or_none

K1, B = 1.5, 0.75

#: Rows of (query, term), of some 12 bytes, up to which the asked terms go to every task; beyond it they are joined.
ASKED_ROWS = 2_000_000

#: Scores that a task holds at a time.
CELLS = 2_000_000


def term_statistics(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by..., term, df, idf over items (item_id, text): idf = ln(1 + (n - df + 0.5) / (df + 0.5))."""
    by = by or []
    n = items.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    df = items.select(*by, F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"))
    joined = df.join(F.broadcast(n), by) if by else df.crossJoin(F.broadcast(n))  # one row a group
    return joined.select(*by, "term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def hits(queries: DataFrame, items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by..., query_id, item_id, qtf, tf, len, idf, mean: a row for every term that a query shares with an item.

    Words are cut to the asked terms first and counted by one aggregation, so neither a text nor its words are copied per term.
    """
    by = by or []
    terms = queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    asked = terms.select("term").distinct()
    asked = F.broadcast(asked) if small_or_none(asked) else asked
    tok = items.select(*by, "item_id", F.coalesce(T.tokens(F.col("text")), F.array().cast("array<string>")).alias("t"))
    total = tok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("mean"))
    words = tok.select(*by, "item_id", F.size("t").alias("len"), F.explode("t").alias("term")).join(asked, "term", "left_semi")
    posting = words.groupBy(*by, "item_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = posting.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"))
    df = df.join(F.broadcast(total), by) if by else df.crossJoin(F.broadcast(total))  # one row a group
    idf = df.select(*by, "term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "mean")
    return terms.join(posting, "term").join(idf, [*by, "term"])


class _Asked:
    """The asked terms, numbered, with the queries of each: qno[start[t] : start[t + 1]] and as many qtf."""

    def __init__(self, rows: pa.Table):
        ids, terms = (rows[c].combine_chunks().dictionary_encode() for c in ("query_id", "term"))
        self.query_ids, self.terms = ids.dictionary, terms.dictionary
        t = terms.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(t, kind="stable")
        self.qno = ids.indices.to_numpy(zero_copy_only=False)[order]
        self.qtf = rows["qtf"].to_numpy()[order].astype(np.float64)
        self.start = np.searchsorted(t[order], np.arange(len(self.terms) + 1))


def _counted(items: DataFrame, asked: _Asked, by: list[str]) -> DataFrame:
    """by..., item_id, len, t, tf: the words of each item, those of asked terms by number and count."""
    items = items.dropna(subset=by) if by else items  # a join by groups has no null group either
    tok = items.select(*by, "item_id", F.coalesce(T.tokens(F.col("text")), F.array().cast("array<string>")).alias("words"))
    schema = tok.drop("words").withColumns({"len": F.lit(0), "t": F.array().cast("array<int>"), "tf": F.array().cast("array<int>")}).schema
    terms = asked.terms

    def count(batches):
        for b in batches:
            words, n = b.column("words"), b.num_rows
            size = pc.list_value_length(words).to_numpy(zero_copy_only=False)
            t = pc.fill_null(pc.index_in(words.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
            key = np.repeat(np.arange(n), size) * len(terms) + t
            pair, tf = np.unique(key[t >= 0], return_counts=True)
            at = pa.array(np.searchsorted(pair, np.arange(n + 1) * len(terms)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (pair % max(1, len(terms)), tf)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in [*by, "item_id"]), pa.array(size.astype(np.int32)), *lists], names=schema.names)

    return tok.mapInArrow(count, schema)


class _Best:
    """The k best items of each row of scores seen so far, ties to the smaller item id, which are compared only where they matter."""

    def __init__(self, rows: int, k: int):
        self.k, self.bound = k, np.zeros(rows)
        self.row, self.score, self.ids = np.zeros(0, np.int32), np.zeros(0), None

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        """``scores`` of rows by items, 0 for a pair that shares no term."""
        least = np.maximum(self.bound, 5e-324)
        if scores.shape[1] > self.k:  # no item below the k-th of this block can stay
            fresh = np.flatnonzero(self.bound == 0)
            least[fresh] = np.maximum(least[fresh], np.partition(scores[fresh], -self.k, axis=1)[:, -self.k])
        row, at = np.nonzero(scores >= least[:, None])
        if not len(row):
            return
        touched = np.zeros(len(self.bound), bool)
        touched[row] = True
        old = touched[self.row]
        new = ids.take(pa.array(at))
        both = new if self.ids is None else pa.concat_arrays([self.ids.filter(pa.array(old)), new])
        r, s = np.concatenate([self.row[old], row.astype(np.int32)]), np.concatenate([self.score[old], scores[row, at]])
        place = pc.rank(both, tiebreaker="dense").to_numpy(zero_copy_only=False)
        order = np.lexsort((place, -s, r))
        r = r[order]
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        order, full = order[nth < self.k], r[nth == self.k - 1]
        self.bound[full] = s[order][np.flatnonzero(nth[nth < self.k] == self.k - 1)]
        r, s, both = r[nth < self.k], s[order], both.take(pa.array(order))
        if self.ids is not None:
            r, s, both = np.concatenate([self.row[~old], r]), np.concatenate([self.score[~old], s]), pa.concat_arrays([self.ids.filter(pa.array(~old)), both])
        self.row, self.score, self.ids = r, s, both


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e9 + 0.5) / 1e9


def _once(rows: DataFrame, by: list[str]) -> DataFrame:
    """A row an item, dealt over all shuffle partitions: a few bytes here may be much work later."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *by, "item_id").dropDuplicates([*by, "item_id"])


def _scored(queries: DataFrame, items: DataFrame, by: list[str], settings: list[tuple[float, float]], k: int | None, repeated: bool = False) -> DataFrame | None:
    """by..., query_id, item_id, setting (number), score of all pairs that share a term, or a superset of each query's k best; None for too many asked terms."""
    terms = queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    terms = materialize(terms, "asked")
    if not small_or_none(terms, ASKED_ROWS):
        return None
    asked = _Asked(terms.toArrow())
    words = _counted(items, asked, by)
    words = materialize(_once(words, by) if repeated else words, "words")  # counts are exchanged, not texts
    # a row a group and one a group and asked term
    totals = words.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("words")).collect()
    found = words.select(*by, F.explode("t").alias("t")).groupBy(*by, "t").agg(F.count(F.lit(1)).alias("df")).toArrow()
    group_of = {tuple(r[c] for c in by): g for g, r in enumerate(totals)}
    df = np.zeros((len(totals), len(asked.terms)))
    keys = zip(*(found[c].to_pylist() for c in by)) if by else [()] * len(found)
    df[np.fromiter((group_of[key] for key in keys), np.int64, len(found)), found["t"].to_numpy()] = found["df"].to_numpy()
    n = np.array([r.n for r in totals], np.float64)[:, None]
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    mean = np.array([(r.words or 0) / max(1, r.n) for r in totals])
    nq, width = len(asked.query_ids), len(settings)
    schema = words.select(*by).withColumn("query_id", F.lit(None).cast(queries.schema["query_id"].dataType)).schema
    schema = schema.add(items.schema["item_id"]).add("setting", "integer").add("score", "double")
    names, types = schema.names, [found.schema.field(c).type for c in by]

    def matrix(g, length, t, tf, offsets, a, z):
        """Scores of the items a to z of group g: settings and queries by items."""
        lo, hi = offsets[a], offsets[z]
        item, t, tf = np.repeat(np.arange(z - a), np.diff(offsets[a : z + 1])), t[lo:hi], tf[lo:hi]
        order = np.argsort(t, kind="stable")
        item, t, tf = item[order], t[order], tf[order]
        share = length[a:z][item] / mean[g] if mean[g] else np.zeros(len(item))
        out = np.zeros((width, nq, z - a))
        cuts = np.flatnonzero(np.diff(t, prepend=-1, append=-1)) if len(t) else []
        for i, (k1, b) in enumerate(settings):
            weight = idf[g, t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * share))
            for c, e in zip(cuts[:-1], cuts[1:]):
                x = t[c]
                q = slice(asked.start[x], asked.start[x + 1])
                out[i][asked.qno[q][:, None], item[c:e]] += asked.qtf[q][:, None] * weight[c:e]
        return _rounded(out.reshape(width * nq, z - a)), out.reshape(width * nq, z - a)

    def table(g, row, item_ids, score):
        keys = [pa.array([v] * len(row), t) for v, t in zip(group_keys[g], types)]
        cells = [*keys, asked.query_ids.take(pa.array(row % nq)), item_ids, pa.array((row // nq).astype(np.int32)), pa.array(score)]
        return pa.RecordBatch.from_arrays(cells, names=names)

    group_keys = list(group_of)
    step = min(1 << 16, max(16, CELLS // max(1, nq * width)))

    def score(batches):
        best = {}
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in by))) if by else [()] * b.num_rows
            gs = np.fromiter((group_of[key] for key in keys), np.int64, len(keys))
            for g in np.unique(gs) if nq else ():
                part = b.filter(pa.array(gs == g)) if by else b
                length, offsets = part.column("len").to_numpy(), part.column("t").offsets.to_numpy()
                offsets, ids = offsets - offsets[0], part.column("item_id")
                t, tf = (part.column(c).flatten().to_numpy() for c in ("t", "tf"))
                for a in range(0, part.num_rows, step):
                    z = min(part.num_rows, a + step)
                    rounded, raw = matrix(g, length, t, tf, offsets, a, z)
                    if k is not None:
                        best.setdefault(g, _Best(nq * width, k)).add(rounded, ids[a:z])
                        continue
                    row, at = np.nonzero(raw)
                    # item by item, equal scores together: long runs, which columns are stored in few bytes of
                    order = np.argsort(rounded[row, at])
                    order = order[np.argsort(at[order].astype(np.uint16), kind="stable")]
                    for i in range(0, len(row), 100_000):
                        r, c = row[order[i : i + 100_000]], at[order[i : i + 100_000]]
                        yield table(g, r, ids.take(pa.array(a + c)), rounded[r, c])
        for g, held in best.items():
            for i in range(0, len(held.row), 100_000):
                cut = slice(i, i + 100_000)
                yield table(g, held.row[cut], held.ids[cut], held.score[cut])

    return words.mapInArrow(score, schema)


def _by_joins(queries: DataFrame, items: DataFrame, by: list[str], settings: list[tuple[float, float]]) -> DataFrame:
    def part(k1, b):
        return F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))

    each = hits(queries, items, by).groupBy(*by, "query_id", "item_id").agg(*[F.round(F.sum(part(*s)), 9).alias(f"_s{i}") for i, s in enumerate(settings)])
    listed = F.array(*[F.struct(F.lit(i).alias("setting"), F.col(f"_s{i}").alias("score")) for i in range(len(settings))])
    return each.select(*by, "query_id", "item_id", F.explode(listed).alias("s")).select(*by, "query_id", "item_id", "s.setting", "s.score")


def scores(queries: DataFrame, items: DataFrame, k1: float = K1, b: float = B, by: list[str] | None = None, settings: dict[str, tuple[float, float]] | None = None, k: int | None = None, repeated: bool = False) -> DataFrame:
    """by..., query_id, item_id, score: sum over query terms, repeated ones counted, of idf tf (k1 + 1) / (tf + k1 (1 - b + b len / mean)).

    Items without a query term have no row; a null text counts as empty in the number of items and the mean length. Item
    ids are distinct within a group, unless ``repeated`` says that an item may be listed more often; it counts once then.
    ``settings`` (name to k1 and b) score all of them in one pass, with a column condition.
    With ``k`` pairs that are not among the k best of their query and condition may be left out.
    """
    by = by or []
    each = list((settings or {"": (k1, b)}).values())
    found = _scored(queries, items, by, each, k, repeated)
    if found is None:
        found = _by_joins(queries, items.dropDuplicates([*by, "item_id"]) if repeated else items, by, each)
    if settings is None:
        return found.drop("setting")
    names = F.element_at(F.array(*[F.lit(n) for n in settings]), F.col("setting") + 1)
    return found.select(*by, "query_id", "item_id", names.alias("condition"), "score")


def ranked(scored: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The k best items of each query with their rank (from 1); equal scores rank by the smaller item."""
    w = Window.partitionBy(*(by or []), "query_id").orderBy(F.desc("score"), "item_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(queries: DataFrame, items: DataFrame, k: int = 10, by: list[str] | None = None, k1: float = K1, b: float = B, repeated: bool = False) -> DataFrame:
    return ranked(scores(queries, items, k1, b, by, k=k, repeated=repeated).where("score > 0"), k, by)
