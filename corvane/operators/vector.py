"""Exact search of a stated query set over a collection of vectors, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, QUERIES, WHOLE = 16384, 2048, 128  # WHOLE: queries of a block whose scores are all kept
#: Queries of a tile that are scored at once, which bounds a task's memory.
SLICE = 128
METRICS = ("dot", "cosine", "euclidean")


def scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Greater is better: dot product, cosine (0 where a vector is zero) or negative Euclidean distance."""
    if metric == "dot":
        return q @ x.T
    if metric == "cosine":
        a, b = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
        n = np.outer(a, b)
        return np.where(n == 0, 0.0, (q @ x.T) / np.where(n == 0, 1.0, n))
    if metric == "euclidean":
        return -np.sqrt(np.maximum(((q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * q @ x.T), 0.0))
    raise ValueError(f"no metric {metric!r}")


def _tiles(queries: DataFrame, base: DataFrame, per: int = QUERIES):
    """Queries and items dealt to blocks and grouped by pairs of them, and the types of query_id and item_id."""
    kind = base.schema["item_id"].dataType.simpleString()
    qkind = queries.schema["query_id"].dataType.simpleString()
    q, b = queries.where("vec is not null"), base.where("vec is not null")
    nq, nb = max(1, -(-q.count() // per)), max(1, -(-b.count() // BLOCK))
    asks = q.select(F.pmod(F.xxhash64("query_id"), F.lit(nq)).alias("qb"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nb - 1).cast("bigint"))).alias("bb"), F.col("query_id").alias("qid"), F.lit(None).cast(kind).alias("iid"), "vec")
    rows = b.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nq - 1).cast("bigint"))).alias("qb"), F.pmod(F.xxhash64("item_id"), F.lit(nb)).alias("bb"), F.lit(None).cast(qkind).alias("qid"), F.col("item_id").alias("iid"), "vec")
    return asks.unionByName(rows).groupBy("qb", "bb"), qkind, kind


def _sides(t):
    """Query rows and item rows (by item) of a tile, with their matrices; nothing where a side is empty."""
    ask = t.column("qid").is_valid().combine_chunks()
    a, x = t.filter(ask), t.filter(pa.compute.invert(ask))
    if not a.num_rows or not x.num_rows:
        return a, x, None, None
    x = x.take(pa.compute.sort_indices(x, sort_keys=[("iid", "ascending")]))
    dim = len(a.column("vec")[0])
    return a, x, *(np.asarray(y.column("vec").combine_chunks().flatten(), np.float64).reshape(-1, dim) for y in (a, x))


def search(queries: DataFrame, base: DataFrame, k: int = 10, metric: str = "cosine", skip_self: bool = False, digits: int = 9) -> DataFrame:
    """query_id, item_id, score, rank (from 1): the k best items of each query; equal scores (to ``digits``) rank by the smaller item.

    queries: query_id, vec; base: item_id, vec. Null vectors are left out; lengths must agree. Queries and items are dealt
    to blocks, each pair of blocks is one matrix product with its own top k, and the partial lists are merged. Fewer than
    k items: all of them.
    """
    tiles, qkind, kind = _tiles(queries, base)
    more = k + skip_self

    def tile(t):
        a, x, qm, xm = _sides(t)
        out = pa.schema([("query_id", a.schema.field("qid").type), ("item_id", x.schema.field("iid").type), ("score", pa.float64())])
        if qm is None:
            return out.empty_table()
        keep, parts = min(more, len(xm)), []
        for i in range(0, len(qm), SLICE):
            s = np.round(scores(qm[i : i + SLICE], xm, metric), digits)
            kth = np.partition(s, s.shape[1] - keep, axis=1)[:, s.shape[1] - keep]
            r, c = np.nonzero(s >= kth[:, None])
            order = np.lexsort((c, -s[r, c], r))
            r, c = r[order], c[order]
            first = np.arange(len(r)) - np.searchsorted(r, r) < keep
            r, c = r[first], c[first]
            parts.append((r + i, c, s[r, c]))
        r, c, s = (np.concatenate(p) for p in zip(*parts, strict=True))
        return pa.Table.from_arrays([a.column("qid").take(pa.array(r)), x.column("iid").take(pa.array(c)), pa.array(s)], schema=out)

    part = tiles.applyInArrow(tile, f"query_id {qkind}, item_id {kind}, score double")
    if skip_self:
        part = part.where(F.col("query_id").cast("string") != F.col("item_id").cast("string"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k)


def scored(queries: DataFrame, base: DataFrame, metrics: tuple[str, ...] = ("cosine",), digits: int = 9) -> DataFrame:
    """query_id, items, then an array of scores per metric: every item of each query, a row per block of items.

    Inputs as in ``search``; nothing is cut. The rows of a query together hold all items once.
    """
    tiles, qkind, kind = _tiles(queries, base, WHOLE)

    def tile(t):
        a, x, qm, xm = _sides(t)
        out = pa.schema([("query_id", a.schema.field("qid").type), ("items", pa.list_(x.schema.field("iid").type)), *[(m, pa.list_(pa.float64())) for m in metrics]])
        if qm is None:
            return out.empty_table()
        n, m = len(qm), len(xm)
        ends = pa.array(np.arange(0, n * m + 1, m), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, x.column("iid").combine_chunks().take(pa.array(np.tile(np.arange(m), n))))]
        lists += [pa.ListArray.from_arrays(ends, pa.array(np.round(scores(qm, xm, metric), digits).ravel())) for metric in metrics]
        return pa.Table.from_arrays([a.column("qid").combine_chunks(), *lists], schema=out)

    return tiles.applyInArrow(tile, f"query_id {qkind}, items array<{kind}>, " + ", ".join(f"{m} array<double>" for m in metrics))


def upserted(writes: DataFrame, key: str = "chunk_id", at: str = "upserted_at", dim: int | None = None) -> DataFrame:
    """The newest write of each key (a null time is oldest; ties: the greater row); with ``dim`` only vectors of that length."""
    rest = [c for c in writes.columns if c not in (key, at)]
    last = writes.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("w")).select(key, "w.*")
    return last.where(F.size("vec") == dim) if dim else last


def approximate(queries: DataFrame, base: DataFrame, k: int = 10, width: float = 0.5, tables: int = 8, seed: int = 7, cells: int = 3) -> DataFrame:
    """As ``search`` (cosine) over candidates that share a random-projection bucket; a query may get fewer than k items.

    Every item is indexed in ``tables`` tables; projections are drawn from ``seed`` and need no fit. In each table a query
    asks in its own bucket and in the one beyond the boundary that is closest to it.
    """
    dim = len(base.where("vec is not null").select("vec").first()[0])
    lines = np.random.default_rng(seed).normal(size=(tables, cells, dim))
    lines /= np.linalg.norm(lines, axis=2, keepdims=True)

    def placed(rows, *keep):
        vec = F.col("vec")
        norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        at = lambda line: F.aggregate(F.zip_with(vec, F.array(*[F.lit(float(v)) for v in line]), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x) / norm / width
        return rows.where("vec is not null").select(*keep, F.posexplode(F.array(*[F.array(*[at(line) for line in lines[t]]) for t in range(tables)])).alias("t", "p"))

    off = F.transform("p", lambda x: F.least(x - F.floor(x), F.floor(x) + 1 - x))
    closest = F.array_position(off, F.array_min(off)) - 1
    own = F.transform("p", lambda x: F.floor(x))
    beyond = F.transform("p", lambda x, i: F.floor(x) + F.when(i != closest, 0).when(x - F.floor(x) < 0.5, -1).otherwise(1))
    q = placed(queries, "query_id", F.col("vec").alias("qv")).select("query_id", "qv", F.explode(F.array(F.xxhash64("t", own), F.xxhash64("t", beyond))).alias("b"))
    x = placed(base, "item_id", F.col("vec").alias("xv")).select("item_id", "xv", F.xxhash64("t", own).alias("b"))
    pairs = q.join(x, "b").where(F.col("query_id").cast("string") != F.col("item_id").cast("string")).dropDuplicates(["query_id", "item_id"])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    sim = pairs.select("query_id", "item_id", F.round(dot(F.col("qv"), F.col("xv")) / F.sqrt(dot(F.col("qv"), F.col("qv")) * dot(F.col("xv"), F.col("xv"))), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    return sim.withColumn("rank", rank).where(F.col("rank") <= k)
