"""Whether two metrics rank a collection alike."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.vector import scored


def quantised(s: np.ndarray, tolerance: float = 1e-6) -> np.ndarray:
    """Scores rounded to a share of the greatest absolute one (1 if all are 0)."""
    top = float(np.abs(s).max()) if len(s) else 1.0
    return np.round(s / (top or 1.0) / tolerance) * tolerance


def quantised_scores(queries: DataFrame, base: DataFrame, metric: str = "dot", tolerance: float = 1e-6, digits: int = 9) -> DataFrame:
    """query_id, item_id, quantised: the score of every item of each query, quantised over all of them."""
    kind = {x: f.schema[x].dataType.simpleString() for x, f in (("query_id", queries), ("item_id", base))}

    def quantise(t: pa.Table) -> pa.Table:
        ids = t.column("items").combine_chunks().flatten()
        q = quantised(np.asarray(t.column(metric).combine_chunks().flatten()), tolerance)
        return pa.table([t.column("query_id").take(pa.array(np.zeros(len(ids), np.int64))), ids, pa.array(q)], ["query_id", "item_id", "quantised"])

    return scored(queries, base, (metric,), digits).groupBy("query_id").applyInArrow(quantise, f"query_id {kind['query_id']}, item_id {kind['item_id']}, quantised double")


def _pairs(sizes: np.ndarray) -> int:
    return int((sizes.astype(np.int64) * (sizes - 1) // 2).sum())


def _inversions(ranks: np.ndarray) -> int:
    """Pairs i < j with ranks[i] > ranks[j]: a merge sort read from the top, where each bit of the ranks splits every node stably in two."""
    r, n, total = ranks.astype(np.int64), len(ranks), 0
    for bit in reversed(range(int(r.max(initial=0)).bit_length())):
        node, one = r >> (bit + 1), (r >> bit) & 1
        start = np.searchsorted(node, node)
        ones = np.concatenate([[0], np.cumsum(one)])
        before = ones[:-1] - ones[start]
        total += int(before[one == 0].sum())
        end = np.searchsorted(node, node, "right")
        zeros = end - start - (ones[end] - ones[start])
        at = np.where(one == 1, start + zeros + before, np.arange(n) - before)
        out = np.empty_like(r)
        out[at] = r
        r = out
    return total


def kendall_tau(x: np.ndarray, y: np.ndarray) -> float:
    """Tau-b in O(n log n); 1 where it is undefined."""
    rx, ry = (np.unique(v, return_inverse=True)[1].reshape(-1) for v in (x, y))
    both = rx.astype(np.int64) * (len(x) + 1) + ry
    n, tx, ty, txy = len(x) * (len(x) - 1) // 2, *(_pairs(np.unique(v, return_counts=True)[1]) for v in (rx, ry, both))
    if n == tx or n == ty:
        return 1.0
    net = n - tx - ty + txy - 2 * _inversions(ry[np.argsort(both, kind="stable")])
    return net / np.sqrt(float(n - tx) * float(n - ty))


def compared(queries: DataFrame, base: DataFrame, first: str = "cosine", second: str = "dot", k: int = 10, tolerance: float = 1e-6) -> DataFrame:
    """query_id, tau, identical, tied of each query over all items.

    identical: the k first items agree after quantising, ties by item; tied: equal neighbours among the k + 1 first.
    A query's group is a row per block of items, with an item and two scores for each item of ``base``.
    """
    qkind = queries.schema["query_id"].dataType.simpleString()

    def judge(t: pa.Table) -> pa.Table:
        ids = t.column("items").combine_chunks().flatten()
        order = np.asarray(pa.compute.sort_indices(ids))
        x, y = (quantised(np.asarray(t.column(m).combine_chunks().flatten())[order], tolerance) for m in ("a", "b"))
        ox, oy = (np.argsort(-s, kind="stable")[:k] for s in (x, y))
        tied = any(bool((np.diff(np.sort(s)[::-1][: k + 1]) == 0).any()) for s in (x, y))
        return pa.table([t.column("query_id").slice(0, 1), pa.array([round(float(kendall_tau(x, y)), 9)]), pa.array([bool((ox == oy).all())]), pa.array([tied])], ["query_id", "tau", "identical", "tied"])

    both = scored(queries, base, (first, second), 12).select("query_id", "items", F.col(first).alias("a"), F.col(second).alias("b"))
    return both.groupBy("query_id").applyInArrow(judge, f"query_id {qkind}, tau double, identical boolean, tied boolean")


def verdict(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("tau"), 9).alias("mean_tau"), F.round(F.avg(F.col("identical").cast("double")), 9).alias("identical_rate"), F.count_if("tied").alias("n_tied"))
