"""Problem 2: the k most similar vectors of every vector of a collection.

Block matrix join. A bounded sample fits spherical centroids; every vector is stored in its nearest cell and asks in
every cell whose centroid it resembles nearly as much (``MARGIN``), so cells beyond that are never multiplied. Cells are
cut into blocks of ``BLOCK`` rows, so a hot cell becomes many tiles of equal size. In a tile, int8 codes of both
blocks are multiplied; with each row's exact quantisation error a pair's cosine is known up to a bound, and only pairs
whose upper bound reaches the row's k-th lower bound are computed again in float. Tile results are merged by a bounded
top-k per vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.runtime import materialize

DIM, K = 64, 5
#: Vectors per collection that fit the centroids (the only thing fitted on a sample): PER_CELL a centroid, SAMPLE at least.
SAMPLE, PER_CELL = 8192, 32
#: A cell of a collection of up to CENTROIDS * CELL vectors holds about CELL of them; beyond, cells grow in number and in
#: size by the square root of the collection, up to MOST_CELLS.
CENTROIDS, CELL, MOST_CELLS = 64, 1024, 4096
MARGIN = 0.3
BLOCK = 8192


def newest_valid(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """collection_name, chunk_id, vec: each chunk's newest vector where that is valid.

    A chunk whose newest write is null, not ``dim`` long, all zero or holds a NaN, an infinity or a null is left out,
    even if an older write was valid. Of two writes at one time the greater vector holds; a null time counts as oldest.
    Rows without chunk_id or collection_name are left out.
    """
    last = (
        vectors.where("chunk_id is not null and collection_name is not null")
        .groupBy("chunk_id").agg(F.max(F.struct("upserted_at", "vec", "collection_name")).alias("w"))
        .select("w.collection_name", "chunk_id", "w.vec")
    )
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return last.where(F.col("vec").isNotNull() & (F.size("vec") == dim) & ~bad & F.exists("vec", lambda x: x != 0))


def _fit(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c)
    return c.astype(np.float32)


def cells_of(n: int) -> int:
    """Cells for a collection of n vectors."""
    few = max(1, n // CELL)
    return few if few <= CENTROIDS else min(MOST_CELLS, int(CENTROIDS * (n / (CENTROIDS * CELL)) ** 0.5))


def centroids(valid: DataFrame, dim: int = DIM) -> dict[str, np.ndarray]:
    """Unit centroids by collection, from about max(SAMPLE, PER_CELL x cells) vectors of each, taken by hash of their ids."""
    n = {r[0]: r[1] for r in valid.groupBy("collection_name").count().collect()}
    share = F.coalesce(*[F.when(F.col("collection_name") == name, F.lit(min(1.0, max(SAMPLE, PER_CELL * cells_of(c)) / c))) for name, c in n.items()], F.lit(0.0))
    rows = valid.where((F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 20)) / float(1 << 20)) < share).select("collection_name", "vec").toPandas()
    out = {}
    for name, part in rows.groupby("collection_name"):
        x = np.stack(part.vec.to_numpy()).astype(np.float32)
        x /= np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
        out[name] = _fit(x, cells_of(n[name]))
    for name in n:
        out.setdefault(name, np.zeros((1, dim), np.float32))
    return out


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scale per row, and the length of each row's quantisation error, for unit rows."""
    scale = np.abs(x).max(axis=1) / 127
    code = np.rint(x / scale[:, None]).astype(np.int8)
    return code, scale.astype(np.float32), np.linalg.norm(x - code * scale[:, None], axis=1).astype(np.float32)


def tile_top(q: np.ndarray, b: np.ndarray, own: np.ndarray, k: int, rows: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of ``b`` for each row of ``q`` (unit rows): indices of q, of b, and cosines.

    own[i] is the row of b that is q's row i itself, or -1. Fewer than k other rows: all of them.
    """
    cq, sq, eq = quantised(q)
    cb, sb, eb = quantised(b)
    fq, fb = cq.astype(np.float32), cb.astype(np.float32)  # products of int8 codes are exact in float32
    fb_t = np.ascontiguousarray((fb * sb[:, None]).T)
    worst = float(eb.max()) if len(eb) else 0.0
    qi, bi, cos = [], [], []
    for s in range(0, len(q), rows):
        e = min(len(q), s + rows)
        near = (fq[s:e] * sq[s:e, None]) @ fb_t  # approximate cosines
        m = own[s:e]
        near[np.flatnonzero(m >= 0), m[m >= 0]] = -2
        # |x.y - x^.y^| <= |dx||y^| + |x^||dy| + |dx||dy|, and |y^| <= 1 + |dy|
        bound = eq[s:e] * (1 + worst) + (1 + eq[s:e]) * worst + eq[s:e] * worst + 1e-5
        width = near.shape[1]
        if width > 4 * k:
            part = near[:, : max(4 * k, min(width, 2048))]
            floor = np.partition(part, part.shape[1] - k, axis=1)[:, part.shape[1] - k]
            r, c = np.nonzero(near >= (floor - 2 * bound)[:, None])
            if part.shape[1] < width and len(r) > 64 * (e - s):  # a poor first guess: once more over the whole tile
                floor = np.partition(near, width - k, axis=1)[:, width - k]
                r, c = np.nonzero(near >= (floor - 2 * bound)[:, None])
        else:
            r, c = np.nonzero(near > -2)
        if not len(r):
            continue
        keep = near[r, c] > -2
        r, c = r[keep], c[keep]
        # tighten by the k-th best of what survived, before floats are touched
        v = near[r, c]
        order = np.lexsort((-v, r))
        r, c, v = r[order], c[order], v[order]
        first = np.searchsorted(r, np.arange(e - s))
        kth = np.minimum(first + k - 1, np.append(first[1:], len(r)) - 1)
        low = np.where(kth >= first, v[np.minimum(kth, len(v) - 1)], -2.0)
        keep = v >= low[r] - 2 * bound[r]
        r, c = r[keep], c[keep]
        exact = np.einsum("ij,ij->i", q[s + r], b[c])
        qi.append(r + s), bi.append(c), cos.append(exact)
    if not qi:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0)
    return np.concatenate(qi), np.concatenate(bi), np.concatenate(cos)


def best_of(qi: np.ndarray, names: np.ndarray, cos: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best: greater cosine first, then the smaller id."""
    order = np.lexsort((names, -cos, qi))
    q = qi[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return order[rank < k]


def neighbours(vectors: DataFrame, k: int = K, dim: int = DIM, margin: float = MARGIN, block: int = BLOCK) -> DataFrame:
    """collection_name, chunk_id, neighbour_id, rank (from 1), cosine: the k most similar chunks of each valid vector.

    Equal cosines (to 12 digits) rank by the smaller neighbour_id. A collection of one valid vector gives no row; one of
    fewer than k + 1 gives all others. See newest_valid for what is left out.
    """
    spark = vectors.sparkSession
    valid = materialize_valid(vectors, dim)
    cent = spark.sparkContext.broadcast(centroids(valid, dim))  # at most MOST_CELLS x dim floats a collection

    def route(batches):
        for t in batches:
            names = t.column("collection_name").to_pylist()
            x = _unit(_matrix(t.column("vec"), dim))
            rows, cells, base = [], [], []
            for name in set(names):
                at = np.array([i for i, n in enumerate(names) if n == name])
                sim = x[at] @ cent.value[name].T.astype(np.float64)
                home = sim.argmax(1)
                r, c = np.nonzero(sim >= sim.max(1, keepdims=True) - margin)
                rows.append(at[r]), cells.append(c), base.append(c == home[r])
            rows, cells, base = np.concatenate(rows), np.concatenate(cells), np.concatenate(base)
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [t.column("collection_name").take(take), pa.array(cells.astype(np.int32)), pa.array(base), t.column("chunk_id").take(take), t.column("vec").take(take)],
                names=["collection_name", "cell", "home", "chunk_id", "vec"],
            )

    routed = valid.mapInArrow(route, "collection_name string, cell int, home boolean, chunk_id string, vec array<float>")
    routed = materialize(routed, "p2-routed")
    sizes = routed.groupBy("collection_name", "cell").agg(F.count(F.lit(1)).alias("asks"), F.count_if("home").alias("holds")).collect()
    n_q = {(r[0], r[1]): -(-r[2] // block) for r in sizes}  # one entry a cell: at most MOST_CELLS a collection
    n_b = {(r[0], r[1]): -(-r[3] // block) for r in sizes}
    plan = spark.createDataFrame(
        [(c, i, n_q[c, i], n_b[c, i]) for c, i in n_q] or [("", 0, 1, 1)], "collection_name string, cell int, nq int, nb int"
    )
    salted = routed.join(F.broadcast(plan), ["collection_name", "cell"]).withColumn("h", F.xxhash64("chunk_id"))
    asks = salted.select("collection_name", "cell", F.pmod("h", "nq").cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.greatest(F.col("nb"), F.lit(1)) - 1)).alias("bb"), F.lit(True).alias("ask"), "chunk_id", "vec")
    holds = salted.where("home").select("collection_name", "cell", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"), F.pmod("h", F.greatest("nb", F.lit(1))).cast("int").alias("bb"), F.lit(False).alias("ask"), "chunk_id", "vec")

    def solve(keys, t):
        ask = np.asarray(t.column("ask").to_numpy(zero_copy_only=False)).astype(bool)
        ids = np.array(t.column("chunk_id").to_pylist(), dtype=object)
        x = _unit(_matrix(t.column("vec").combine_chunks(), dim))
        qn, bn = ids[ask], ids[~ask]
        schema = pa.schema([("collection_name", pa.string()), ("chunk_id", pa.string()), ("near", pa.list_(pa.struct([("cosine", pa.float64()), ("neighbour_id", pa.string())])))])
        if not len(qn) or not len(bn):
            return schema.empty_table()
        where = {n: i for i, n in enumerate(bn)}
        own = np.array([where.get(n, -1) for n in qn])
        qi, bi, cos = tile_top(x[ask], x[~ask], own, k)
        cos = np.round(cos, 12)
        names = bn[bi].astype(str)
        keep = best_of(qi, names, cos, k)
        qi, names, cos = qi[keep], names[keep], cos[keep]
        edges = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]]) if len(qi) else np.zeros(0, int)
        near = pa.ListArray.from_arrays(
            pa.array(np.r_[edges, len(qi)].astype(np.int32)),
            pa.StructArray.from_arrays([pa.array(cos), pa.array(names.tolist(), pa.string())], names=["cosine", "neighbour_id"]),
        )
        return pa.Table.from_arrays([pa.array([keys[0].as_py()] * len(edges), pa.string()), pa.array(qn[qi[edges]].tolist(), pa.string()), near], schema=schema)

    near_t = "array<struct<cosine:double,neighbour_id:string>>"
    tiles = asks.unionByName(holds).groupBy("collection_name", "cell", "qb", "bb").applyInArrow(solve, f"collection_name string, chunk_id string, near {near_t}")
    flat = tiles.select("collection_name", "chunk_id", F.explode("near").alias("n")).select("collection_name", "chunk_id", F.struct((-F.col("n.cosine")).alias("c"), F.col("n.neighbour_id").alias("i")).alias("n"))
    # a vector asks in few cells, each a bounded number of blocks: its list is k rows a tile
    top = flat.groupBy("collection_name", "chunk_id").agg(F.slice(F.array_sort(F.collect_set("n")), 1, k).alias("top"))
    return top.select("collection_name", "chunk_id", F.posexplode("top").alias("rank", "n")).select(
        "collection_name", "chunk_id", F.col("n.i").alias("neighbour_id"), (F.col("rank") + 1).cast("int").alias("rank"), (-F.col("n.c")).alias("cosine")
    )


def materialize_valid(vectors: DataFrame, dim: int) -> DataFrame:
    return materialize(newest_valid(vectors, dim), "p2-valid")


def similar_pairs(vectors: DataFrame, least: float = 0.9, k: int = K, dim: int = DIM) -> DataFrame:
    """chunk_id_a < chunk_id_b: pairs of cosine ``least`` or more of which one is among the other's k nearest."""
    n = neighbours(vectors, k, dim).where(F.col("cosine") >= least - 1e-9)
    return n.select(F.least("chunk_id", "neighbour_id").alias("chunk_id_a"), F.greatest("chunk_id", "neighbour_id").alias("chunk_id_b")).distinct()
