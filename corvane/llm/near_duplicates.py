"""Problem 3: near-duplicate documents by a chosen-path set similarity join.

Documents become sets of hashed word runs with T minwise tokens each. A tree's root picks a few token positions and
sends a document to one child for each picked token; a node of at most ``LIMIT`` documents is compared exhaustively,
a larger one picks further positions (1 / similarity of them on average) and branches again. ``TREES`` independent
trees reach the target recall. Pairs within a node pass a 128-bit sketch filter; what is left is verified exactly
on the full sets. Equal sets are joined first, so copies of one text are one document here.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.runtime import materialize, small_or_none, spread

RUN, SIMILARITY, MIN_WORDS = 5, 0.8, 1
T, TREES, LIMIT, LEVELS = 64, 8, 64, 8
#: Documents of a class of equal sets that meet in one tile when all pairs are asked for.
COPIES = 512
WORD = re.compile(r"[^\W_]+")
_MASK = (1 << 64) - 1


class _Ids(dict):
    """Word to 64-bit hash, remembered up to a bound."""

    def __missing__(self, w: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


def word_runs(text: str, ids: dict, run: int) -> tuple[int, np.ndarray]:
    """Number of words, and the sorted distinct hashes of the runs of ``run`` words."""
    words = WORD.findall(text.lower())
    if len(words) < run:
        return len(words), np.zeros(0, np.uint64)
    w = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    h = w[: len(w) - run + 1].copy()
    for k in range(1, run):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - run + 1 + k]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return len(words), np.unique(h)


def _coefficients(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 32, n, dtype=np.uint32) | np.uint32(1)


_A, _B = _coefficients(2 * T, 11), _coefficients(2 * T, 12)


def minwise(h: np.ndarray) -> tuple[np.ndarray, int, int]:
    """T minwise tokens (uint32) and a 128-bit sketch as two signed 64-bit halves."""
    low = (h ^ (h >> np.uint64(32))).astype(np.uint32)
    least = np.full(2 * T, 0xFFFFFFFF, np.uint32)
    for s in range(0, len(low), 4096):
        x = low[s : s + 4096, None] * _A + _B
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(least, x.min(axis=0), out=least)
    bits = np.packbits((least >> np.uint32(9)) & np.uint32(1))
    a, b = np.frombuffer(bits.tobytes(), np.int64)
    return least[:T], int(a), int(b)


def signatures(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_runs, set_hash (32 hex digits), a, b (sketch), sig (T tokens as bytes) of documents that have runs."""

    def sign(batches):
        ids = _Ids()
        for t in batches:
            keep, n, hx, a, b, sig = [], [], [], [], [], []
            for i, text in enumerate(t.column("text")):
                words, h = word_runs(text.as_py() or "", ids, run)
                if words < min_words or not len(h):
                    continue
                s, p, q = minwise(h)
                keep.append(i), n.append(len(h)), hx.append(xxhash.xxh3_128_hexdigest(h.tobytes())), a.append(p), b.append(q), sig.append(s.tobytes())
            yield pa.RecordBatch.from_arrays(
                [t.column("doc_id").take(pa.array(keep, pa.int32())), pa.array(n, pa.int32()), pa.array(hx, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sig, pa.binary())],
                names=["doc_id", "n_runs", "set_hash", "a", "b", "sig"],
            )

    return spread(docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")).mapInArrow(
        sign, "doc_id long, n_runs int, set_hash string, a long, b long, sig binary"
    )


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _branch(similarity: float):
    """Children of every (node, document): position j is picked with probability 1 / (similarity T), the same for all documents of a node."""
    share = np.uint64(min(_MASK, int(_MASK / (similarity * T))))
    first = np.uint64(0x632BE59BD9B4E019)
    pos = np.arange(T, dtype=np.uint64)

    def go(batches):
        for t in batches:
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, T)
            node = t.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
            draw = _mix(node[:, None] * first + pos * np.uint64(0x9E3779B97F4A7C15))
            pick = draw < share
            pick[np.arange(len(node)), draw.argmin(axis=1)] = True  # no branch dies out for want of a pick
            r, c = np.nonzero(pick)
            child = _mix(node[r] * np.uint64(0xD6E8FEB86659FD93) + (pos[c] << np.uint64(32)) + sig[r, c].astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), t.column("doc_id").take(pa.array(r, pa.int32()))], names=["node", "doc_id"])

    return go


def _within(nodes: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """Pairs of one node whose sizes and sketches allow the similarity."""
    m = nodes.join(marks, "doc_id").select("node", "tile", "doc_id", "n_runs", "a", "b", "side")
    x, y = m.where("side <= 1").alias("x"), m.where("side = 0 or side = 2").alias("y")
    # 4 standard deviations of the sketch's estimate below the similarity
    p = (1 - similarity) / 2
    most = math.ceil(2 * T * p + 4.2 * math.sqrt(2 * T * p * (1 - p)))
    near = F.bit_count(F.expr("x.a ^ y.a")) + F.bit_count(F.expr("x.b ^ y.b")) <= most
    order = ((F.col("x.side") == 0) & (F.col("y.side") == 0) & (F.col("x.doc_id") < F.col("y.doc_id"))) | ((F.col("x.side") == 1) & (F.col("y.side") == 2))
    sizes = (F.col("x.n_runs") >= F.floor(F.col("y.n_runs") * similarity)) & (F.col("y.n_runs") >= F.floor(F.col("x.n_runs") * similarity))
    return x.join(y, (F.col("x.node") == F.col("y.node")) & (F.col("x.tile") == F.col("y.tile")) & order & sizes & near).select(
        F.least("x.doc_id", "y.doc_id").alias("doc_id_a"), F.greatest("x.doc_id", "y.doc_id").alias("doc_id_b")
    )


def candidates(reps: DataFrame, similarity: float, trees: int = TREES, limit: int = LIMIT, levels: int = LEVELS) -> DataFrame:
    """Candidate pairs of the trees, level by level; a node is compared when it is small, and at the last level in tiles."""
    spark = reps.sparkSession
    marks = reps.select("doc_id", "n_runs", "a", "b")
    at = reps.select("doc_id", "sig", F.explode(F.array(*[F.lit(i).cast("long") for i in range(1, trees + 1)])).alias("node"))
    out = None
    for level in range(1, levels + 1):
        rows = materialize(at.mapInArrow(_branch(similarity), "node long, doc_id long"), f"p3-level{level}")
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sizes = materialize(sizes, f"p3-sizes{level}")
        small, large = sizes.where(F.col("n") <= limit).select("node"), sizes.where(F.col("n") > limit)
        part = rows.join(small, "node").select("node", "doc_id", F.lit(0).alias("tile"), F.lit(0).alias("side"))
        pairs = _within(part, marks, similarity)
        go_on = bool(large.head(1))
        if go_on and level == levels:
            # still large: blocks of `limit` documents against each other, a tile per pair of blocks, none left out
            pairs = pairs.unionByName(_within(_tiled(rows.join(large, "node"), limit), marks, similarity))
        pairs = materialize(pairs.distinct(), f"p3-pairs{level}")
        out = pairs if out is None else out.unionByName(pairs)
        if not go_on:
            break
        at = rows.join(large.select("node"), "node").join(reps.select("doc_id", "sig"), "doc_id").select("doc_id", "sig", "node")
    return out.distinct() if out is not None else spark.createDataFrame([], "doc_id_a long, doc_id_b long")


def _tiled(rows: DataFrame, limit: int) -> DataFrame:
    """Each block pair (i <= j) of a large node is a tile; a document goes to the tiles of its block."""
    block = rows.withColumn("nb", F.ceil(F.col("n") / limit).cast("int")).withColumn("k", F.pmod(F.xxhash64("doc_id", "node"), F.col("nb")).cast("int"))
    other = block.select("node", "doc_id", "nb", "k", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
    tile = (F.least("k", "o") * F.col("nb") + F.greatest("k", "o")).cast("int")
    side = F.when(F.col("k") == F.col("o"), 0).when(F.col("k") < F.col("o"), 1).otherwise(2)
    return other.select("node", "doc_id", tile.alias("tile"), side.alias("side"))


def verified(docs: DataFrame, pairs: DataFrame, run: int, similarity: float) -> DataFrame:
    """doc_id_a, doc_id_b, similarity of candidate pairs whose exact set similarity is high enough."""
    need = pairs.select(F.col("doc_id_a").alias("doc_id")).union(pairs.select("doc_id_b")).distinct()
    need = F.broadcast(need) if small_or_none(need) else need

    def sets(batches):
        ids = _Ids()
        for t in batches:
            yield pa.RecordBatch.from_arrays(
                [t.column("doc_id"), pa.array([word_runs(x or "", ids, run)[1].tobytes() for x in t.column("text").to_pylist()], pa.binary())], names=["doc_id", "runs"]
            )

    full = docs.select(F.col("doc_id").cast("long"), "text").join(need, "doc_id", "left_semi").mapInArrow(sets, "doc_id long, runs binary").dropDuplicates(["doc_id"])
    full = materialize(full, "p3-sets")

    def measure(batches):
        for t in batches:
            sim = []
            for x, y in zip(t.column("x").to_pylist(), t.column("y").to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                sim.append(both / max(1, len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([t.column("doc_id_a"), t.column("doc_id_b"), pa.array(sim, pa.float64())], names=["doc_id_a", "doc_id_b", "similarity"])

    both = pairs.join(full.select(F.col("doc_id").alias("doc_id_a"), F.col("runs").alias("x")), "doc_id_a").join(
        full.select(F.col("doc_id").alias("doc_id_b"), F.col("runs").alias("y")), "doc_id_b"
    )
    return both.select("doc_id_a", "doc_id_b", "x", "y").mapInArrow(measure, "doc_id_a long, doc_id_b long, similarity double").where(F.col("similarity") >= similarity)


def similar_documents(docs: DataFrame, run: int = RUN, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """``(links, members)``: verified pairs of class representatives, and every signed document's class.

    links: doc_id_a < doc_id_b, similarity. members: doc_id, class_id (smallest doc_id of the documents with an equal
    set of word runs). Documents with null id or text, fewer than ``min_words`` words or no run have no class. Repeated
    rows of a doc_id count once. An empty table gives empty results.
    """
    signed = materialize(signatures(docs, run, min_words).dropDuplicates(["doc_id"]), "p3-signatures")
    reps = signed.groupBy("set_hash").agg(F.min(F.struct("doc_id", "n_runs", "a", "b", "sig")).alias("r")).select("set_hash", "r.*")
    reps = materialize(reps, "p3-classes")
    members = signed.select("doc_id", "set_hash").join(reps.select("set_hash", F.col("doc_id").alias("class_id")), "set_hash").select("doc_id", "class_id")
    cand = materialize(candidates(reps.drop("set_hash"), similarity), "p3-candidates")
    return materialize(verified(docs, cand, run, similarity), "p3-links"), members


def similar_pairs(docs: DataFrame, run: int, similarity: float, min_words: int) -> DataFrame:
    """All pairs doc_id_a < doc_id_b of similar documents, copies of one text included."""
    links, members = similar_documents(docs, run, similarity, min_words)
    # pairs of copies of one text: a class is cut into blocks, a tile per pair of blocks, so no class is one task
    copied = members.groupBy(F.col("class_id").alias("node")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    m = _tiled(members.withColumnRenamed("class_id", "node").join(copied, "node"), COPIES)
    x, y = m.where("side <= 1").alias("x"), m.where("side = 0 or side = 2").alias("y")
    one = ((F.col("x.side") == 0) & (F.col("y.side") == 0) & (F.col("x.doc_id") < F.col("y.doc_id"))) | ((F.col("x.side") == 1) & (F.col("y.side") == 2))
    same = x.join(y, (F.col("x.node") == F.col("y.node")) & (F.col("x.tile") == F.col("y.tile")) & one).select(
        F.least("x.doc_id", "y.doc_id").alias("doc_id_a"), F.greatest("x.doc_id", "y.doc_id").alias("doc_id_b")
    )
    left = links.join(members.select(F.col("class_id").alias("doc_id_a"), F.col("doc_id").alias("p")), "doc_id_a")
    both = left.join(members.select(F.col("class_id").alias("doc_id_b"), F.col("doc_id").alias("q")), "doc_id_b")
    return both.select(F.least("p", "q").alias("doc_id_a"), F.greatest("p", "q").alias("doc_id_b")).union(same).distinct()


def components(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """node, root (smallest node of its component): label spreading with pointer jumping, a written table a round."""
    both = edges.select(F.col("doc_id_a").alias("u"), F.col("doc_id_b").alias("v"))
    both = materialize(both.union(both.select("v", "u")).distinct(), "p3-edges")
    label = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")), "p3-root0")
    for k in range(1, rounds + 1):
        near = both.join(label.select(F.col("u").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("m"))
        step = label.join(near, "u").select("u", F.least("root", "m").alias("root"), F.col("root").alias("old"))
        jump = step.join(step.select(F.col("u").alias("root"), F.col("root").alias("up")), "root", "left").select("u", F.least("root", F.coalesce("up", "root")).alias("root"), "old")
        jump = materialize(jump, f"p3-root{k}")
        moved = bool(jump.where("root != old").head(1))
        label = jump.select("u", "root")
        if not moved:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return label.select(F.col("u").alias("node"), "root")


def document_groups(docs: DataFrame, run: int = RUN, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, group_id, n_links: every document of the table once, with the smallest doc_id of its group.

    A document like no other, without text or too short is its own group. n_links counts the links of its class to
    other classes; copies of one text are in one group without links.
    """
    links, members = similar_documents(docs, run, similarity, min_words)
    root = components(links)
    degree = links.select(F.col("doc_id_a").alias("class_id")).union(links.select("doc_id_b")).groupBy("class_id").agg(F.count(F.lit(1)).cast("int").alias("n_links"))
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return (
        ids.join(members, "doc_id", "left")
        .join(root.withColumnRenamed("node", "class_id"), "class_id", "left").join(degree, "class_id", "left")
        .select("doc_id", F.coalesce("root", "class_id", "doc_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
