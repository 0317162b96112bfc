"""Problem 7: filling containers of fixed capacity with texts, whole where they fit.

Items are dealt by hash to groups of about ``GROUP``, so no task holds more than that. In a group a best-fit start is
improved by local search: items move, swap one for one or two for one between underfull containers whenever the sum of
squared fills rises, which drains the emptiest containers. Containers that stay below ``REPACK`` of the capacity are
dealt to new groups once more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.tokens import VOCABULARY, with_tokens
from corvane.runtime import materialize

CAPACITY, GROUP, REPACK = 2048, 8192, 0.93


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers (lists of item numbers), largest items first, each into the fullest container that takes it."""
    bins: list[list[int]] = []
    by_space: dict[int, list[int]] = {}
    mask = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = sizes[i]
        fit = mask >> s
        if fit:
            space = s + (fit & -fit).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                mask &= ~(1 << space)
        else:
            space, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = space - s
        by_space.setdefault(left, []).append(b)
        mask |= 1 << left
    return bins


def _groups(items: list[int], sizes) -> dict[int, tuple[int, ...]]:
    """One item or pair of a container for each size that one item or two have together (at most as many as the capacity)."""
    by_size: dict[int, list[int]] = {}
    for i in items:
        by_size.setdefault(sizes[i], []).append(i)
    out: dict[int, tuple[int, ...]] = {s: (x[0],) for s, x in by_size.items()}
    values = sorted(by_size)
    for k, s in enumerate(values):
        if len(by_size[s]) > 1:
            out.setdefault(2 * s, tuple(by_size[s][:2]))
        for t in values[k + 1 :]:
            out.setdefault(s + t, (by_size[s][0], by_size[t][0]))
    out.pop(0, None)
    return out


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Moves, one-for-one and two-for-one exchanges between underfull containers, each raising the sum of squared fills.

    It goes on until none is left, so it ends; empty containers go. An item moves only to a container at least as full as
    its own, and of several exchanges the one that moves most, and then leaves least room, is taken.
    """
    size = np.asarray(sizes, np.int64)
    at = np.empty(len(size), np.int64)
    for b, items in enumerate(bins):
        at[items] = b
    fill = np.array([int(size[x].sum()) for x in bins], np.int64)
    while True:
        changed = False
        live = np.flatnonzero(fill[at] < capacity)  # a full container takes no part
        for a in [b for b in np.argsort(fill, kind="stable") if 0 < fill[b] < capacity]:
            while bins[a] and fill[a] < capacity:
                here = at[live]
                other = (here != a) & (fill[here] >= fill[a]) & (fill[here] < capacity)
                cand, where = live[other], here[other]
                if not len(cand):
                    break
                space = capacity - fill[where]
                back_size = size[cand]
                best = None
                most = int(space.max())
                for s, g in sorted(_groups(bins[a], sizes).items(), reverse=True):
                    if best is not None and best[0][0] >= s:
                        break  # no smaller group can move more
                    if s <= most:  # a plain move
                        room = np.where(space >= s, space - s, capacity)
                        k = int(room.argmin())
                        move = ((s, -int(room[k])), g, int(where[k]), None)
                        if best is None or move[0] > best[0]:
                            best = move
                    ok = np.flatnonzero((space + back_size >= s) & (back_size < s))  # the group for one item
                    if len(ok):
                        k = ok[np.lexsort((space[ok] + back_size[ok] - s, back_size[ok]))[0]]
                        move = ((s - int(back_size[k]), -int(space[k] + back_size[k] - s)), g, int(where[k]), int(cand[k]))
                        if best is None or move[0] > best[0]:
                            best = move
                if best is None:
                    break
                _, g, b, back = best
                for i in g:
                    bins[a].remove(i), bins[b].append(i)
                    at[i] = b
                if back is not None:
                    bins[b].remove(back), bins[a].append(back)
                    at[back] = a
                moved = best[0][0]
                fill[a] -= moved
                fill[b] += moved
                changed = True
        if not changed:
            break
    return [x for x in bins if x]


def pack_group(sizes: list[int], capacity: int = CAPACITY) -> list[int]:
    """Container number (from 0) of each item; every size is at most ``capacity``."""
    out = [0] * len(sizes)
    for b, items in enumerate(local_search(best_fit(sizes, capacity), sizes, capacity)):
        for i in items:
            out[i] = b
    return out


def _packed(items: DataFrame, n: int, capacity: int, group: int, seed: int) -> DataFrame:
    groups = max(1, -(-n // group))
    dealt = items.select("doc_id", "piece_no", "start_token", "n_tokens", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(seed)), F.lit(groups)).alias("g"))
    dealt = dealt.repartition(groups, "g")  # a group is much work and few bytes: not to be coalesced by size

    def solve(keys, items):
        t = items.sort_by([("doc_id", "ascending"), ("piece_no", "ascending")])
        size = t.column("n_tokens").to_pylist()
        bins = np.array(pack_group(size, capacity), np.int64)
        fill = np.bincount(bins, weights=size).astype(np.int32)
        name = (np.int64(seed) << 56) + (np.int64(keys[0].as_py()) << 20) + bins
        return t.drop_columns(["g"]).append_column("container_id", pa.array(name)).append_column("fill", pa.array(fill[bins]))

    return dealt.groupBy("g").applyInArrow(solve, "doc_id long, piece_no int, start_token int, n_tokens int, container_id long, fill int")


def containers(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, group: int = GROUP) -> DataFrame:
    """doc_id, piece_no, start_token, n_tokens, container_id, fill: every document in containers of ``capacity`` tokens.

    A text above the capacity is cut into full containers and a rest that is packed like a text; any other text is piece
    0, whole. Null and empty texts have 0 tokens and lie in some container too. Rows without doc_id are left out, repeated
    rows of one doc_id count once. fill is the container's number of tokens.
    """
    sized = materialize(with_tokens(docs.where("doc_id is not null"), ["doc_id"], vocabulary).dropDuplicates(["doc_id"]), "p7-sizes")
    pieces = sized.select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / capacity) - 1, F.lit(0)).cast("int"))).alias("piece_no"))
    pieces = pieces.select("doc_id", "piece_no", (F.col("piece_no") * capacity).alias("start_token"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece_no") * capacity).alias("n_tokens"))
    full = pieces.where(F.col("n_tokens") == capacity).withColumn("container_id", (F.lit(3).cast("long") * (1 << 56)) + (F.xxhash64("doc_id", "piece_no").bitwiseAND(F.lit((1 << 55) - 1)))).withColumn("fill", F.lit(capacity))
    items = materialize(pieces.where(F.col("n_tokens") < capacity), "p7-items")
    first = materialize(_packed(items, items.count(), capacity, group, 1), "p7-first")
    loose = first.where(F.col("fill") < REPACK * capacity)
    again = _packed(loose, loose.count(), capacity, group, 2)
    return first.where(F.col("fill") >= REPACK * capacity).unionByName(again).unionByName(full)
