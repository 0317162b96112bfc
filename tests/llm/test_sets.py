import itertools
from datetime import datetime

import numpy as np
import pytest

from corvane.llm import mixing, near_duplicates, neighbours, packing, tokens

# -- 2: neighbours --------------------------------------------------------------------------------------------------


def write(spark, items):
    return spark.createDataFrame([(c, i, v, t, 1) for c, i, v, t in items], "collection_name string, chunk_id string, vec array<float>, upserted_at timestamp, cell int")


def clustered(n, topics, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(topics, 64))
    x = c[rng.integers(0, topics, n)] + 0.9 * rng.normal(size=(n, 64))
    x[1::50] = x[::50][: len(x[1::50])] + 0.05 * rng.normal(size=(len(x[1::50]), 64))
    return x.astype(np.float32) * rng.uniform(0.5, 3, (n, 1)).astype(np.float32)


def test_recall_and_cosines(spark):
    x = clustered(6000, 12)
    t = datetime(2024, 1, 1)
    got = neighbours.neighbours(write(spark, [("c", f"k{i:05d}", v.tolist(), t) for i, v in enumerate(x)]), block=1024).toPandas()
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1, kind="stable")[:, :5]
    mine = {k: set(g) for k, g in got.groupby("chunk_id").neighbour_id}
    hit = sum(len(mine[f"k{i:05d}"] & {f"k{j:05d}" for j in row}) for i, row in enumerate(top))
    assert hit / top.size >= 0.95 and len(got) == top.size
    near = got[got.cosine >= 0.95]
    assert len(near) >= 200 and np.allclose(near.cosine, [s[int(a[1:]), int(b[1:])] for a, b in zip(near.chunk_id, near.neighbour_id)])


def test_tiles_are_exact():
    x = clustered(900, 3, 1).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    own = np.arange(900)
    q, b, cos = neighbours.tile_top(u, u, own, 5, rows=128)
    keep = neighbours.best_of(q, b, cos, 5)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = np.sort(s, axis=1)[:, ::-1][:, :5]
    assert np.allclose(np.sort(cos[keep].reshape(900, 5), axis=1)[:, ::-1], want)
    code, scale, err = neighbours.quantised(u)
    assert code.dtype == np.int8 and np.allclose(np.linalg.norm(u - code * scale[:, None], axis=1), err, atol=1e-6)


def test_newest_valid_and_edges(spark):
    v, t1, t2 = [1.0] * 64, datetime(2024, 1, 1), datetime(2024, 1, 2)
    w = write(spark, [
        ("c", "a", v, t1), ("c", "a", v, t1), ("c", "b", [2.0] * 64, t1), ("c", "gone", v, t1), ("c", "gone", None, t2), ("c", "short", [1.0], t1), ("c", "zero", [0.0] * 64, t1), ("c", "nan", [float("nan")] * 64, t1),
        ("c", "hole", [None] + [1.0] * 63, t1), ("d", "alone", v, None), (None, "x", v, t1), ("c", None, v, t1)])
    assert sorted(r.chunk_id for r in neighbours.newest_valid(w).collect()) == ["a", "alone", "b"]
    assert [(r.chunk_id_a, r.chunk_id_b) for r in neighbours.similar_pairs(w).collect()] == [("a", "b")]
    assert neighbours.neighbours(w.limit(0)).count() == 0


def test_ties_and_hot_copies(spark):
    t = datetime(2024, 1, 1)
    v = np.random.default_rng(0).normal(size=64).tolist()
    got = neighbours.neighbours(write(spark, [("c", f"k{i:03d}", v, t) for i in range(300)]), block=64).toPandas()
    assert got[got.chunk_id == "k000"].sort_values("rank").neighbour_id.tolist() == [f"k00{i}" for i in range(1, 6)] and len(got) == 1500


# -- 3: near-duplicates ---------------------------------------------------------------------------------------------


def table(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, node int")


def edited(n, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(3000)]
    common = " ".join(rng.choice(words, 40))
    out = []
    for i in range(n):
        w = list(rng.choice(words, 300))
        out.append(" ".join(w) + " " + common)
        for k in range(int(rng.integers(0, 3))):
            e = list(w)
            for _ in range(int(rng.integers(1, 18))):
                e[int(rng.integers(0, 300))] = "changed"
            out.append(" ".join(e) + " " + common)
    return list(enumerate(out))


def truth(texts, run, similarity, least):
    sets = {}
    for i, t in texts:
        w = near_duplicates.WORD.findall((t or "").lower())
        if len(w) >= max(least, run):
            sets[i] = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}


@pytest.mark.parametrize("run,similarity", [(3, 0.7), (5, 0.8)])
def test_pairs(spark, run, similarity):
    texts = edited(120)
    texts += [(9000, texts[0][1]), (9001, texts[0][1].upper()), (9002, None), (9003, ""), (9004, "too short"), (9005, "word " * 30_000)]
    want = truth(texts, run, similarity, 60)
    got = {(r.doc_id_a, r.doc_id_b) for r in near_duplicates.similar_pairs(table(spark, texts + texts[:1]), run, similarity, 60).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) and (0, 9000) in got and len(want) > 30
    groups = {r.doc_id: r.group_id for r in near_duplicates.document_groups(table(spark, texts), run, similarity, 60).collect()}
    assert len(groups) == len(texts) and groups[9000] == groups[9001] == groups[0] == 0 and groups[9002] == 9002
    assert all(groups[a] == groups[b] for a, b in got)


def test_a_hot_group_loses_no_link(spark):
    # every text differs from every other, all are similar: nodes stay large to the last level
    base = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(90):
        w = list(base)
        w[i * 4] = "edit"
        texts.append((i, " ".join(w)))
    docs = table(spark, texts)
    signed = near_duplicates.signatures(docs, 3, 60)
    reps = near_duplicates.materialize(signed.select("doc_id", "n_runs", "a", "b", "sig"), "t")
    got = near_duplicates.candidates(reps, 0.7, limit=16, levels=2)
    assert got.count() == 90 * 89 // 2
    assert {r.group_id for r in near_duplicates.document_groups(docs, 3, 0.7, 60).collect()} == {0}


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "doc_id_a long, doc_id_b long")
    got = {r.node: r.root for r in near_duplicates.components(e).collect()}
    assert set(got.values()) == {0, 100} and got[40] == 0
    assert near_duplicates.components(e.limit(0)).count() == 0
    assert near_duplicates.document_groups(table(spark, []), 3, 0.7, 60).count() == 0


# -- 7: packing -----------------------------------------------------------------------------------------------------


def test_packing_is_tight():
    rng = np.random.default_rng(4)
    sizes = [int(x) for x in np.clip(rng.lognormal(6.5, 0.7, 3000), 1, 2047)]
    start = packing.best_fit(sizes, 2048)
    bins = packing.pack_group(sizes)
    fill = np.bincount(bins, weights=sizes)
    assert fill.max() <= 2048 and len(fill) <= len(start) and sum(sizes) / (len(fill) * 2048) > 0.98
    squares = lambda bs: sum(sum(sizes[i] for i in b) ** 2 for b in bs)
    better = packing.local_search([list(b) for b in start], sizes, 2048)
    assert squares(better) >= squares(start) and sorted(i for b in better for i in b) == list(range(3000))


def test_packing_operator(spark):
    rows = [(i, "word " * (i % 7 * 90), 1) for i in range(60)] + [(100, "word " * 5000, 1), (101, None, 1), (102, "", 1), (None, "x", 1), (3, "word " * 270, 1)]
    got = packing.containers(spark.createDataFrame(rows, "doc_id long, text string, fill int"), group=16).collect()
    fill = {}
    for r in got:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
    assert max(fill.values()) <= 2048 and all(r.fill == fill[r.container_id] for r in got)
    size = {}
    for r in got:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.n_tokens
    assert size[100] == tokens.count_tokens("word " * 5000) and size[101] == 0 and size[102] == 0 and len(size) == 63
    assert all(sum(1 for r in got if r.doc_id == i) == 1 for i in range(60))
    assert packing.containers(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# -- 8: mixing ------------------------------------------------------------------------------------------------------


def test_water_filling():
    inf = float("inf")
    assert mixing.water_fill({"a": 1, "b": 1}, {"a": inf, "b": inf}, 10) == {"a": 5, "b": 5}
    assert mixing.water_fill({"a": 1, "b": 1, "c": 2}, {"a": 1, "b": inf, "c": inf}, 13) == {"a": 1, "b": 4, "c": 8}
    assert mixing.water_fill({"a": 1, "b": 1}, {"a": 2, "b": 3}, 100) == {"a": 2, "b": 3}
    assert mixing.water_fill({"a": 0, "b": 1}, {"a": 5, "b": 0}, 10) == {"a": 0, "b": 0}


def test_mixing_operator(spark):
    rng = np.random.default_rng(1)
    docs = [(i, ["Web-Crawl ", "web_crawl", "HELP CENTER"][i % 3], "word " * int(rng.integers(5, 60)), 1) for i in range(900)] + [(1000, None, "x", 1), (None, "web_crawl", "x", 1), (1001, "web_crawl", None, 1), (1002, "web_crawl", "", 1)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, repeats int")
    targets = spark.createDataFrame([("m", "web_crawl", 3.0, 1), ("m", "help_center", 2.0, 3), ("m", "none", 1.0, None), ("n", "help_center", 1.0, 2), ("z", "web_crawl", None, 1)], "mix string, source string, target_weight double, max_repeats int")
    listed, shares = mixing.mixtures(df, targets, total_tokens=40_000)
    got = {(r.mix, r.source): r for r in shares.collect()}
    assert abs(got["m", "web_crawl"].share + got["m", "help_center"].share - 1) < 1e-9 and got["m", "none"].tokens == 0 and got["z", "web_crawl"].tokens == 0
    cap = {("m", "web_crawl"): 1, ("m", "help_center"): 3, ("n", "help_center"): 2}
    rows = listed.collect()
    assert all(1 <= r.repeats <= cap[r.mix, r.source] for r in rows) and len({(r.mix, r.doc_id) for r in rows}) == len(rows)
    assert got["n", "help_center"].capped and got["n", "help_center"].tokens == 2 * got["n", "help_center"].available_tokens
    # without a clamp the shares are the targets
    _, even = mixing.mixtures(df, targets.where("mix = 'm' and source != 'none'"), total_tokens=9_000)
    e = {r.source: r.share for r in even.collect()}
    assert abs(e["web_crawl"] - 0.6) < 0.01
    assert mixing.mixtures(df.limit(0), targets)[0].count() == 0 and mixing.mixtures(df, targets.limit(0))[1].count() == 0
