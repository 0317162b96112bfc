"""Paired comparisons of conditions on the same queries: descriptives in the JVM, tests per pair on Arrow groups."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESAMPLES, SEED = 10_000, 20240501


def paired(scores: DataFrame, baseline: str | None = None) -> DataFrame:
    """metric, a, b, query_id, x, y: scores (condition, query_id, metric, score) of two conditions on their common queries.

    With ``baseline`` each other condition against it, else every pair in the order of their names.
    """
    left = scores.select(F.col("condition").alias("a"), "query_id", "metric", F.col("score").alias("x"))
    right = scores.select(F.col("condition").alias("b"), "query_id", "metric", F.col("score").alias("y"))
    both = left.join(right, ["query_id", "metric"])
    return both.where((F.col("b") == baseline) & (F.col("a") != baseline) if baseline else F.col("a") < F.col("b"))


def described(pairs: DataFrame) -> DataFrame:
    d = F.col("x") - F.col("y")
    return pairs.groupBy("metric", "a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 9).alias("mean_a"), F.round(F.avg("y"), 9).alias("mean_b"), F.round(F.avg(d), 9).alias("mean_diff"), F.round(F.percentile(d, 0.5), 9).alias("median_diff"),
        F.count_if(d == 0).alias("n_ties"), F.count_if(d > 0).alias("n_wins_a"), F.count_if(d < 0).alias("n_wins_b"),
    )


def signed_ranks(pairs: DataFrame) -> DataFrame:
    """metric, a, b, n_used, w_plus, w_minus: rank sums of the absolute differences, zeros left out, ties by their mean rank."""
    d = pairs.withColumn("d", F.round(F.col("x") - F.col("y"), 12)).where("d != 0").withColumn("m", F.abs("d"))
    g = ["metric", "a", "b"]
    ranked = d.withColumn("r", F.rank().over(Window.partitionBy(*g).orderBy("m")) + (F.count(F.lit(1)).over(Window.partitionBy(*g, "m")) - 1) / 2)
    return ranked.groupBy(*g).agg(F.count(F.lit(1)).alias("n_used"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0)).alias("w_minus"))


def cliffs_delta(pairs: DataFrame) -> DataFrame:
    """metric, a, b, delta: share of pairs with x above y less those below, from mean ranks of both samples together."""
    g = ["metric", "a", "b"]
    both = pairs.select(*g, F.explode(F.array(F.struct(F.lit(True).alias("first"), F.col("x").alias("v")), F.struct(F.lit(False).alias("first"), F.col("y").alias("v")))).alias("s")).select(*g, "s.*")
    r = both.withColumn("r", F.rank().over(Window.partitionBy(*g).orderBy("v")) + (F.count(F.lit(1)).over(Window.partitionBy(*g, "v")) - 1) / 2)
    s = r.groupBy(*g).agg(F.sum(F.when(F.col("first"), F.col("r"))).alias("w"), F.count_if("first").alias("n"), F.count_if(~F.col("first")).alias("m"))
    u = F.col("w") - F.col("n") * (F.col("n") + 1) / 2
    return s.select(*g, F.round(2 * u / (F.col("n") * F.col("m")) - 1, 9).alias("delta"))


def wilcoxon_p(d: np.ndarray, alternative: str = "two-sided", exact_up_to: int = 50) -> tuple[float, float]:
    """Statistic and p of the signed-rank test, zeros left out: exact without ties up to ``exact_up_to``, else normal with tie correction.

    The statistic is the smaller rank sum for two sides, else the sum of positive ranks. No differences: (0, 1).
    """
    d = d[d != 0]
    n = len(d)
    if not n:
        return 0.0, 1.0
    m = np.abs(d)
    values, inverse, counts = np.unique(m, return_inverse=True, return_counts=True)
    last = np.cumsum(counts)
    ranks = (last - (counts - 1) / 2)[inverse]
    plus = float(ranks[d > 0].sum())
    minus = n * (n + 1) / 2 - plus
    if n <= exact_up_to and len(values) == n:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        ways /= 2.0**n
        below, above = float(ways[: int(plus) + 1].sum()), float(ways[int(plus) :].sum())
        p = {"two-sided": min(1.0, 2 * min(below, above)), "greater": above, "less": below}[alternative]
    else:
        sd = math.sqrt((n * (n + 1) * (2 * n + 1) - ((counts**3 - counts).sum()) / 2) / 24)
        z = (plus - n * (n + 1) / 4) / sd if sd else 0.0
        upper = 0.5 * math.erfc(z / math.sqrt(2))
        p = {"two-sided": min(1.0, 2 * min(upper, 1 - upper)), "greater": upper, "less": 1 - upper}[alternative]
    return (min(plus, minus) if alternative == "two-sided" else plus), float(p)


def bootstrap_interval(d: np.ndarray, resamples: int = RESAMPLES, seed: int = SEED, level: float = 0.95) -> tuple[float, float]:
    """Percentile interval of the mean; the same value twice where all differences agree, NaN without any."""
    if not len(d):
        return float("nan"), float("nan")
    if np.allclose(d, d[0]):
        return float(d[0]), float(d[0])
    at = np.random.default_rng(seed).integers(0, len(d), (resamples, len(d)))
    lo, hi = np.percentile(d[at].mean(axis=1), [50 * (1 - level), 100 - 50 * (1 - level)])
    return float(lo), float(hi)


def tested(pairs: DataFrame, alternative: str = "two-sided", resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """metric, a, b, statistic, p_value, ci_low, ci_high. One group is one pair of conditions: as many rows as queries they share."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("query_id")
        d = (g.x - g.y).to_numpy(np.float64)
        stat, p = wilcoxon_p(np.round(d, 12), alternative)
        lo, hi = bootstrap_interval(d, resamples, seed)
        return pd.DataFrame({"metric": [g.metric.iloc[0]], "a": [g.a.iloc[0]], "b": [g.b.iloc[0]], "statistic": [stat], "p_value": [p], "ci_low": [lo], "ci_high": [hi]})

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    return pairs.groupBy("metric", "a", "b").applyInPandas(one, f"metric {kinds['metric']}, a {kinds['a']}, b {kinds['b']}, statistic double, p_value double, ci_low double, ci_high double")


def holm(tests: DataFrame, p: str = "p_value", family: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """p_adjusted by the step-down method of Holm within a family; ties keep ``order``. Null p: null; p outside [0, 1] is an error."""
    part = Window.partitionBy(*(family or [F.lit(0)]))
    by = part.orderBy(F.col(p).asc_nulls_last(), *(order or []))
    checked = F.when(F.col(p).between(0, 1) | F.col(p).isNull(), F.col(p)).otherwise(F.raise_error(F.lit("p-values must lie in [0, 1]")).cast("double"))
    step = tests.withColumn("_p", checked).withColumn("_m", F.count("_p").over(part)).withColumn("_i", F.row_number().over(by))
    run = F.max((F.col("_m") - F.col("_i") + 1) * F.col("_p")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return step.withColumn("p_adjusted", F.when(F.col("_p").isNotNull(), F.least(F.lit(1.0), run))).drop("_p", "_m", "_i")


def effect_label(delta):
    """Bands of the effect size (fixed values 0.147, 0.33, 0.474)."""
    d = F.abs(delta)
    return F.when(d < 0.147, "negligible").when(d < 0.33, "small").when(d < 0.474, "medium").otherwise("large")


def compared(scores: DataFrame, baseline: str | None = None, alpha: float = 0.05, resamples: int = RESAMPLES) -> DataFrame:
    """All of the above per pair, with p adjusted in one family per metric, significance and an effect label."""
    pairs = paired(scores, baseline)
    g = ["metric", "a", "b"]
    out = described(pairs).join(tested(pairs, resamples=resamples), g).join(cliffs_delta(pairs), g)
    out = holm(out, family=["metric"], order=["a", "b"])
    return out.withColumn("significant", F.col("p_adjusted") < alpha).withColumn("effect", effect_label(F.col("delta")))


def common_queries(scores: DataFrame) -> DataFrame:
    """query_id of queries that every condition has."""
    n = scores.agg(F.countDistinct("condition").alias("all"))
    per = scores.groupBy("query_id").agg(F.countDistinct("condition").alias("n"))
    return per.crossJoin(F.broadcast(n)).where("n = all").select("query_id")  # one row


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Non-negative least squares from the normal equations a = X'X, b = X'y, by active sets."""
    n = len(b)
    x, passive = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        w = b - a @ x
        w[passive] = -np.inf
        if passive.all() or w.max() <= 1e-10:
            break
        passive[int(w.argmax())] = True
        while True:
            s = np.zeros(n)
            s[passive] = np.linalg.lstsq(a[np.ix_(passive, passive)], b[passive], rcond=None)[0]
            if (s[passive] > 0).all():
                x = s
                break
            low = passive & (s <= 0)
            step = np.min(x[low] / (x[low] - s[low]))
            x = x + step * (s - x)
            passive &= x > 1e-12
            x[~passive] = 0
            if not passive.any():
                break
    return x


def fitted_weights(rows: DataFrame, names: list[str], target: str) -> dict:
    """weights (sum 1), r_squared, n: ``target`` on the columns ``names`` by non-negative least squares.

    The products are sums over all rows in one pass; only their square matrix of len(names) comes to the driver. Refused
    (weights None) with no more rows than names. Rows with a null are left out.
    """
    clean = rows.select(*[F.col(c).cast("double") for c in names], F.col(target).cast("double").alias("_y")).dropna()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    got = clean.agg(
        F.count(F.lit(1)), F.sum("_y"), F.sum(F.col("_y") * F.col("_y")), *[F.sum(F.col(c) * F.col("_y")) for c in names], *[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs]
    ).first()
    n = got[0]
    if n <= len(names):
        return {"weights": None, "r_squared": None, "n": n}
    b = np.array(got[3 : 3 + len(names)], float)
    a = np.zeros((len(names), len(names)))
    for (i, j), v in zip(pairs, got[3 + len(names) :]):
        a[i, j] = a[j, i] = v
    x = nnls(a, b)
    total = got[2] - got[1] ** 2 / n
    rest = got[2] - 2 * x @ b + x @ a @ x
    s = x.sum()
    return {"weights": dict(zip(names, x / s if s > 0 else np.full(len(names), 1 / len(names)))), "r_squared": float(1 - rest / total) if total > 1e-15 else None, "n": n}


def correlations(rows: DataFrame, names: list[str]) -> DataFrame:
    """a, b, r for each pair of columns (a before b); NaN where one is constant."""
    cols = []
    for i, x in enumerate(names):
        for y in names[i + 1 :]:
            r = F.when((F.coalesce(F.var_pop(x), F.lit(0.0)) < 1e-15) | (F.coalesce(F.var_pop(y), F.lit(0.0)) < 1e-15), float("nan")).otherwise(F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y))))
            cols.append(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.round(r, 9).alias("r")))
    return rows.agg(F.array(*cols).alias("c")).select(F.explode("c").alias("c")).select("c.*")
