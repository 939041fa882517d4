"""Statistics: running minimum, Benjamini-Hochberg, empirical and early-stopped p-values, exact AUC,
exact binomial tails, odds ratios and the knee of a curve."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telospark.sources.scratch import cut

EARLY_STOP = 100


def _window(by: list[str] | None):
    return Window.partitionBy(*by) if by else Window.partitionBy()


def running_minimum(df: DataFrame, value: str, order: list, out: str, by: list[str] | None = None) -> DataFrame:
    return df.withColumn(out, F.min(value).over(_window(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def ranged(df: DataFrame, *order) -> DataFrame:
    """df dealt by ranges of an order, with _part, the number of a row's range; computed when this
    returns. Rows equal in the order are in one range."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))


def before_ranges(df: DataFrame, value: str, total: str, out: str) -> DataFrame:
    """_part, and the sum of a column in all earlier ranges (out) and in all (total): a row per range."""
    sums = df.groupBy("_part").agg(F.sum(value).alias("_s"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_part", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias(out), F.sum("_s").over(Window.partitionBy()).alias(total))


def bh_fdr(df: DataFrame, p: str = "pvalue", out: str = "qvalue", by: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg q-values over all rows, or within groups. NaN stays NaN and counts in n;
    null stays null and doesn't.

    Equal p-values have one q-value, so the ranks and the running minimum are taken over distinct
    p-values, one row for each. Without groups these are dealt by ranges of p: a range takes its
    first rank from the counts of those before it, and the least value of those behind it as the
    limit of its own minimum, so no task sees all.
    """
    keys = list(by or [])
    counts = df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count("*").alias("_c"))
    if by:
        w = Window.partitionBy(*by).orderBy(F.col(p))
        x = counts.withColumns({"_rank": F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_total": F.sum("_c").over(Window.partitionBy(*by)), "_later": F.lit(None).cast("double")})
    else:
        parts = ranged(counts, F.col(p))
        w = Window.partitionBy("_part").orderBy(F.col(p))
        x = parts.join(F.broadcast(before_ranges(parts, "_c", "_total", "_base")), "_part")
        x = x.withColumn("_rank", F.col("_base") + F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("_v", F.when(~F.isnan(p), F.col(p) * F.col("_total") / F.col("_rank")))
    if not by:
        behind = Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)  # over one row per range
        later = x.groupBy("_part").agg(F.min("_v").alias("_low")).select("_part", F.min("_low").over(behind).alias("_later"))
        x = x.join(F.broadcast(later), "_part")
    low = F.least(F.min("_v").over(w.rowsBetween(0, Window.unboundedFollowing)), F.col("_later"), F.lit(1.0))
    q = x.withColumn(out, F.when(F.isnan(p), F.lit(float("nan"))).otherwise(low)).select(*keys, F.col(p).alias("_p"), out)
    names = [c for c in df.columns if c != out]
    same = df[p] == q["_p"]
    for k in keys:
        same = same & df[k].eqNullSafe(q[k])
    return df.join(q, same, "left").select(*(df[c] for c in names), q[out])


def bonferroni(p: Column, n: Column | int, capped: bool = True) -> Column:
    x = p * n
    return F.when(F.isnan(x), x).otherwise(F.least(x, F.lit(1.0))) if capped else x


def empirical_pvalue(df: DataFrame, hit: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.col(hit).cast("int")).alias("pvalue"))


def early_stopped_pvalue(df: DataFrame, hit: str, sim: str, by: list[str], limit: int = EARLY_STOP) -> DataFrame:
    """p as if simulations ran one by one in order of `sim` (from 0, gapless) and stopped at the
    limit-th hit: hits / simulations run."""
    w = Window.partitionBy(*by).orderBy(sim).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_h", F.col(hit).cast("int")).withColumn("_cum", F.sum("_h").over(w)).withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(sim)))
    out = df.groupBy(*by).agg(F.sum("_h").alias("_hits"), F.coalesce(F.min(F.when(F.col("_cum") >= limit, F.col("_i"))), F.count("*")).alias("n_sims"))
    return out.withColumn("pvalue", F.least(F.col("_hits"), F.lit(limit)) / F.col("n_sims")).drop("_hits")


def roc_auc(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Exact area under the ROC curve with ties at a half; null for one class. Rows are first
    summed by score; without groups, distinct scores are dealt by ranges."""
    keys = list(by or [])
    each = df.groupBy(*keys, score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_p"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("_n"))
    base = F.lit(0)
    if not by:
        each = ranged(each, score)
        each = each.join(F.broadcast(before_ranges(each, "_n", "_all", "_base")), "_part")
        base = F.col("_base")
    w = Window.partitionBy(*(by or ["_part"])).orderBy(score)
    below = base + F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumn("_wins", F.col("_p") * (below + F.col("_n") / 2))
    area = F.try_divide(F.sum("_wins"), F.sum("_p").cast("double") * F.sum("_n"))
    return (each.groupBy(*keys) if keys else each).agg(area.alias("auc"))


def log2_odds(hits: Column, total: Column, base_hits: Column, base_total: Column) -> Column:
    """log2 of the odds ratio, with infinities and NaN instead of nulls."""
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b != 0, a / F.when(b != 0, b)).when(a > 0, inf).when(a < 0, -inf).otherwise(nan)

    x = ratio(ratio(hits, total - hits), ratio(base_hits, base_total - base_hits))
    return F.when(x == 0, -inf).when(F.isnan(x) | (x < 0), nan).when(x == inf, inf).otherwise(F.log2(x))


def _stirling_error(n: np.ndarray) -> np.ndarray:
    """log n! less Stirling's formula, for n >= 1."""
    few = np.array([0.0] + [math.lgamma(i + 1) - (i + 0.5) * math.log(i) + i - 0.5 * math.log(2 * math.pi) for i in range(1, 17)])
    x = np.maximum(n, 1.0)
    y = 1 / (x * x)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - y / 1188) * y) * y) * y) / x
    return np.where(n <= 16, few[np.minimum(n, 16).astype(int)], series)


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x log(x / mean) + mean - x without cancellation where they are close."""
    v = (x - mean) / (x + mean)
    series, term = (x - mean) * v, 2 * x * v
    for j in range(1, 30):  # |v| < 0.1
        term = term * v * v
        series = series + term / (2 * j + 1)
    far = x * np.log(x / mean) + mean - x
    return np.where(np.abs(v) < 0.1, series, far)


def _binomial_term(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X = k), 0 < p < 1, by the saddle point: no difference of large logarithms."""
    inner = (k > 0) & (k < n)
    a, b = np.where(inner, k, 1.0), np.where(inner, n - k, 1.0)
    m = a + b
    log = _stirling_error(m) - _stirling_error(a) - _stirling_error(b) - _deviance(a, m * p) - _deviance(b, m * (1 - p))
    edge = np.where(k == 0, n * np.log1p(-p), n * np.log(p))
    return np.where(inner, np.exp(log) * np.sqrt(m / (2 * np.pi * a * b)), np.exp(edge))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, limit: int = 20_000) -> np.ndarray:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, limit):
        before = h
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + up * d, 1 + up / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if (np.abs(h - before) <= 1e-15 * np.abs(h)).all():
            return h
    raise RuntimeError("the continued fraction did not settle")


def tails(k, n, p) -> np.ndarray:
    """P(X >= k) for X ~ Binomial(n, p), elementwise: the incomplete beta function I_p(k, n - k + 1) on
    the side where its fraction settles fast, 1 less the other side's elsewhere. Relative error
    below 1e-11 for n to tens of thousands."""
    k, n, p = (np.asarray(x, np.float64) for x in (k, n, p))
    inside = (k >= 1) & (k <= n) & (p > 0) & (p < 1)
    out = np.where(k <= 0, 1.0, np.where((k > n) | (p <= 0), 0.0, 1.0))
    if inside.any():
        k, n, p = k[inside], n[inside], p[inside]
        flip = k <= n * p
        kk, q = np.where(flip, n - k + 1, k), np.where(flip, 1 - p, p)
        # P(Y >= kk), Y ~ Binomial(n, q)
        mass = _binomial_term(kk, n, q) * (1 - q) * _beta_fraction(kk, n - kk + 1, q)
        out[inside] = np.clip(np.where(flip, 1 - mass, mass), 0.0, 1.0)
    return out


def tail(k: int, n: int, p: float) -> float:
    """One value of tails()."""
    return float(tails([k], [n], [p])[0])


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """Exact one-sided binomial test ('greater'); equal inputs are computed once a batch."""

    @F.pandas_udf("double")
    def run(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        given = np.stack([x.to_numpy(np.float64, na_value=np.nan) for x in (k, n, p)], axis=1)
        known = ~np.isnan(given).any(axis=1)
        out = np.full(len(given), np.nan)
        if known.any():
            distinct, which = np.unique(given[known], axis=0, return_inverse=True)
            out[known] = tails(*distinct.T)[which.ravel()]
        return pd.Series(out)

    return run(k.cast("long"), n.cast("long"), p.cast("double"))


def knee(x: list[float], y: list[float], sensitivity: float = 1.0) -> float | None:
    """Knee of a convex, decreasing curve by Kneedle (Satopaa et al. 2011); null if there is none.
    For a few hundred points on the driver."""
    n = len(x)
    if n < 3 or max(x) == min(x) or max(y) == min(y):
        return None
    order = sorted(range(n), key=lambda i: x[i])
    xs = [(x[i] - min(x)) / (max(x) - min(x)) for i in order]
    ys = [(y[i] - min(y)) / (max(y) - min(y)) for i in order]
    d = [(max(ys) - b) - a for a, b in zip(xs, ys)]
    step = sensitivity * sum(b - a for a, b in zip(xs, xs[1:])) / (n - 1)
    peak = None
    for i in range(1, n):
        if i < n - 1 and d[i - 1] <= d[i] >= d[i + 1] and (d[i - 1] < d[i] or d[i] > d[i + 1]):
            peak = i
        if peak is not None and i > peak and d[i] < d[peak] - step:
            return x[order[peak]]
    return None
