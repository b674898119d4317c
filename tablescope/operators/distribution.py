"""Shape of numeric features: moments, normality, skew labels."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.schema import num, numeric_columns
from tablescope.functions.stats import (adjusted_kurtosis, adjusted_skewness, jarque_bera_p, rounded)
from tablescope.functions.wide import long_form, per_column
from tablescope.sources.sampling import deterministic_sample

# The published limits of the audit.
MIN_VALUES = 8
P_NORMAL = 0.05
MILD_SKEW, HIGH_SKEW = 0.5, 1.5
NORMALITY_SAMPLE = 500


def shape_label(skew: Column) -> Column:
    """Skew of exactly 0.5 and of -1.5 both count as mildly left-skewed."""
    return (F.when(F.abs(skew) < MILD_SKEW, "Normal / Symmetric")
            .when(skew > HIGH_SKEW, "Highly Right-Skewed")
            .when(skew > MILD_SKEW, "Mildly Right-Skewed")
            .when(skew < -HIGH_SKEW, "Highly Left-Skewed")
            .otherwise("Mildly Left-Skewed"))


def transform_hint(skew: Column, lowest: Column) -> Column:
    return (F.when((F.abs(skew) > HIGH_SKEW) & (lowest > 0), "log1p")
            .when(F.abs(skew) > MILD_SKEW, "sqrt or Box-Cox").otherwise("none"))


def distributions(df: DataFrame, target: str | None = None,
                  max_columns: int | None = None) -> DataFrame:
    """Moments, whole-column normality test, shape and transform per numeric feature.

    One pass over the needed columns for everything.
    """
    def build(c: str) -> dict[str, Column]:
        v = num(c)
        return {"n": F.count(v), "_mean": F.avg(v), "_std": F.stddev(v), "_min": F.min(v),
                "_max": F.max(v), "_g1": F.skewness(v), "_g2": F.kurtosis(v)}
    n, g1, g2 = F.col("n"), F.col("_g1"), F.col("_g2")
    stats = per_column(df, numeric_columns(df, target)[:max_columns], build).select(
        "*", adjusted_skewness(n, g1).alias("_skew"), adjusted_kurtosis(n, g2).alias("_kurt"),
        jarque_bera_p(n, g1, g2).alias("_p"))
    return stats.filter(F.col("n") >= MIN_VALUES).select(
        "feature", "n", rounded(F.col("_mean"), 4).alias("mean"),
        rounded(F.col("_std"), 4).alias("std"), rounded(F.col("_min"), 4).alias("min"),
        rounded(F.col("_max"), 4).alias("max"), rounded(F.col("_skew"), 3).alias("skewness"),
        rounded(F.col("_kurt"), 3).alias("kurtosis"), rounded(F.col("_p"), 4).alias("p_normal"),
        (F.col("_p") > P_NORMAL).alias("is_normal"), shape_label(F.col("_skew")).alias("shape"),
        transform_hint(F.col("_skew"), F.col("_min")).alias("transform"))


def skewed_features(df: DataFrame, target: str | None = None, threshold: float = 1.0,
                    positive_only: bool = False, k: int | None = None) -> DataFrame:
    """Features whose rounded skew is beyond the threshold, in schema order."""
    found = distributions(df, target).filter(F.abs("skewness") > threshold)
    if positive_only:
        found = found.filter(F.col("min") > 0)
    found = found.select("feature", "skewness")
    if k is None:
        return found
    order = F.array_position(F.array(*[F.lit(c) for c in numeric_columns(df, target)]), F.col("feature"))
    return found.orderBy(order).limit(k)


def distribution_summary(df: DataFrame, target: str | None = None) -> DataFrame:
    return distributions(df, target).agg(
        F.count(F.lit(1)).alias("features_analysed"),
        F.count_if(F.abs("skewness") > 1).alias("n_skewed"),
        F.count_if(~F.col("is_normal")).alias("n_not_normal"))


def normality_sample(df: DataFrame, key: str, target: str | None = None,
                     n: int = NORMALITY_SAMPLE) -> DataFrame:
    """Shapiro-Wilk test on a declared sample of `n` rows, features in parallel.

    The whole-column test of `distributions` is the one to rely on; this one is
    the classical small-sample test.
    """
    names = numeric_columns(df, target)
    sample = deterministic_sample(df, n, key)
    rows = long_form(sample, {c: num(c) for c in names}).filter("value is not null")

    def test(values: pd.DataFrame) -> pd.DataFrame:
        x = values["value"].to_numpy(float)
        if len(x) < MIN_VALUES:
            return pd.DataFrame({"feature": [], "n": [], "w": [], "p_normal": [], "is_normal": []})
        w, p = shapiro_wilk(x)
        return pd.DataFrame({"feature": values["feature"].iloc[:1], "n": [len(x)], "w": [round(w, 4)],
                             "p_normal": [round(p, 4)], "is_normal": [bool(p > P_NORMAL)]})
    return rows.groupBy("feature").applyInPandas(
        test, "feature string, n bigint, w double, p_normal double, is_normal boolean")


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """W and p by Royston's approximation (1995), for 8 to 5000 values."""
    from statistics import NormalDist
    normal = NormalDist()
    x = np.sort(np.asarray(x, float))
    n = len(x)
    if x[0] == x[-1]:
        return 1.0, 1.0
    m = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ssq = float(m @ m)
    u = 1 / np.sqrt(n)
    # Royston's polynomial coefficients.
    last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m[-1] / np.sqrt(ssq)], u)
    prev = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / np.sqrt(ssq)], u)
    phi = (ssq - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last ** 2 - 2 * prev ** 2)
    a = m / np.sqrt(phi)
    a[-1], a[-2], a[0], a[1] = last, prev, -last, -prev
    d = x - x.mean()
    w = min(1.0, float((a @ x) ** 2 / (d @ d)))
    y = np.log(max(1 - w, 1e-300))
    if n <= 11:
        gamma = 0.459 * n - 2.273
        if y >= gamma:
            return w, 0.0
        y = -np.log(gamma - y)
        mean = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sd = np.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        ln = np.log(n)
        mean = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln)
        sd = np.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return w, float(1 - normal.cdf((y - mean) / sd))
