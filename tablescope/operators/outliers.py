"""Rows that are unusual in the combination of their features."""

import math
from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.schema import num, numeric_columns, quoted
from tablescope.functions.stats import relative_shift_pct, rounded
from tablescope.functions.wide import per_column
from tablescope.operators.comoments import matrix
from tablescope.operators.profile import iqr_outliers
from tablescope.operators.quantiles import quantiles

# The published limits of the audit.
CONTAMINATION = 0.05
DRIVER_SHIFT_PCT = 50
TOP_SCORES = 20
CLEAN_PCT, MODERATE_PCT = 3, 8


def chi_square_quantile(p: float, df: int) -> float:
    """Wilson-Hilferty approximation."""
    from statistics import NormalDist
    z = NormalDist().inv_cdf(p)
    return df * (1 - 2 / (9 * df) + z * math.sqrt(2 / (9 * df))) ** 3


def median_filled(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """`keep` as it is, and double columns with gaps replaced by the median; columns without a value are left out."""
    medians = quantiles(df, names, [0.5])
    return df.select(*[F.col(quoted(c)) for c in keep], *[F.coalesce(num(c), F.lit(medians[c][0])).alias(c)
                       for c in names if medians[c][0] is not None])


def _location_scatter(df: DataFrame, keep: Column | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean vector, sample covariance and number of the kept rows, in one pass whatever the number of features."""
    names = df.columns
    found = matrix(df if keep is None else df.filter(keep), names, {c: F.col(quoted(c)) for c in names})
    if found is None:
        return np.zeros(len(names)), np.zeros((len(names), len(names))), 0
    n, mean, _, cm = found
    rows = int(n[0, 0])
    return np.diag(mean).copy(), cm / max(rows - 1, 1), rows


def _correlation(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Covariance as correlations, and the deviations (1 where a feature is constant)."""
    scale = np.sqrt(np.clip(np.diag(cov), 0, None))
    scale[scale == 0] = 1.0
    return cov / np.outer(scale, scale), scale


def _squared_distance(names: Sequence[str], mean: np.ndarray, cov: np.ndarray) -> Column:
    """Squared Mahalanobis distance as one column expression.

    The inverse is taken of the correlations, as features of very different size would cost it its digits.
    """
    unit, scale = _correlation(cov)
    inverse = np.linalg.pinv(unit, rcond=1e-12, hermitian=True)
    w, v = np.linalg.eigh((inverse + inverse.T) / 2)
    root = (v * np.sqrt(np.clip(w, 0, None))).T / scale     # d2 = |root (x - mean)|^2
    z = [F.col(c) - F.lit(float(m)) for c, m in zip(names, mean)]
    if len(names) <= 40:
        parts = [reduce(add, [F.lit(float(a)) * x for a, x in zip(line, z)]) for line in root]
        return reduce(add, [p * p for p in parts])
    lines = F.array(*[F.array(*[F.lit(float(a)) for a in line]) for line in root])
    dot = lambda line: F.aggregate(F.zip_with(line, F.array(*z), lambda a, b: a * b),
                                   F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(F.transform(lines, dot), F.lit(0.0), lambda s, x: s + x * x)


def _medians(filled: DataFrame, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Medians, and squared median deviations (the variance where that is zero) as a diagonal scatter."""
    names = filled.columns
    mid = quantiles(filled, names, [0.5])
    off = quantiles(filled, names, [0.5], columns={c: F.abs(num(c) - F.lit(mid[c][0])) for c in names})
    spread = [(1.4826 * off[c][0]) ** 2 or cov[i, i] for i, c in enumerate(names)]
    return np.array([mid[c][0] for c in names]), np.diag(spread)


def robust_location_scatter(filled: DataFrame, steps: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Minimum covariance determinant by concentration steps over all rows.

    Each step scores every row, keeps the closer half (by a sketched median, as any
    half near it leads on) and estimates again; only the p * p moments come to the
    driver. The start is the medians and median deviations of the features, which a
    far cluster of nearly half the rows does not hold. Ends with the usual consistency factor and
    one reweighting at the 97.5 % chi-square point.
    """
    names = filled.columns
    p = len(names)
    mean, cov, n = _location_scatter(filled)
    if not n:
        return mean, cov
    half = (n + p + 1) // 2
    mean, cov = _medians(filled, cov)
    last = math.inf
    for _ in range(steps):
        d2 = _squared_distance(names, mean, cov)
        cutoff = filled.agg(F.percentile_approx(d2, half / n, 100_000)).first()[0]
        mean, cov, _ = _location_scatter(filled, d2 <= cutoff)
        size = np.linalg.slogdet(cov)[1] if np.linalg.matrix_rank(_correlation(cov)[0]) == p else -math.inf
        if size >= last - 1e-3 or size == -math.inf:
            break
        last = size
    d2 = _squared_distance(names, mean, cov)
    median = quantiles(filled, ["d2"], [0.5], columns={"d2": d2})["d2"][0]
    cov = cov * (median / chi_square_quantile(0.5, p)) if median else cov
    mean, cov, _ = _location_scatter(
        filled, _squared_distance(names, mean, cov) < chi_square_quantile(0.975, p))
    return mean, cov


def mahalanobis_scores(df: DataFrame, target: str | None = None, robust: bool = True,
                       features: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The columns of `keep` (which are no features), median-filled features and `d2`, the squared distance of every row from the centre.

    No row cap: the centre and scatter are aggregates, the distance an expression.
    Runs Spark jobs. Needs at least two numeric features.
    """
    names = [c for c in features or numeric_columns(df, target) if c not in keep]
    scored = median_filled(df, names, keep)
    filled = scored.select([F.col(quoted(c)) for c in scored.columns[len(keep):]])
    if len(filled.columns) < 2:
        raise ValueError("need at least 2 numeric features")
    if robust:
        filled.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            mean, cov = robust_location_scatter(filled)
        finally:
            filled.unpersist()
    else:
        mean, cov, _ = _location_scatter(filled)
    return scored.withColumn("d2", _squared_distance(filled.columns, mean, cov))


def flag_outliers(scores: DataFrame, contamination: float | None = CONTAMINATION,
                  keep: Sequence[str] = ()) -> DataFrame:
    """Add `is_outlier`: the given share with the largest distance.

    `contamination=None` cuts at the 97.5 % chi-square point instead, which makes the
    share itself informative.
    """
    if contamination is None:
        cut = chi_square_quantile(0.975, len(scores.columns) - len(keep) - 1)
    else:
        cut = quantiles(scores, ["d2"], [1 - contamination])["d2"][0]
    if cut is None:
        return scores.withColumn("is_outlier", F.lit(False))
    return scores.withColumn("is_outlier", F.col("d2") > F.lit(float(cut)))


def outlier_rows(df: DataFrame, target: str | None = None, robust: bool = True,
                 contamination: float | None = CONTAMINATION,
                 features: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Every row with its features, distance and flag, found again by the columns of `keep`."""
    return flag_outliers(mahalanobis_scores(df, target, robust, features, keep), contamination, keep)


def outlier_drivers(flagged: DataFrame, max_columns: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Mean of outlying against normal rows, per feature of a frame from `outlier_rows`."""
    names = [c for c in flagged.columns if c not in ("d2", "is_outlier", *keep)][:max_columns]

    def build(c: str) -> dict[str, Column]:
        return {"o": F.coalesce(F.avg(F.when(F.col("is_outlier"), num(c))), F.lit(0.0)),
                "n": F.coalesce(F.avg(F.when(~F.col("is_outlier"), num(c))), F.lit(0.0))}
    shift = relative_shift_pct(F.col("n"), F.col("o"))
    return per_column(flagged, names, build).select(
        "feature", rounded(F.col("o"), 4).alias("outlier_mean"),
        rounded(F.col("n"), 4).alias("normal_mean"), rounded(shift, 1).alias("shift_pct"),
        (shift > DRIVER_SHIFT_PCT).alias("major_driver"))


def top_scores(scores: DataFrame, k: int = TOP_SCORES, keep: Sequence[str] = ()) -> DataFrame:
    """The `k` largest distances, with the columns of `keep`, which also settle ties."""
    kept = [F.col(quoted(c)) for c in keep]
    return scores.orderBy(F.col("d2").desc(), *kept).limit(k).select(*kept, rounded(F.col("d2"), 4).alias("d2"))


def outlier_summary(df: DataFrame, target: str | None = None, robust: bool = True,
                    contamination: float | None = CONTAMINATION,
                    features: Sequence[str] | None = None) -> DataFrame:
    """One row: outlying rows, their share and verdict, leading features, quartile comparison."""
    flagged = outlier_rows(df, target, robust, contamination, features)
    counts = flagged.agg(F.count_if(F.col("is_outlier")).alias("n_outliers"),
                         rounded(F.count_if(F.col("is_outlier")) / F.greatest(
                             F.count(F.lit(1)), F.lit(1)) * 100, 1).alias("pct_outliers"))
    lead = outlier_drivers(flagged).filter("major_driver").orderBy(
        F.col("shift_pct").desc(), "feature").limit(3)
    names = lead.agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct((-F.col("shift_pct")).alias("s"), "feature"))), lambda x: x["feature"]), ",")
        .alias("top_drivers"))
    columns = df.select(*[F.col(f"`{c}`") for c in features]) if features else df
    single = iqr_outliers(columns, target).agg(F.count(F.lit(1)).alias("n_iqr_columns"))
    return counts.crossJoin(names).crossJoin(single).withColumn(    # one row each
        "verdict", F.when(F.col("pct_outliers") < CLEAN_PCT, "clean")
        .when(F.col("pct_outliers") < MODERATE_PCT, "moderate").otherwise("significant"))
