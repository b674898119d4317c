"""Correlation, redundancy, variance inflation, leakage and mutual information."""

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions.schema import is_numeric, num, numeric_columns
from tablescope.functions.stats import (EPS, corr_of_parts, corr_parts, correlation_label, label, rounded,
                                        vif_label)
from tablescope.functions.wide import long_form, per_column
from tablescope.functions.workers import ship
from tablescope.operators.comoments import comoments, correlation_of
from tablescope.operators.quantiles import quantiles
from tablescope.sources.sampling import deterministic_sample

# The published limits of the audit.
REDUNDANT, REDUNDANT_HIGH = 0.85, 0.95
LEAK_WARNING, LEAK_CANDIDATE = 0.85, 0.95
LEAK_BANDS = ((0.85, "CRITICAL"), (0.70, "HIGH"), (0.50, "MODERATE"), (0.30, "LOW"))

def correlation_pairs(df: DataFrame, names: Sequence[str], listwise: bool = True) -> DataFrame:
    """`(i, j, feature_1, feature_2, corr)` for i <= j, unrounded.

    `listwise` uses only rows complete over all `names` (all-missing columns set
    aside, which one small job finds); otherwise each pair uses its own complete rows. One pass
    for all pairs. A table without rows has no pairs.
    """
    if listwise:
        df, names, _ = _complete_rows(df, names)
    if not names:
        return df.sparkSession.createDataFrame(
            [], "i int, j int, feature_1 string, feature_2 string, corr double")
    all_names = F.array(*[F.lit(c) for c in names])
    pairs = comoments(df, {c: num(c) for c in names}, [names])
    return pairs.select(F.explode("pairs").alias("p")).select(
        "p.i", "p.j", F.element_at(all_names, F.col("p.i") + 1).alias("feature_1"),
        F.element_at(all_names, F.col("p.j") + 1).alias("feature_2"), correlation_of(F.col("p")).alias("corr"))


def _complete_rows(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    """Rows complete over the columns that have any value (one small job to find them)."""
    if not names:
        return df, [], []
    seen = df.agg(*[F.max(num(c).isNotNull()).alias(f"c{i}") for i, c in enumerate(names)]).first()
    full = [c for i, c in enumerate(names) if seen[i]]
    rows = df.select(*[num(c).alias(c) for c in full])
    return rows.dropna(), full, [c for c in names if c not in full]


def correlation_matrix(df: DataFrame, target: str | None = None, listwise: bool = True) -> DataFrame:
    """All ordered feature pairs with their correlation, rounded to 4 digits."""
    pairs = correlation_pairs(df, numeric_columns(df, target), listwise)
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("feature_1", "feature_2", "corr"))) \
        .otherwise(F.array(F.struct("feature_1", "feature_2", "corr"),
                           F.struct(F.col("feature_2").alias("feature_1"),
                                    F.col("feature_1").alias("feature_2"), "corr")))
    return pairs.select(F.inline(both)).withColumn("corr", rounded(F.col("corr"), 4))


def _redundant(df: DataFrame, target: str | None) -> DataFrame:
    pairs = correlation_pairs(df, numeric_columns(df, target)).filter("i < j")
    pairs = pairs.withColumn("correlation", F.abs(F.round("corr", 4)))
    return pairs.filter(F.col("correlation") >= REDUNDANT).withColumn(
        "severity", F.when(F.col("correlation") >= REDUNDANT_HIGH, "HIGH").otherwise("MODERATE"))


def redundant_pairs(df: DataFrame, target: str | None = None, k: int | None = 20) -> DataFrame:
    """The `k` strongest feature pairs, all for None, at or above 0.85 (compared after rounding)."""
    pairs = _redundant(df, target)
    if k is not None:
        pairs = pairs.orderBy(F.col("correlation").desc(), "i", "j").limit(k)
    return pairs.select("feature_1", "feature_2", "correlation", "severity")


def drop_suggestions(df: DataFrame, target: str | None = None) -> DataFrame:
    """The later feature of every pair at or above 0.95, also beyond the pairs reported."""
    return (_redundant(df, target).filter(F.col("correlation") >= REDUNDANT_HIGH)
            .select(F.col("feature_2").alias("feature")).distinct())


def corr_pairs_gt(df: DataFrame, threshold: float = 0.9, target: str | None = None) -> DataFrame:
    """Pairs whose unrounded absolute correlation (pairwise rows) is beyond the threshold."""
    pairs = correlation_pairs(df, numeric_columns(df, target), listwise=False)
    return (pairs.filter("i < j").filter(F.abs("corr") > threshold)
            .select(F.col("feature_2").alias("feature_1"), F.col("feature_1").alias("feature_2"),
                    rounded(F.abs("corr"), 4).alias("abs_corr")))


def vif(df: DataFrame, target: str | None = None, max_columns: int | None = None) -> DataFrame:
    """Variance inflation of the features (the first `max_columns`), each regressed on all other numerics.

    Runs Spark jobs for one correlation matrix; the regressions are solved from it
    on the driver (features squared in size, whatever the number of rows).
    """
    names = numeric_columns(df, target)
    rows, full, _ = _complete_rows(df, names)
    out = []
    if len(full) >= 2 and len(rows.limit(len(full) + 1).take(len(full) + 1)) > len(full):
        p = len(full)
        r = np.zeros((p, p))
        for row in correlation_pairs(df, names).collect():
            r[full.index(row.feature_1), full.index(row.feature_2)] = row.corr or 0.0
        r = r + np.triu(r, 1).T
        constant = [j for j in range(p) if r[j, j] == 0]
        for j in range(p)[:max_columns]:
            others = [k for k in range(p) if k != j and k not in constant]
            if j in constant:
                r2 = 1.0
            else:
                x = r[np.ix_(others, others)]
                r2 = float(r[j, others] @ np.linalg.pinv(x, rcond=1e-10, hermitian=True) @ r[others, j])
                r2 = 1.0 if 1 - r2 < 1e-10 else max(r2, 0.0)
            out.append((j, full[j], 1 / (1 - r2 + EPS)))
    made = df.sparkSession.createDataFrame(out, "ordinal int, feature string, vif double")
    made = made.withColumn("vif", rounded(F.col("vif"), 2))
    return made.select("feature", "vif", vif_label(F.col("vif")).alias("level"))


def redundancy_summary(df: DataFrame, target: str | None = None) -> DataFrame:
    """Pair count, features to drop, and features with inflation above 5."""
    pairs = _redundant(df, target).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_distinct(F.when(F.col("correlation") >= REDUNDANT_HIGH, F.col("feature_2")))
        .alias("n_drop"))
    inflated = vif(df, target).agg(F.count_if(F.col("vif") > 5).alias("n_vif_above_5"))
    return pairs.crossJoin(inflated)                        # one row each


def leakage_by_correlation(df: DataFrame, target: str) -> DataFrame:
    """Absolute correlation of each numeric feature with a numeric target, and its level."""
    names = numeric_columns(df, target) if is_numeric(df, target) else []
    if not names:
        return df.sparkSession.createDataFrame(
            [], "feature string, abs_corr double, level string, label string")
    corr = per_column(df, names, lambda c: corr_parts(num(c), num(target)))
    corr = corr.withColumn("_c", F.abs(corr_of_parts()))
    return corr.filter("_c is not null").select(
        "feature", rounded(F.col("_c"), 4).alias("abs_corr"),
        label(F.col("_c"), (LEAK_CANDIDATE, "candidate"), (LEAK_WARNING, "warning"), default="ok")
        .alias("level"),
        correlation_label(F.round("_c", 4)).alias("label"))


def leakage_candidates(df: DataFrame, target: str) -> DataFrame:
    return leakage_by_correlation(df, target).filter("level = 'candidate'").select("feature", "abs_corr")


def _mutual_information(df: DataFrame, target: str, bins: int) -> DataFrame:
    """`(feature, mi)` in nats over equal-frequency bins; unrounded."""
    names = numeric_columns(df, target)
    rows = df.filter(num(target).isNotNull())
    cuts = [i / bins for i in range(1, bins)]
    # The medians come from all rows, the edges from the filled columns that are binned.
    has_gaps = df.agg(*[F.coalesce(F.max(num(c).isNull()), F.lit(False)).alias(f"g{i}")
                        for i, c in enumerate(names)]).first() if names else []
    gaps = [c for c, g in zip(names, has_gaps) if g]
    medians = quantiles(df, gaps, [0.5])
    filled = {c: F.coalesce(num(c), F.lit(medians[c][0]).cast("double")) if c in gaps else num(c)
              for c in names}
    usable = [c for c in names if c not in gaps or medians[c][0] is not None]
    edges = quantiles(rows, [*usable, target], cuts, columns={c: filled[c] for c in usable})

    if not usable or edges[target][0] is None:
        return df.sparkSession.createDataFrame([], "feature string, mi double")
    ship(df.sparkSession)
    inner = [np.unique(edges[c]) for c in [target, *usable]]

    def count(parts):
        """How often the bins meet: the number of edges below a value, so bins are closed on the right."""
        found = [np.zeros((len(e) + 1, len(inner[0]) + 1), np.int64) for e in inner[1:]]
        for batch in parts:
            y, *xs = (np.searchsorted(e, batch.column(k).to_numpy(zero_copy_only=False)) for k, e in enumerate(inner))
            for c, x in zip(found, xs):
                c += np.bincount(x * c.shape[1] + y, minlength=c.size).reshape(c.shape)
        for c, n in zip(usable, found):
            x, y = np.nonzero(n)
            yield pa.record_batch([pa.array([c] * len(x), pa.string()), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(n[x, y])],
                                  names=["feature", "x", "y", "c"])

    binned = rows.select(num(target).alias("y"), *[filled[c].alias(f"x{k}") for k, c in enumerate(usable)])
    cells = binned.mapInArrow(count, "feature string, x int, y int, c bigint").groupBy("feature", "x", "y").agg(F.sum("c").alias("c"))
    # From here on at most bins * bins rows per feature.
    by_x, by_y = Window.partitionBy("feature", "x"), Window.partitionBy("feature", "y")
    total = Window.partitionBy("feature")
    cells = (cells.withColumn("n", F.sum("c").over(total).cast("double"))
             .withColumn("cx", F.sum("c").over(by_x).cast("double"))
             .withColumn("cy", F.sum("c").over(by_y).cast("double")))
    return cells.groupBy("feature").agg(
        F.sum(F.col("c") / F.col("n") * F.ln(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy"))))
        .alias("mi"))


def _normalised(mi: DataFrame) -> DataFrame:
    mi = mi.withColumn("mi", F.greatest("mi", F.lit(0.0)))
    return mi.crossJoin(F.broadcast(mi.agg(F.max("mi").alias("_top")))).withColumn(  # one row
        "mi_norm", F.col("mi") / (F.col("_top") + F.lit(EPS))).drop("_top")


def mutual_information(df: DataFrame, target: str, bins: int = 10) -> DataFrame:
    """Mutual information of each numeric feature with a numeric target.

    Equal-frequency bins with exact edges, all rows; missing features are filled
    with their median. Runs Spark jobs for the edges.
    """
    if not is_numeric(df, target):
        return df.sparkSession.createDataFrame([], "feature string, mi double, mi_norm double")
    return _normalised(_mutual_information(df, target, bins)).select(
        "feature", rounded(F.col("mi"), 5).alias("mi"), rounded(F.col("mi_norm"), 4).alias("mi_norm"))


def leakage_probability(df: DataFrame, target: str, bins: int = 10) -> DataFrame:
    """Half normalised mutual information, half absolute correlation, with a risk level."""
    if not is_numeric(df, target) or not numeric_columns(df, target):
        return df.sparkSession.createDataFrame(
            [], "feature string, mi_score double, mi_normalized double, correlation double, "
                "leakage_prob double, risk_level string")
    mi = _normalised(_mutual_information(df, target, bins))
    corr = per_column(df, numeric_columns(df, target), lambda c: corr_parts(num(c), num(target)))
    corr = corr.withColumn("_c", F.coalesce(F.abs(corr_of_parts()), F.lit(0.0)))
    both = corr.join(mi, "feature", "left").withColumn(     # one row per feature on both sides
        "mi", F.coalesce("mi", F.lit(0.0))).withColumn("mi_norm", F.coalesce("mi_norm", F.lit(0.0))).withColumn(
        "leakage_prob", rounded(0.5 * F.col("mi_norm") + 0.5 * F.col("_c"), 4))
    return both.select("feature", rounded(F.col("mi"), 5).alias("mi_score"),
                       rounded(F.col("mi_norm"), 4).alias("mi_normalized"),
                       rounded(F.col("_c"), 4).alias("correlation"), "leakage_prob",
                       label(F.col("leakage_prob"), *LEAK_BANDS, default="SAFE").alias("risk_level"))


def leakage_summary(df: DataFrame, target: str, bins: int = 10) -> DataFrame:
    """Counts and names of critical and high-risk features, and the overall verdict."""
    risk = leakage_probability(df, target, bins)

    def names(level: str) -> Column:
        return F.array_join(F.array_sort(F.collect_list(
            F.when(F.col("risk_level") == level, F.col("feature")))), ",")
    one = risk.agg(F.count_if(F.col("risk_level") == "CRITICAL").alias("n_critical"),
                   F.count_if(F.col("risk_level") == "HIGH").alias("n_high"),
                   names("CRITICAL").alias("critical_features"), names("HIGH").alias("high_features"))
    return one.withColumn("verdict", F.when(F.col("n_critical") > 0, "CRITICAL")
                          .when(F.col("n_high") > 0, "HIGH RISK").otherwise("SAFE"))


def mutual_information_knn(df: DataFrame, target: str, key: str, n: int = 1000,
                           neighbours: int = 3, seed: int = 42) -> DataFrame:
    """Nearest-neighbour mutual information (Kraskov et al. 2004) on a declared sample.

    An estimate for comparison; `mutual_information` is the one over all rows. The
    sample of `n` rows bounds the quadratic distance work, features run in parallel.
    """
    names = numeric_columns(df, target)
    medians = quantiles(df, names, [0.5])
    usable = [c for c in names if c != key and medians[c][0] is not None]
    sample = deterministic_sample(df.filter(num(target).isNotNull()), n, key, seed)
    rows = long_form(sample, {c: F.coalesce(num(c), F.lit(medians[c][0])) for c in usable},
                     keep=[num(target).alias("y")])

    def estimate(group: pd.DataFrame) -> pd.DataFrame:
        mi = kraskov_mi(group["value"].to_numpy(float), group["y"].to_numpy(float), neighbours)
        return pd.DataFrame({"feature": group["feature"].iloc[:1], "n": [len(group)],
                             "mi": [round(mi, 5)]})
    return rows.groupBy("feature").applyInPandas(estimate, "feature string, n bigint, mi double")


def kraskov_mi(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Kraskov's first estimator for two scaled variables, ties broken by faint noise."""
    n = len(x)
    if n <= k + 1:
        return 0.0
    rng = np.random.default_rng(42)
    order = np.lexsort((y, x))                              # independent of the row order
    x, y = x[order], y[order]
    scaled = []
    for v in (x, y):
        sd = v.std() or 1.0
        v = v / sd
        scaled.append(v + 1e-10 * max(1.0, np.abs(v).mean()) * rng.standard_normal(n))
    dx = np.abs(scaled[0][:, None] - scaled[0][None, :])
    dy = np.abs(scaled[1][:, None] - scaled[1][None, :])
    joint = np.maximum(dx, dy)
    np.fill_diagonal(joint, np.inf)
    radius = np.partition(joint, k - 1, axis=1)[:, k - 1][:, None]
    nx = (dx < radius).sum(axis=1)                          # counts include the point itself
    ny = (dy < radius).sum(axis=1)
    harmonic = np.concatenate([[0.0], np.cumsum(1 / np.arange(1, n + 1))])

    def psi(m):
        return harmonic[np.asarray(m) - 1] - np.euler_gamma
    return max(0.0, float(psi(n) + psi(k) - np.mean(psi(nx) + psi(ny))))
