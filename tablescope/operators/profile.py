"""Profile of one table: shape, missing cells, duplicates, spread, target relations."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.schema import (categorical_columns, is_numeric, missing, num,
                                         numeric_columns, quoted, value)
from tablescope.functions.stats import (adjusted_kurtosis, adjusted_skewness, corr_of_parts, corr_parts,
                                        rounded)
from tablescope.functions.wide import AGGREGATES, per_column
from tablescope.operators.duplicates import duplicate_rows
from tablescope.operators.quantiles import quantiles

# The published limits of the audit.
HIGH_CARDINALITY = 50
BINARY_CLASSES = 2
FEW_CLASSES = 20
FEW_CLASSES_RATIO = 0.05
IMBALANCE_SHARE = 0.5


def shape(df: DataFrame, target: str | None = None) -> DataFrame:
    """Rows, columns with the target, and feature counts without it."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).alias("columns"),
        F.lit(len(numeric_columns(df, target))).alias("numeric_features"),
        F.lit(len(categorical_columns(df, target))).alias("categorical_features"))


def missing_counts(df: DataFrame) -> DataFrame:
    """`(ordinal, column, n_missing, n_rows)` for every column, also the complete ones."""
    return per_column(df, df.columns, lambda c: {
        "n_missing": F.count(F.when(missing(df, c), 1)), "n_rows": F.count(F.lit(1))},
        key="column", chunk=AGGREGATES)


def missing_by_column(df: DataFrame) -> DataFrame:
    return missing_counts(df).filter("n_missing > 0").select("column", "n_missing")


def missing_total(df: DataFrame) -> DataFrame:
    total = F.sum("n_missing")
    cells = F.max("n_rows") * len(df.columns)
    return missing_counts(df).agg(
        total.alias("missing_total"),
        rounded(total / F.greatest(cells, F.lit(1)) * 100, 2).alias("missing_pct"))


def _family(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "bigint"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
        return "json"
    return "string"


def value_frequency(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """`(feature, value, n)` with the value as text; missing values have their own row.

    Columns of one type family are counted together in that type, each family in
    one pass with a partial count before the shuffle; text is made afterwards.
    """
    counted = _typed_frequencies(df, names or df.columns)
    return reduce(DataFrame.unionByName,
                  [f.select("feature", F.col("value").cast("string").alias("value"), "n")
                   for f in counted])


def _typed_frequencies(df: DataFrame, names: Sequence[str]) -> list[DataFrame]:
    families: dict[str, list[str]] = {}
    for c in names:
        families.setdefault(_family(df.schema[c].dataType), []).append(c)
    out = []
    for kind, members in families.items():
        items = []
        for c in members:
            v = F.to_json(F.struct(value(df, c))) if kind == "json" else value(df, c).cast(kind)
            v = v + F.lit(0.0) if kind == "double" else v
            items.append(F.struct(F.lit(c).alias("feature"), v.alias("value")))
        out.append(df.select(F.inline(F.array(*items))).groupBy("feature", "value")
                   .agg(F.count(F.lit(1)).alias("n")))
    return out


def distinct_count(df: DataFrame, names: Sequence[str] | None = None,
                   approximate: bool = False) -> DataFrame:
    """Number of distinct non-missing values per column.

    `approximate=True` keeps a fixed-size sketch per column instead of shuffling
    the distinct values.
    """
    names = list(names or df.columns)
    if approximate:
        return per_column(df, names, lambda c: {
            "n_distinct": F.approx_count_distinct(value(df, c))}).select("feature", "n_distinct")
    return reduce(DataFrame.unionByName,
                  [f.groupBy("feature").agg(F.count("value").alias("n_distinct"))
                   for f in _typed_frequencies(df, names)])


def constant_flags(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """`(ordinal, feature, is_constant)`: at most one distinct value.

    Smallest and largest value decide it, so nothing has to be counted.
    """
    def build(c: str) -> dict[str, Column]:
        v = value(df, c)
        if _family(df.schema[c].dataType) == "json":
            v = F.to_json(F.struct(v))
            empty = F.count(value(df, c)) == 0
            return {"is_constant": empty | ((F.min(v) == F.max(v)) & (F.count(value(df, c)) == F.count(F.lit(1))))}
        return {"is_constant": F.min(v).eqNullSafe(F.max(v))}
    return per_column(df, names, build)


def constant_features(df: DataFrame, target: str | None = None) -> DataFrame:
    names = [c for c in df.columns if c != target]
    return constant_flags(df, names).filter("is_constant").select("feature")


def high_cardinality(df: DataFrame, target: str | None = None,
                     limit: int = HIGH_CARDINALITY) -> DataFrame:
    """Categorical features with more than `limit` distinct values.

    A sketch settles every column that is clearly above or below the limit; only
    columns near it (so with few distinct values) are counted exactly.
    """
    names = categorical_columns(df, target)
    guess = {r.feature: r.n_distinct for r in
             distinct_count(df, names, approximate=True).collect()} if names else {}
    sure = [c for c in names if guess[c] > 2 * limit]
    near = [c for c in names if limit / 2 <= guess[c] <= 2 * limit]
    out = df.sparkSession.createDataFrame([(c,) for c in sure], "feature string")
    if near:
        out = out.unionByName(distinct_count(df, near).filter(F.col("n_distinct") > limit)
                              .select("feature"))
    return out


def iqr_bounds(df: DataFrame, names: Sequence[str]) -> dict[str, tuple[float, float, float, float]]:
    """`(q1, q3, lower, upper)` per column that has any value. Runs Spark jobs."""
    out = {}
    for c, (q1, q3) in quantiles(df, names, [0.25, 0.75]).items():
        if q1 is not None:
            out[c] = (q1, q3, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return out


def iqr_outliers(df: DataFrame, target: str | None = None,
                 max_columns: int | None = None) -> DataFrame:
    """Features with values strictly outside 1.5 interquartile ranges, with their count."""
    bounds = iqr_bounds(df, numeric_columns(df, target)[:max_columns])

    def build(c: str) -> dict[str, Column]:
        q1, q3, lo, hi = (F.lit(float(b)) for b in bounds[c])
        return {"q1": q1, "q3": q3, "lower": lo, "upper": hi,
                "n_outliers": F.count(F.when((num(c) < lo) | (num(c) > hi), 1))}
    if not bounds:
        return df.sparkSession.createDataFrame(
            [], "feature string, q1 double, q3 double, lower double, upper double, n_outliers bigint")
    found = per_column(df, list(bounds), build).filter("n_outliers > 0")
    return found.select("feature", *[rounded(F.col(c), 4).alias(c) for c in ("q1", "q3", "lower", "upper")],
                        "n_outliers")


def target_correlations(df: DataFrame, target: str, k: int = 15) -> DataFrame:
    """The `k` features most correlated with a numeric target (pairwise complete rows)."""
    names = numeric_columns(df, target) if is_numeric(df, target) else []
    if not names:
        return df.sparkSession.createDataFrame([], "feature string, correlation double")
    corr = per_column(df, names, lambda c: corr_parts(num(c), num(target)))
    corr = corr.withColumn("correlation", rounded(corr_of_parts(), 4))
    return (corr.filter("correlation is not null")
            .orderBy(F.abs("correlation").desc(), "ordinal").limit(k)
            .select("feature", "correlation"))


def task_type(df: DataFrame, target: str) -> DataFrame:
    """Classification or regression, from the type and distinct values of the target."""
    t = df.schema[target].dataType
    v = value(df, target)
    text = isinstance(t, T.StringType)
    lowest = num(target) if is_numeric(df, target) else F.lit(None).cast("double")
    one = (df.groupBy(v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"),
                                         F.min(lowest).alias("_x"))
           .agg(F.count("_v").alias("n_unique"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
                F.min("_x").alias("target_min"), F.max("_x").alias("target_max")))
    ratio = F.col("n_unique") / F.greatest("n_rows", F.lit(1))
    few = (F.col("n_unique") <= FEW_CLASSES) & (ratio < FEW_CLASSES_RATIO)
    kind = (F.when(F.lit(text) | (F.col("n_unique") <= BINARY_CLASSES) | few, "classification")
            .otherwise("regression"))
    why = (F.when(F.lit(text), "text").when(F.col("n_unique") <= BINARY_CLASSES, "binary")
           .when(few, "low cardinality").otherwise("continuous"))
    return one.select(F.lit(target).alias("target"), "n_unique", "n_rows",
                      rounded(ratio, 6).alias("unique_ratio"), "target_min", "target_max",
                      kind.alias("task_type"), why.alias("reason"))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Non-missing target values with their count and share of the labelled rows."""
    counts = (df.groupBy(value(df, target).alias("_v")).agg(F.count(F.lit(1)).alias("n"))
              .filter("_v is not null"))
    total = counts.agg(F.sum("n").alias("_total"))
    return (counts.crossJoin(F.broadcast(total))            # one row
            .select(F.col("_v").cast("string").alias("class"), "n",
                    rounded(F.col("n") / F.col("_total"), 4).alias("share")))


def imbalance_ratio(df: DataFrame, target: str) -> DataFrame:
    """Largest over smallest class, and the flag for two classes with a share under 0.5."""
    return class_distribution(df, target).agg(
        F.count(F.lit(1)).alias("n_classes"), F.min("n").alias("min_class"),
        F.max("n").alias("max_class")).select(
        "n_classes", "min_class", "max_class",
        F.when(F.col("n_classes") >= 2, rounded(F.col("max_class") / F.col("min_class"), 2))
        .alias("imbalance_ratio"),
        ((F.col("n_classes") == 2)
         & F.coalesce(F.col("min_class") / F.col("max_class") < IMBALANCE_SHARE, F.lit(False)))
        .alias("imbalanced"))


def describe(df: DataFrame, target: str | None = None) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of every numeric feature."""
    names = numeric_columns(df, target)
    cuts = quantiles(df, names, [0.25, 0.5, 0.75])

    def build(c: str) -> dict[str, Column]:
        q = [F.lit(x).cast("double") for x in cuts.get(c, [None] * 3)]
        return {"dtype": F.lit(df.schema[c].dataType.simpleString()) if c in cuts else F.lit(""),
                "count": F.count(num(c)), "mean": F.avg(num(c)), "std": F.stddev(num(c)),
                "min": F.min(num(c)), "q25": q[0], "q50": q[1], "q75": q[2], "max": F.max(num(c))}
    return per_column(df, names, build).select("feature", "dtype", "count", *[
        rounded(F.col(c), 4).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


def feature_ranges(df: DataFrame, target: str | None = None, k: int = 10) -> DataFrame:
    """The `k` numeric features with the widest range."""
    spread = per_column(df, numeric_columns(df, target),
                        lambda c: {"value_range": F.max(num(c)) - F.min(num(c))})
    return (spread.filter("value_range is not null")
            .orderBy(F.col("value_range").desc(), "ordinal").limit(k)
            .select("feature", rounded(F.col("value_range"), 4).alias("value_range")))


def data_quality_summary(df: DataFrame, target: str) -> DataFrame:
    """One row: samples, features, missing cells, class balance and widest features."""
    balance = class_distribution(df, target).agg(
        F.array_join(F.array_sort(F.collect_list(
            F.concat_ws(":", "class", F.col("n").cast("string")))), ",").alias("class_balance"))
    wide = feature_ranges(df, target).agg(F.array_join(F.array_sort(
        F.collect_list("feature")), ",").alias("widest_features"))
    return (shape(df, target).select(F.col("rows").alias("num_samples"),
                                     (F.col("columns") - 1).alias("num_features"))
            .crossJoin(missing_total(df).select("missing_total"))
            .crossJoin(balance).crossJoin(wide))            # one row each


def profile_columns(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row per column: type, missing, distinct, moments, quartile outliers."""
    numeric = numeric_columns(df)
    bounds = iqr_bounds(df, [c for c in numeric if c != target])
    empty = F.lit(None).cast("double")

    def build(c: str) -> dict[str, Column]:
        known = c in df.columns
        is_num = c in numeric
        v = num(c)
        out = F.lit(None).cast("bigint")
        if c in bounds:
            out = F.count(F.when((v < bounds[c][2]) | (v > bounds[c][3]), 1))
        stat = {"mean": F.avg(v), "std": F.stddev(v), "min": F.min(v), "max": F.max(v),
                "g1": F.skewness(v), "g2": F.kurtosis(v)} if is_num else {}
        return {"dtype": F.lit(df.schema[c].dataType.simpleString() if known else ""),
                "n_rows": F.count(F.lit(1)),
                "n_missing": F.count(F.when(missing(df, c), 1)),
                **{s: stat.get(s, empty) for s in ("mean", "std", "min", "max", "g1", "g2")},
                "_numeric": F.lit(is_num), "n_outliers": out}
    n = F.when(F.col("_numeric"), F.col("n_rows") - F.col("n_missing"))
    stats = per_column(df, df.columns, build, chunk=3).select(
        "feature", "dtype", "n_rows", "n_missing",
        *[rounded(F.col(c), 4).alias(c) for c in ("mean", "std", "min", "max")],
        rounded(adjusted_skewness(n, F.col("g1")), 3).alias("skewness"),
        rounded(adjusted_kurtosis(n, F.col("g2")), 3).alias("kurtosis"), "n_outliers")
    # One row per column on both sides.
    return stats.join(distinct_count(df), "feature").withColumn("is_constant", F.col("n_distinct") <= 1)


def first_per(df: DataFrame, by: str, order: Sequence[Column]) -> DataFrame:
    """First row per group of an already aggregated frame."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
