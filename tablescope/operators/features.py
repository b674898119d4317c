"""Feature transforms, and the rules that recommend them."""

from collections.abc import Sequence
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.schema import (categorical_columns, num, numeric_columns, quoted, text_columns,
                                         value)
from tablescope.operators.association import drop_suggestions, leakage_candidates
from tablescope.operators.distribution import distributions
from tablescope.operators.inference import infer_types, parse_date
from tablescope.operators.ordering import SMALL_ROWS, lagged
from tablescope.operators.profile import (constant_flags, distinct_count, high_cardinality,
                                          target_correlations)
from tablescope.operators.quantiles import quantiles
from tablescope.sources.tables import materialise

# The published limits of the audit.
LOG_SKEW = 1.5
ONE_HOT_VALUES = (2, 5)
LAGS = (1, 3, 7, 14)
BINS = 5
MAX_POLYNOMIAL = 10

_MAX_BROADCAST_BYTES = 64 << 20
HOT_SHARE = 1000


def log1p_transform(df: DataFrame, names: Sequence[str] | None = None,
                    target: str | None = None) -> DataFrame:
    """Add `<c>_log`; by default for positive features with skew beyond 1.5 (found by a job)."""
    if names is None:
        names = [r.feature for r in skewed_positive(df, target).collect()]
    return df.select("*", *[F.log1p(num(c)).alias(f"{c}_log") for c in names])


def skewed_positive(df: DataFrame, target: str | None = None) -> DataFrame:
    found = distributions(df, target).filter((F.abs("skewness") > LOG_SKEW) & (F.col("min") > 0))
    return found.select("feature")


def one_hot(df: DataFrame, names: Sequence[str], drop_first: bool = True) -> DataFrame:
    """Replace each column by booleans `<c>_<value>` in value order; a gap is all false.

    Columns must have at most 5 distinct values, which one small job checks.
    """
    out = [F.col(quoted(c)) for c in df.columns if c not in names]
    for c in names:
        limit = ONE_HOT_VALUES[1]
        found = [r[0] for r in df.select(value(df, c)).distinct().limit(limit + 2).collect()]
        values = sorted(v for v in found if v is not None)
        if len(values) > limit:
            raise ValueError(f"{c} has more than {limit} distinct values")
        out += [F.coalesce(value(df, c) == F.lit(v), F.lit(False)).alias(f"{c}_{v}")
                for v in values[1 if drop_first else 0:]]
    return df.select(out)


def target_encode(df: DataFrame, column: str, target: str) -> DataFrame:
    """Add `<column>_encoded`: the mean target of the row's category; a gap stays a gap. Runs Spark jobs.

    The category table is written once with its counts. It is broadcast if its measured size allows. If not, only the
    categories with more than one row in HOT_SHARE are (fewer than HOT_SHARE rows by definition); their
    rows, and those without a category, stay where they are, and all others, of which none is hot, are joined by
    category.
    """
    key, name = value(df, column), f"{column}_encoded"
    means = materialise(df.groupBy(key.alias("_k")).agg(F.avg(num(target)).alias(name), F.count(F.lit(1)).alias("_n")), "category-means")
    total, size = means.agg(F.sum("_n"), F.sum(F.lit(24) + F.coalesce(F.octet_length(F.col("_k").cast("string")), F.lit(0)))).first()
    own = [F.col(quoted(c)) for c in df.columns]
    known = means.filter("_k is not null")
    if (size or 0) <= _MAX_BROADCAST_BYTES:
        return df.join(F.broadcast(known), key == F.col("_k"), "left").select(*own, name)
    hot = F.broadcast(known.filter(F.col("_n") * HOT_SHARE > total))
    none = df.filter(key.isNull()).select(*own, F.lit(None).cast("double").alias(name))
    rows = df.filter(key.isNotNull())
    busy = rows.join(hot, key == F.col("_k")).select(*own, name)
    rest = rows.join(hot.select("_k"), key == F.col("_k"), "left_anti")
    return none.unionByName(busy).unionByName(rest.join(known.hint("merge"), key == F.col("_k")).select(*own, name))


def interaction(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumn(f"{a}_x_{b}", num(a) * num(b))


def top_interaction(df: DataFrame, target: str) -> DataFrame:
    """Product of the two features most correlated with the target (found by a job)."""
    top = [r.feature for r in target_correlations(df, target, k=2).collect()]
    return interaction(df, *top) if len(top) == 2 else df


def datetime_parts(df: DataFrame, column: str) -> DataFrame:
    """Add year, month, weekday (Monday is 0) and quarter; text is parsed by the date formats."""
    c = F.col(quoted(column))
    if column in text_columns(df):
        c = parse_date(c)
    return df.select("*", F.year(c).alias(f"{column}_year"), F.month(c).alias(f"{column}_month"),
                     F.weekday(c).alias(f"{column}_dayofweek"), F.quarter(c).alias(f"{column}_quarter"))


def quantile_bin(df: DataFrame, column: str, q: int = BINS) -> DataFrame:
    """Add `<column>_bin`: 0-based quantile bin, closed on the right; equal edges are merged.

    Runs Spark jobs for the exact edges.
    """
    edges = quantiles(df, [column], [i / q for i in range(q + 1)])[column]
    if edges[0] is None:
        return df.withColumn(f"{column}_bin", F.lit(None).cast("int"))
    inner = sorted(set(edges))[1:-1]
    v = num(column)
    at = reduce(lambda a, b: a + b, [(v > F.lit(float(e))).cast("int") for e in inner],
                F.when(v.isNotNull(), 0))
    return df.withColumn(f"{column}_bin", at)


def polynomial(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The features and all products of two of them, squares included, without a constant."""
    if len(names) > MAX_POLYNOMIAL:
        raise ValueError(f"at most {MAX_POLYNOMIAL} features, got {len(names)}")
    pairs = [(num(a) * num(b)).alias(f"{a}_x_{b}") for a, b in combinations_with_replacement(names, 2)]
    return df.select(*[num(c).alias(c) for c in names], *pairs)


def lag_features(df: DataFrame, column: str, order_by: Sequence[str], partition_by: Sequence[str] = (),
                 lags: Sequence[int] = LAGS, small_rows: int = SMALL_ROWS) -> DataFrame:
    """Add `<column>_lag_<k>` and keep only rows without any gap."""
    return lagged(df, column, lags, order_by, partition_by, small_rows).dropna()


def recommendations(df: DataFrame, target: str) -> DataFrame:
    """`(phase, action, columns, effort)`: which transforms the data calls for.

    Every rule is a small aggregate of its own; the result has at most ten rows.
    """
    spark = df.sparkSession
    numeric = numeric_columns(df, target)
    other = categorical_columns(df, target)
    features = [c for c in df.columns if c != target]

    def listed(found: DataFrame, at_most: int, names: Sequence[str]) -> DataFrame:
        """One row with the found features in schema order, or none."""
        place = F.array_position(F.array(*[F.lit(c) for c in names]), F.col("feature")) \
            if names else F.lit(0)
        ordered = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("i"), "feature"))),
                              lambda x: x["feature"])
        return (found.agg(ordered.alias("_all")).filter(F.size("_all") > 0)
                .select(F.array_join(F.slice("_all", 1, at_most), ",").alias("columns")))

    def rule(phase: int, action: str, effort: str, columns: DataFrame) -> DataFrame:
        return columns.select(F.lit(phase).alias("phase"), F.lit(action).alias("action"), "columns",
                              F.lit(effort).alias("effort"))

    def fixed(names: Sequence[str]) -> DataFrame:
        return spark.createDataFrame([(",".join(names),)], "columns string")
    out = [
        rule(1, "drop constant", "5 min", listed(
            constant_flags(df, features).filter("is_constant"), len(features), features)),
        rule(1, "drop redundant", "5 min", listed(drop_suggestions(df, target), 5, numeric)),
        rule(1, "log transform", "10 min", listed(skewed_positive(df, target), 5, numeric)),
    ]
    few = [c for c in other if c not in nested_columns(df)]
    if few:
        counts = _few_valued(df, few)
        leaking = leakage_candidates(df, target).select("feature")
        out.append(rule(1, "one-hot encode", "10 min", listed(
            counts.join(leaking, "feature", "left_anti"), 4, other)))
    out.append(rule(2, "target encode", "30 min", listed(high_cardinality(df, target), 3, other)))
    top = [r.feature for r in target_correlations(df, target, k=2).collect()]
    if len(top) >= 2:
        out.append(rule(2, "interaction", "15 min", fixed(top)))
    dates = [r.column for r in infer_types(df.select(*[F.col(quoted(c)) for c in text_columns(df)]))
             .filter("inferred = 'Date / Datetime'").orderBy("ordinal").collect()] \
        if text_columns(df) else []
    if dates:
        out.append(rule(2, "datetime parts", "20 min", fixed(dates[:1])))
    if len(numeric) >= 3:
        out.append(rule(2, "quantile bins", "15 min", fixed((top or numeric)[:1])))
    if len(numeric) <= MAX_POLYNOMIAL:
        out.append(rule(3, "polynomial", "1 hour", fixed(numeric[:5])))
    out.append(rule(3, "lag features", "2 hours", fixed([target])))
    out.append(rule(3, "external data", "1-2 days", fixed([])))
    return reduce(DataFrame.unionByName, out)


def nested_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]


def _few_valued(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Features with 2 to 5 distinct values; only columns a sketch finds small are counted."""
    low, high = ONE_HOT_VALUES
    guess = distinct_count(df, names, approximate=True).collect()
    near = [r.feature for r in guess if r.n_distinct <= 4 * high]
    if not near:
        return df.sparkSession.createDataFrame([], "feature string")
    return (distinct_count(df, near).filter(F.col("n_distinct").between(low, high)).select("feature"))
