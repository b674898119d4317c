"""How much is missing, where, and whether other columns explain it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.schema import missing, num, numeric_columns
from tablescope.functions.stats import label, rounded
from tablescope.operators.comoments import comoments, correlation_of
from tablescope.operators.profile import first_per, missing_counts

# The published limits of the audit.
CRITICAL_PCT, MODERATE_PCT = 30, 10
SIGNAL_CORR = 0.2
MCAR_PCT = 5


def missing_severity(df: DataFrame) -> DataFrame:
    """Incomplete columns with count, percentage and severity."""
    counts = missing_counts(df).filter("n_missing > 0").withColumn(
        "pct", rounded(F.col("n_missing") / F.col("n_rows") * 100, 2))
    return counts.select("column", "n_missing", "pct", label(
        F.col("pct"), (CRITICAL_PCT, "Critical"), (MODERATE_PCT, "Moderate"), default="Minor")
        .alias("severity"))


def mar_signals(df: DataFrame, max_columns: int | None = None) -> DataFrame:
    """First numeric column (schema order) that goes along with the gaps of a column.

    Looks at all incomplete columns, or the first `max_columns`; finding them is one small job. All pairs
    come from one more pass.
    """
    incomplete = [r.column for r in missing_counts(df).filter("n_missing > 0")
                  .orderBy("ordinal").collect()][:max_columns]
    numeric = numeric_columns(df)
    if not incomplete or not numeric:
        return df.sparkSession.createDataFrame([], "column string, related_to string, corr double")
    # flags first: the pair (flag i, number j) has i < j
    columns = {f"gap {c}": missing(df, c).cast("double") for c in incomplete} | {f"num {c}": num(c) for c in numeric}
    names = F.array(*[F.lit(c) for c in [*incomplete, *numeric]])
    pairs = comoments(df, columns, [list(columns)]).select(F.explode("pairs").alias("p")).filter(
        (F.col("p.i") < len(incomplete)) & (F.col("p.j") >= len(incomplete)))
    hits = pairs.select(F.element_at(names, F.col("p.i") + 1).alias("column"), F.element_at(names, F.col("p.j") + 1).alias("related_to"),
                        F.col("p.j").alias("ordinal"), correlation_of(F.col("p")).alias("corr")) \
        .filter((F.abs("corr") > SIGNAL_CORR) & (F.col("column") != F.col("related_to")))
    return first_per(hits, "column", [F.col("ordinal")]).select(
        "column", "related_to", rounded(F.abs("corr"), 2).alias("corr"))


def missing_pattern(df: DataFrame) -> DataFrame:
    """One row: NONE, MAR, MCAR or MNAR."""
    n_cols = len(df.columns)
    total = missing_counts(df).agg(
        F.count_if(F.col("n_missing") > 0).alias("n_incomplete"),
        (F.sum("n_missing") / F.greatest(F.max("n_rows") * n_cols, F.lit(1)) * 100).alias("_pct"))
    signals = mar_signals(df).agg(F.count(F.lit(1)).alias("n_signals"))
    return total.crossJoin(signals).select(                 # one row each
        F.when(F.col("n_incomplete") == 0, "NONE").when(F.col("n_signals") > 0, "MAR")
        .when(F.col("_pct") < MCAR_PCT, "MCAR").otherwise("MNAR").alias("pattern"),
        "n_incomplete", "n_signals", rounded(F.col("_pct"), 2).alias("total_missing_pct"))
