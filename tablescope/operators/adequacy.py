"""Is there enough data for the number of features and classes?"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.schema import value
from tablescope.functions.stats import rounded
from tablescope.operators.profile import task_type

# The published limits of the audit.
ROWS_PER_FEATURE = 10
MIN_ROWS = 100
MIN_PER_CLASS = 50
HIGH_GAIN_BELOW, MODERATE_GAIN_BELOW = 500, 2000


def _counts(df: DataFrame, target: str) -> DataFrame:
    """One row: table size and smallest class, from one pass over the target."""
    return (df.groupBy(value(df, target).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
            .agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
                 F.min(F.when(F.col("_v").isNotNull(), F.col("_n"))).alias("min_class")))


def sample_size_checks(df: DataFrame, target: str, task: str | None = None) -> DataFrame:
    """Rules with needed and available amounts; the class rule only for classification."""
    needed = (len(df.columns) - 1) * ROWS_PER_FEATURE
    counts = _counts(df, target)
    if task is None:
        counts = counts.crossJoin(task_type(df, target).select("task_type"))
    else:
        counts = counts.withColumn("task_type", F.lit(task))

    def rule(name, need, have):
        return F.struct(F.lit(name).alias("rule"), F.lit(need).cast("bigint").alias("needed"),
                        have.alias("have"), F.coalesce(have >= need, F.lit(False)).alias("pass"))
    sizes = [rule("rows per feature", needed, F.col("n_rows")),
             rule("absolute minimum", MIN_ROWS, F.col("n_rows"))]
    per_class = rule("rows per class", MIN_PER_CLASS, F.col("min_class"))
    return counts.select(F.inline(F.when(F.col("task_type") == "classification",
                                         F.array(*sizes, per_class)).otherwise(F.array(*sizes))))


def sample_adequacy(df: DataFrame, target: str, task: str | None = None) -> DataFrame:
    """One row: adequate or not, issues, covered share and expected gain of more data."""
    checks = sample_size_checks(df, target, task).agg(
        F.count_if(~F.col("pass")).alias("n_issues"),
        F.max(F.when(F.col("rule") == "rows per feature", F.col("have"))).alias("n_rows"),
        F.max(F.when(F.col("rule") == "rows per feature", F.col("needed"))).alias("_needed"))
    return checks.select(
        "n_rows", F.lit(len(df.columns) - 1).alias("n_features"), "n_issues",
        (F.col("n_issues") == 0).alias("adequate"),
        rounded(F.least(F.lit(1.0), F.col("n_rows") / F.greatest("_needed", F.lit(1))), 4).alias("ratio"),
        F.when(F.col("n_rows") < HIGH_GAIN_BELOW, "High")
        .when(F.col("n_rows") < MODERATE_GAIN_BELOW, "Moderate").otherwise("Low")
        .alias("projected_gain"))
