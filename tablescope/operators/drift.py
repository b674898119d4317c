"""Distribution change: between the halves of one table, and between two versions."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.schema import is_numeric, num, numeric_columns
from tablescope.functions.stats import (ks_p_value, ks_severity, label, relative_shift_pct, rounded)
from tablescope.operators.comoments import comoments
from tablescope.operators.ks import ks_statistic
from tablescope.operators.ordering import split_at_fraction
from tablescope.operators.profile import duplicate_rows, missing_counts

# The published limits of the audit.
MIN_ROWS = 50
MIN_PER_HALF = 10
MIN_TARGET_PER_HALF = 5
MIN_PER_VERSION = 5
P_DRIFT = 0.05
DRIFT_BANDS = ((40, "HIGH"), (20, "MEDIUM"))
MISSING_POINTS = 1
SHIFTED_SHARE = 0.3


def _moments(df: DataFrame, names: Sequence[str], second: Column) -> DataFrame:
    """`(ordinal, mean1, mean2, std1, std2)` of both sides, in one pass."""
    sides = df.select(second.alias("_second"), *[num(c).alias(f"v{i}") for i, c in enumerate(names)])
    values = [f"v{i}" for i in range(len(names))]
    rows = comoments(sides, {v: F.col(v) for v in values}, [], values, ["_second"]).select("_second", F.posexplode("singles"))
    spread = F.when(F.col("col.n") > 1, F.sqrt(F.col("col.m2") / (F.col("col.n") - 1)))
    mean = F.when(F.col("col.n") > 0, F.col("col.mean"))
    side = [~F.col("_second"), F.col("_second")]
    return rows.groupBy(F.col("pos").alias("ordinal")).agg(
        *[F.max(F.when(s, mean)).alias(f"mean{k}") for k, s in enumerate(side, 1)],
        *[F.max(F.when(s, spread)).alias(f"std{k}") for k, s in enumerate(side, 1)])


def _compared(df: DataFrame, names: Sequence[str], second: Column, at_least: int) -> DataFrame:
    """Unrounded comparison per feature that has enough values on both sides."""
    both = ks_statistic(df, names, second).join(_moments(df, names, second), "ordinal")  # one row per feature on both sides
    both = both.filter((F.col("n_first") >= at_least) & (F.col("n_second") >= at_least))
    return both.withColumn("p", ks_p_value(F.col("ks"), F.col("n_first"), F.col("n_second")))


def split_halves(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Add `half`: 1 for the first floor(n / 2) rows in key order, 2 for the rest."""
    cut = split_at_fraction(df, order_by, 0.5, "_second")
    return cut.withColumn("half", F.when(F.col("_second"), 2).otherwise(1)).drop("_second")


_DRIFT = ("feature string, ks_stat double, p_value double, drifted boolean, severity string, "
          "mean_first double, mean_second double, mean_shift double, std_shift double")


def drift_report(df: DataFrame, target: str | None, order_by: Sequence[str],
                 max_columns: int | None = None) -> DataFrame:
    """First against second half by key order, per numeric feature. Runs jobs to find the cut."""
    names = numeric_columns(df, target)[:max_columns]
    if not names or len(df.select(F.lit(1)).take(MIN_ROWS)) < MIN_ROWS:
        return df.sparkSession.createDataFrame([], _DRIFT)
    return halves_report(split_halves(df, order_by), names)


def halves_report(halves: DataFrame, names: Sequence[str]) -> DataFrame:
    """The drift of the named features between the halves of a frame from `split_halves`."""
    both = _compared(halves, names, F.col("half") == 2, MIN_PER_HALF)
    return both.select(
        "feature", rounded(F.col("ks"), 4).alias("ks_stat"), rounded(F.col("p"), 4).alias("p_value"),
        (F.col("p") < P_DRIFT).alias("drifted"), ks_severity(F.col("ks")).alias("severity"),
        rounded(F.col("mean1"), 4).alias("mean_first"), rounded(F.col("mean2"), 4).alias("mean_second"),
        rounded(relative_shift_pct(F.col("mean1"), F.col("mean2")), 1).alias("mean_shift"),
        rounded(relative_shift_pct(F.col("std1"), F.col("std2")), 1).alias("std_shift"))


def drift_summary(df: DataFrame, target: str | None, order_by: Sequence[str],
                  report: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """Share of drifted features (of all numeric features), the resulting risk, and the names of the first `k` (all)."""
    names = numeric_columns(df, target)
    report = drift_report(df, target, order_by) if report is None else report
    order = F.array(*[F.lit(c) for c in names]) if names else F.array(F.lit(""))
    hit = F.when(F.col("drifted"), F.struct(F.array_position(order, F.col("feature")).alias("i"),
                                            F.col("feature").alias("f")))
    one = report.agg(F.count_if(F.col("drifted")).alias("n_drifted"),
                     F.count(F.lit(1)).alias("n_tested"),
                     F.slice(F.array_sort(F.collect_list(hit)), 1, k or max(len(names), 1)).alias("_top"))
    pct = rounded(F.col("n_drifted") / max(len(names), 1) * 100, 1)
    return (one.withColumn("drift_pct", pct)
            .withColumn("risk", label(F.col("drift_pct"), *DRIFT_BANDS, default="LOW"))
            .withColumn("top_drifted", F.array_join(F.col("_top.f"), ",")).drop("_top"))


def target_drift(df: DataFrame, target: str, order_by: Sequence[str]) -> DataFrame:
    """Halves compared on a numeric target with more than 5 values in each."""
    if not is_numeric(df, target):
        return df.sparkSession.createDataFrame(
            [], "ks_stat double, p_value double, drifted boolean, mean_first double, mean_second double")
    halves = split_halves(df, order_by)
    both = _compared(halves, [target], F.col("half") == 2, MIN_TARGET_PER_HALF + 1)
    return both.select(rounded(F.col("ks"), 4).alias("ks_stat"), rounded(F.col("p"), 4).alias("p_value"),
                       (F.col("p") < P_DRIFT).alias("drifted"),
                       rounded(F.col("mean1"), 4).alias("mean_first"),
                       rounded(F.col("mean2"), 4).alias("mean_second"))


# --- two versions of a table ---------------------------------------------------------------

def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per column: added, removed, common, or type_changed."""
    before = {f.name: f.dataType.simpleString() for f in old.schema.fields}
    after = {f.name: f.dataType.simpleString() for f in new.schema.fields}
    rows = []
    for c in [*before, *[c for c in after if c not in before]]:
        status = ("removed" if c not in after else "added" if c not in before else
                  "common" if before[c] == after[c] else "type_changed")
        rows.append((c, status, before.get(c), after.get(c)))
    return old.sparkSession.createDataFrame(
        rows, "column string, status string, old_type string, new_type string")


def _pair(old: DataFrame, new: DataFrame, one_row) -> DataFrame:
    return one_row(old, "old").crossJoin(one_row(new, "new"))


def row_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    both = _pair(old, new, lambda df, side: df.agg(F.count(F.lit(1)).alias(f"rows_{side}")))
    delta = F.col("rows_new") - F.col("rows_old")
    return both.select("rows_old", "rows_new", delta.alias("delta"), rounded(
        delta / F.greatest("rows_old", F.lit(1)) * 100, 1).alias("delta_pct"))


def duplicate_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    return _pair(old, new, lambda df, side: duplicate_rows(df).withColumnRenamed(
        "duplicate_rows", f"duplicates_{side}"))


def missing_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Common columns whose missing share moved by more than one percentage point."""
    common = [c for c in old.columns if c in new.columns]

    def pct(df, name):
        return missing_counts(df.select(common)).select(
            "column", F.coalesce(F.col("n_missing") / F.nullif("n_rows", F.lit(0).cast("bigint")) * 100,
                                 F.lit(0.0)).alias(name))
    both = pct(old, "o").join(pct(new, "n"), "column")      # one row per column on both sides
    delta = F.col("n") - F.col("o")
    return both.filter(F.abs(delta) > MISSING_POINTS).select(
        "column", rounded(F.col("o"), 2).alias("old_pct"), rounded(F.col("n"), 2).alias("new_pct"),
        rounded(delta, 2).alias("delta"),
        F.when(delta > 0, "Increased").otherwise("Decreased").alias("direction"))


def _versions(old: DataFrame, new: DataFrame, names: Sequence[str]) -> DataFrame:
    def tagged(df, flag):
        return df.select(*[num(c).alias(c) for c in names], F.lit(flag).alias("_new"))
    return reduce(DataFrame.unionByName, [tagged(old, False), tagged(new, True)])


def common_numeric(old: DataFrame, new: DataFrame) -> list[str]:
    newer = set(numeric_columns(new, loose=True))
    return [c for c in numeric_columns(old, loose=True) if c in newer]


_SHIFT = ("column string, ks_stat double, p_value double, shifted boolean, mean_old double, "
          "mean_new double, mean_shift double, severity string")


def _shift(old: DataFrame, new: DataFrame, names: Sequence[str], at_least: int) -> DataFrame:
    if not names:
        return old.sparkSession.createDataFrame([], _SHIFT)
    both = _compared(_versions(old, new, names), names, F.col("_new"), at_least)
    return both.select(
        F.col("feature").alias("column"), rounded(F.col("ks"), 4).alias("ks_stat"),
        rounded(F.col("p"), 4).alias("p_value"), (F.col("p") < P_DRIFT).alias("shifted"),
        rounded(F.col("mean1"), 4).alias("mean_old"), rounded(F.col("mean2"), 4).alias("mean_new"),
        rounded(relative_shift_pct(F.col("mean1"), F.col("mean2")), 1).alias("mean_shift"),
        ks_severity(F.col("ks")).alias("severity"))


def distribution_shift(old: DataFrame, new: DataFrame, max_columns: int | None = None) -> DataFrame:
    """Common numeric columns of two versions compared, in the order of the old schema."""
    return _shift(old, new, common_numeric(old, new)[:max_columns], MIN_PER_VERSION)


def target_shift(old: DataFrame, new: DataFrame, target: str) -> DataFrame:
    names = [target] if target in common_numeric(old, new) else []
    return _shift(old, new, names, 1).drop("mean_shift")


def comparison_verdict(old: DataFrame, new: DataFrame, target: str) -> DataFrame:
    """One row: which kinds of change there are, and the risk of relying on the new version."""
    changed = set(old.columns) != set(new.columns)
    names = common_numeric(old, new)
    shifted = distribution_shift(old, new).agg(F.count_if(F.col("shifted")).alias("n_shifted"))
    of_target = target_shift(old, new, target).agg(
        F.coalesce(F.bool_or("shifted"), F.lit(False)).alias("target_shifted"))
    both = shifted.crossJoin(of_target).select(             # one row each
        F.lit(changed).alias("schema_changed"), "n_shifted",
        (F.col("n_shifted") > len(names) * SHIFTED_SHARE).alias("features_shifted"), "target_shifted")
    issues = sum((F.col(c).cast("int") for c in ("schema_changed", "features_shifted", "target_shifted")),
                 F.lit(0))
    return both.withColumn("n_issues", issues).withColumn(
        "risk", F.when(F.col("n_issues") == 0, "LOW").when(F.col("n_issues") == 1, "MEDIUM")
        .otherwise("HIGH"))
