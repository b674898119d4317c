"""Whole audits: the one-row summary and the long table of findings."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.schema import numeric_columns
from tablescope.operators import (adequacy, association, distribution, drift, features, inference,
                                  missingness, outliers, profile, scoring)


def _names(frame: DataFrame, name: str, column: str = "feature") -> DataFrame:
    """All values of a small result as one comma-joined text."""
    return frame.agg(F.array_join(F.array_sort(F.collect_list(column)), ",").alias(name))


def audit_summary(df: DataFrame, target: str, order_by: Sequence[str]) -> DataFrame:
    """One row about a whole table: size, grades, leaks, drift, outliers, patterns, advice."""
    signals = scoring.signals(df, target)
    health = scoring.health_score(signals).select("missing_pct", "duplicate_rows", "n_leak",
                                                  F.col("total").alias("health_total"))
    overall = scoring.overall_grade(signals).select("overall_score", "overall_grade", "pattern",
                                                    "task_type")
    leaks = association.leakage_summary(df, target).select("n_critical", "n_high")
    moved = drift.drift_summary(df, target, order_by).select(F.col("risk").alias("drift_risk"), "drift_pct")
    odd = outliers.outlier_summary(df, target, robust=False).select("pct_outliers", "top_drivers")
    skewed = _names(distribution.skewed_features(df, target, 1.5, k=len(df.columns)), "skewed")
    related = _names(profile.target_correlations(df, target, 5), "top_correlated")
    phases = features.recommendations(df, target).agg(
        *[F.count_if(F.col("phase") == p).alias(f"n_phase{p}") for p in (1, 2, 3)])
    parts = [profile.shape(df, target), health, overall, leaks, moved, odd, skewed, related, phases]
    return reduce(DataFrame.crossJoin, parts)               # one row each


def findings(df: DataFrame, target: str, order_by: Sequence[str] | None = None,
             sections: Sequence[str] | None = None) -> DataFrame:
    """Every finding as `(section, subject, metric, value_num, value_str, severity)`."""
    def long(frame: DataFrame, section: str, subject: Column, numbers: Sequence[str] = (),
             texts: Sequence[str] = (), severity: Column | None = None) -> DataFrame:
        severity = F.lit("INFO") if severity is None else severity
        rows = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value_num"),
                         F.lit(None).cast("string").alias("value_str")) for c in numbers]
        rows += [F.struct(F.lit(c).alias("metric"), F.lit(None).cast("double").alias("value_num"),
                          F.col(c).cast("string").alias("value_str")) for c in texts]
        return frame.select(F.lit(section).alias("section"), subject.cast("string").alias("subject"),
                            severity.alias("severity"), F.inline(F.array(*rows)))
    table = F.lit("table")
    made = {
        "profile": lambda: long(profile.shape(df, target).crossJoin(profile.missing_total(df))
                                .crossJoin(profile.duplicate_rows(df)), "profile", table,
                                ["rows", "columns", "numeric_features", "categorical_features",
                                 "missing_total", "missing_pct", "duplicate_rows"]),
        "missing": lambda: long(missingness.missing_severity(df), "missing", F.col("column"),
                                ["n_missing", "pct"], severity=F.col("severity")),
        "pattern": lambda: long(missingness.missing_pattern(df), "pattern", table,
                                ["total_missing_pct"], ["pattern"]),
        "redundancy": lambda: long(association.redundant_pairs(df, target, None), "redundancy",
                                   F.concat_ws(" / ", "feature_1", "feature_2"), ["correlation"],
                                   severity=F.col("severity")),
        "leakage": lambda: long(association.leakage_by_correlation(df, target), "leakage",
                                F.col("feature"), ["abs_corr"], severity=F.col("level")),
        "leakage_probability": lambda: long(
            association.leakage_probability(df, target), "leakage_probability", F.col("feature"),
            ["mi_score", "correlation", "leakage_prob"], severity=F.col("risk_level")),
        "types": lambda: long(inference.infer_types(df), "types", F.col("column"), [],
                              ["inferred", "recommendation"],
                              F.when(F.col("warning"), "WARNING").otherwise("INFO")),
        "sample": lambda: long(adequacy.sample_size_checks(df, target), "sample", F.col("rule"),
                               ["needed", "have"], severity=F.when(F.col("pass"), "PASS").otherwise("FAIL")),
        "roadmap": lambda: long(features.recommendations(df, target), "roadmap", F.col("action"),
                                ["phase"], ["columns"]),
    }
    if order_by:
        made["drift"] = lambda: long(drift.drift_report(df, target, order_by), "drift", F.col("feature"),
                                     ["ks_stat", "p_value", "mean_shift"], severity=F.col("severity"))
    if len(numeric_columns(df, target)) < 1:
        for s in ("redundancy", "leakage", "leakage_probability"):
            made.pop(s)
    return reduce(DataFrame.unionByName, [made[s]() for s in (sections or made)])
