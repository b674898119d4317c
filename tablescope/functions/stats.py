"""Statistical column expressions that behave the same for constants, nulls and ties."""

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def rounded(c: Column, digits: int) -> Column:
    """Half-up rounding that never yields a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def corr_parts(a: Column, b: Column) -> dict[str, Column]:
    """The aggregates behind a correlation over rows where both sides exist, for `corr_of_parts` on the aggregated rows."""
    both = a.isNotNull() & b.isNotNull()
    return {"_cov": F.covar_pop(a, b), "_sa": F.stddev_pop(F.when(both, a)),
            "_sb": F.stddev_pop(F.when(both, b))}


def corr_of_parts() -> Column:
    """NULL when a side is constant."""
    return F.expr("_cov / nullif(_sa * _sb, 0.0D)")


def adjusted_skewness(n: Column, g1: Column) -> Column:
    """Bias-corrected skewness from the plain one; 0 for a constant column of 3 values or more."""
    n = n.cast("double")
    adj = g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n >= 3, F.coalesce(adj, F.lit(0.0)))


def adjusted_kurtosis(n: Column, g2: Column) -> Column:
    """Bias-corrected excess kurtosis; 0 for a constant column of 4 values or more."""
    n = n.cast("double")
    scale = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(n >= 4, F.coalesce(scale * ((n + 1) * g2 + 6), F.lit(0.0)))


def jarque_bera_p(n: Column, g1: Column, g2: Column) -> Column:
    """p-value of the Jarque-Bera normality test (chi-square with 2 degrees of freedom)."""
    g1, g2 = F.coalesce(g1, F.lit(0.0)), F.coalesce(g2, F.lit(0.0))
    return F.exp(-(n.cast("double") / 6 * (g1 * g1 + g2 * g2 / 4)) / 2)


def ks_p_value(d: Column, n1: Column, n2: Column) -> Column:
    """Two-sided two-sample Kolmogorov-Smirnov p-value (asymptotic).

    Kolmogorov's series, at an argument shifted for the finite sample size; below
    0.2 the series needs many terms while p is 1 to more digits than we report.
    """
    m = n1.cast("double") * n2 / F.nullif(n1.cast("double") + n2, F.lit(0.0))
    x = F.sqrt(m) * d
    x = x + 1 / (6 * F.sqrt(m)) + (x - 1) / (4 * m)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(20)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
        * F.exp(-2.0 * k * k * x * x))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * series))
    return F.when(d.isNull(), None).when(x < 0.2, F.lit(1.0)).otherwise(p)


def relative_shift_pct(before: Column, after: Column) -> Column:
    return F.abs(after - before) / (F.abs(before) + F.lit(EPS)) * 100


def label(c: Column, *steps: tuple[float, str], default: str) -> Column:
    """`label(c, (10, "HIGH"), (5, "MODERATE"), default="OK")`: first strict `>` wins."""
    out = None
    for limit, name in steps:
        out = (F.when if out is None else out.when)(c > limit, F.lit(name))
    return out.otherwise(F.lit(default))


def vif_label(c: Column) -> Column:
    return label(c, (10, "HIGH"), (5, "MODERATE"), default="OK")


def correlation_label(c: Column) -> Column:
    return label(F.abs(c), (0.95, "HIGH RISK"), (0.85, "WATCH"), default="OK")


def ks_severity(ks: Column) -> Column:
    return label(ks, (0.3, "HIGH"), (0.15, "MEDIUM"), default="LOW")


def grade(score: Column) -> Column:
    """A to F from a 0-100 score (inclusive cut-offs)."""
    return (F.when(score >= 90, "A").when(score >= 75, "B")
            .when(score >= 60, "C").when(score >= 40, "D").otherwise("F"))
