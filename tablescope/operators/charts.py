"""The numbers behind charts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.schema import num
from tablescope.functions.stats import rounded


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Equal-width bins with counts, the last one closed; a constant column is one bin.

    The limits come from one aggregated row, so the plan stays lazy.
    """
    limits = df.agg(F.min(num(column)).alias("lo"), F.max(num(column)).alias("hi"))
    rows = df.select(num(column).alias("v")).filter("v is not null").crossJoin(F.broadcast(limits))
    span = F.col("hi") - F.col("lo")
    share = F.coalesce((F.col("v") - F.col("lo")) / F.nullif(span, F.lit(0.0)), F.lit(0.0))
    at = F.least(F.floor(share * bins), F.lit(bins - 1))
    binned = rows.groupBy(at.cast("int").alias("bin"), "lo", "hi").agg(
        F.count(F.lit(1)).alias("n"))
    return binned.select("bin", rounded(F.col("lo") + F.col("bin") * span / bins, 6).alias("bin_from"),
                         rounded(F.col("lo") + (F.col("bin") + 1) * span / bins, 6).alias("bin_to"), "n")


def top_k(findings: DataFrame, k: int, by: str, then: tuple[str, ...] = (),
          absolute: bool = False) -> DataFrame:
    """The `k` findings with the largest value; each task keeps only its own best `k`."""
    key = F.abs(by) if absolute else F.col(by)
    return findings.orderBy(key.desc(), *then).limit(k)
