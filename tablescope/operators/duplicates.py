"""Equal rows by digests: whole rows are never shuffled to be counted.

Two 64-bit hashes and the length of a row stand for it. Digests are counted first, 24 bytes a row whatever
its width; where none repeats, nothing else is read. Rows whose digest repeats are looked at
again, and count as equal only if their SHA-256 agrees too. Missing values are equal to one another, as are
both zeros.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.schema import quoted, value
from tablescope.sources.tables import materialise

#: Repeated digests that are broadcast (24 bytes each); more are joined by a shuffle.
MAX_BROADCAST = 500_000

_DIGEST = ["_d1", "_d2", "_size"]


def _comparable(df: DataFrame) -> list[Column]:
    """Every column as an expression that is equal exactly for equal values: NaN as NULL, maps as JSON text."""
    out = []
    for f in df.schema.fields:
        if "map<" in f.dataType.simpleString():
            out.append(F.to_json(F.struct(F.col(quoted(f.name)).alias("m"))))
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append(value(df, f.name) + F.lit(0.0))
        else:
            out.append(F.col(quoted(f.name)))
    return out


def with_digest(df: DataFrame) -> DataFrame:
    """The rows with `_d1`, `_d2` and `_size`."""
    values = _comparable(df)
    gaps = F.xxhash64(*[v.isNull() for v in values]) if values else F.lit(0).cast("bigint")    # hashes skip gaps
    size = F.lit(0)
    for f, v in zip(df.schema.fields, values):
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(v), F.lit(0))
    return df.select("*", F.xxhash64(gaps, *values).alias("_d1"), F.xxhash64(F.lit(0x5EED), *reversed(values), gaps).alias("_d2"),
                     size.cast("bigint").alias("_size"))


def copies_by(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """`(*by, duplicate_rows)`: per segment the rows beyond the first of each digest, in one pass."""
    keys = [F.col(quoted(c)) for c in by]
    digests = with_digest(df).groupBy(*keys, *_DIGEST).agg(F.count(F.lit(1)).alias("_n"))
    return digests.groupBy(*keys).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def repeated_digests(df: DataFrame) -> DataFrame | None:
    """The digests that occur more than once, written and read back; None if there are none. Runs Spark jobs."""
    counts = with_digest(df).groupBy(*_DIGEST).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    stored = materialise(counts.select(*_DIGEST), "repeated-digests")
    n = stored.count()
    return None if n == 0 else F.broadcast(stored) if n <= MAX_BROADCAST else stored


def _with_sha(df: DataFrame) -> DataFrame:
    whole = F.to_json(F.struct(*[v.alias(f"c{i}") for i, v in enumerate(_comparable(df))]))
    return with_digest(df).withColumn("_sha", F.sha2(whole, 256))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows (missing values are equal). Runs Spark jobs."""
    repeated = repeated_digests(df)
    if repeated is None:
        return df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("duplicate_rows"))
    rows = _with_sha(df).select(*_DIGEST, "_sha").join(repeated, _DIGEST, "left_semi")
    sets = rows.groupBy(*_DIGEST, "_sha").agg(F.count(F.lit(1)).alias("_n"))
    return sets.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def drop_duplicate_rows(df: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """One row of each set of equal rows, NaN as NULL. Runs Spark jobs unless given `repeated_digests`.

    Rows whose digest is the only one of its kind stay where they are; only the others are shuffled.
    """
    own = [value(df, c).alias(c) for c in df.columns]
    repeated = repeated_digests(df) if repeated is None else repeated
    if repeated is None:
        return df.select(own)
    marked = _with_sha(df)
    alone = marked.join(repeated, _DIGEST, "left_anti").select(own)
    several = marked.join(repeated, _DIGEST, "left_semi").dropDuplicates([*_DIGEST, "_sha"]).select(own)
    return alone.unionByName(several)
