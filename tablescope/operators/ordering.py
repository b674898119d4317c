"""Operators that depend on the order of rows, without sorting a table in one task.

Order is always that of explicit key columns. Small tables (a checked number of
rows) use a plain window; larger ones are cut into ranges of bounded size.
"""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.schema import datetime_columns, num, numeric_columns, quoted
from tablescope.operators.quantiles import value_at_rank
from tablescope.sources.tables import materialise

SMALL_ROWS = 1_000_000
MAX_BUCKETS = 4_000


def instant(df: DataFrame, name: str) -> Column:
    """Microseconds of a timestamp or date; those without a zone are counted as they stand, whatever the session's zone."""
    c, kind = F.col(quoted(name)), df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long") * 86_400_000_000
    if not isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    seconds = F.unix_date(c.cast("date")).cast("long") * 86_400 + F.hour(c) * 3_600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")


def key_numbers(df: DataFrame, name: str) -> list[Column] | None:
    """Doubles that order a key column exactly, the first before the next; None for types that have none.

    A 64-bit number is two of 32 bits, as a double holds only 53; so is a decimal without a fraction
    that fits into 64 bits. Text has no such numbers; see `text_at_rank`.
    """
    c, kind = F.col(quoted(name)), df.schema[name].dataType
    if isinstance(kind, T.LongType) or isinstance(kind, T.DecimalType) and kind.scale == 0 and kind.precision <= 18:
        c = c.cast("long")
        return [F.shiftright(c, 32).cast("double"), c.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double")]
    if isinstance(kind, T.DecimalType) and kind.precision > 15:
        if kind.precision > 37:
            raise ValueError(f"{name}: order keys hold at most 37 digits, cast it to fewer")
        # the nearest double, then what it leaves over, twice: three doubles hold 37 digits
        same = kind.simpleString()
        out = [c.cast("double")]
        for _ in range(2):
            c = (c - out[-1].cast(same)).cast(same)
            out.append(c.cast("double"))
        return out
    if name in numeric_columns(df):
        return [num(name)]
    if name in datetime_columns(df):
        return [instant(df, name).cast("double")]
    return None


def with_buckets(df: DataFrame, names: Sequence[str], n_rows: int,
                 rows_per_bucket: int = SMALL_ROWS) -> DataFrame:
    """Add `<name>__bucket`: ranges of the double column `name` with about equal rows.

    Edges come from one sketch pass; equal values always share a bucket, so only
    the number of distinct values in a bucket is bounded, not that of rows.
    """
    n = min(MAX_BUCKETS, math.ceil(n_rows / rows_per_bucket))
    if n <= 1 or not names:
        return df.select("*", *[F.lit(0.0).alias(f"{c}__bucket") for c in names])
    from pyspark.ml.feature import Bucketizer
    probs = [i / n for i in range(1, n)]
    splits = {}
    for at in range(0, len(names), 10):
        part = names[at:at + 10]
        row = df.agg(*[F.percentile_approx(quoted(c), probs, max(10_000, 10 * n)).alias(c)
                       for c in part]).first()
        for c in part:
            edges = sorted(set(row[c] or [0.0]))
            splits[c] = [-math.inf, *[e for e in edges if math.isfinite(e)], math.inf]
            if len(splits[c]) == 2:
                splits[c].insert(1, 0.0)
    return Bucketizer(splitsArray=[splits[c] for c in names], inputCols=list(names),
                      outputCols=[f"{c}__bucket" for c in names], handleInvalid="keep").transform(df)


def global_position(df: DataFrame, order_by: Sequence[str], small_rows: int = SMALL_ROWS,
                    n_rows: int | None = None) -> DataFrame:
    """Add `_pos`, the 0-based rank of each row under unique keys.

    Beyond `small_rows` the table is range-partitioned by all keys (so a hot value
    of the first key is split by the others), written once, and numbered from the
    row counts of the sorted partitions.
    """
    keys = [F.col(quoted(c)) for c in order_by]
    n = df.count() if n_rows is None else n_rows
    if n <= small_rows:
        w = Window.partitionBy(F.lit(0)).orderBy(*keys)
        return df.withColumn("_pos", F.row_number().over(w).cast("bigint") - 1)
    parts = max(2, math.ceil(n / small_rows))
    stored = materialise(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
                         .withColumn("_id", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("_id", 33)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_c")
    offsets = sizes.select("_part", before.alias("_offset"))    # one row per partition
    return (stored.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .withColumn("_pos", F.col("_offset") + F.col("_id").bitwiseAND((1 << 33) - 1))
            .drop("_part", "_offset", "_id"))


def text_at_rank(df: DataFrame, c: Column, rank: int) -> bytes:
    """The UTF-8 bytes at 0-based `rank` of a text expression without nulls, in order of bytes.

    Byte by byte: the rows that are left agree up to the first byte in which their least and greatest
    text differ; they are counted by that byte, at most 257 counts, and the byte that holds the rank is followed.
    """
    rows = df.select(c.cast("binary").alias("t"))
    while True:
        low, high = (bytes(x) for x in rows.agg(F.min("t"), F.max("t")).first())
        if low == high:
            return low
        same = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), len(low))
        at = F.hex(F.substring("t", same + 1, 1))
        for byte, n in sorted(rows.groupBy(at.alias("b")).count().collect()):
            if rank < n:
                break
            rank -= n
        rows = rows.filter(at == byte)


def split_at_fraction(df: DataFrame, order_by: Sequence[str], fraction: float = 0.5,
                      flag: str = "second") -> DataFrame:
    """Add a boolean: does the row come after the first floor(n * fraction) rows?

    The cut is the key at one rank, found by counting histograms that descend into the part with the rank,
    column by column; the table itself is neither sorted nor shuffled, and every type of key and size of
    table goes the same way. Keys must be unique where the cut falls. Runs Spark jobs.
    """
    nulls = F.count(F.when(sum((F.col(quoted(c)).isNull().cast("int") for c in order_by),
                               F.lit(0)) > 0, 1))
    n, n_null = df.agg(F.count(F.lit(1)), nulls).first()
    if n_null:
        raise ValueError(f"{n_null} rows have no value in {list(order_by)}")
    first = math.floor(n * fraction)
    if n == 0 or first >= n or first == 0:
        return df.withColumn(flag, F.lit(first == 0 and n > 0))
    rows, rank, cut = df, first, []
    for c in order_by:
        for k in key_numbers(df, c) or [F.col(quoted(c)).cast("binary")]:
            if key_numbers(df, c) is None:
                v = F.lit(text_at_rank(rows, k, rank))
            else:
                v = F.lit(value_at_rank(rows, k, rank))
            before, rows = rows.filter(k < v).count(), rows.filter(k == v)
            rank -= before
            cut.append((k, v))
    if rank > 0:                                            # rows that equal the first of the second part come before it
        raise ValueError(f"{list(order_by)} is not unique; add a column that tells rows apart")
    later = F.lit(True)
    for k, v in reversed(cut):
        later = (k > v) | ((k == v) & later)
    return df.withColumn(flag, later)


def lagged(df: DataFrame, column: str, lags: Sequence[int], order_by: Sequence[str],
           partition_by: Sequence[str] = (), small_rows: int = SMALL_ROWS) -> DataFrame:
    """Add `<column>_lag_<k>`: the value k rows earlier in order (within `partition_by`).

    Large tables are cut by position into blocks of `small_rows` rows; a row is also sent to
    every later block that it reaches, so a hot partition is many blocks and any lag is found.
    """
    n = df.count()
    value = F.col(quoted(column))
    names = {k: f"{column}_lag_{k}" for k in lags}
    keys = [F.col(quoted(c)) for c in order_by]
    if n <= small_rows:
        w = Window.partitionBy(*partition_by, F.lit(0)).orderBy(*keys)
        return df.select("*", *[F.lag(value, k).over(w).alias(a) for k, a in names.items()])
    placed = global_position(df, [*partition_by, *order_by], small_rows, n_rows=n)
    block = F.floor(F.col("_pos") / small_rows)
    reach = F.floor((F.col("_pos") + max(lags)) / small_rows)
    spread = placed.select("*", F.explode(F.sequence(block, reach)).alias("_block")) \
        .withColumn("_halo", F.col("_block") != block)
    w = Window.partitionBy("_block").orderBy("_pos")
    same = {k: F.lit(True) for k in lags}
    for c in partition_by:
        for k in lags:
            same[k] = same[k] & F.lag(F.col(quoted(c)), k).over(w).eqNullSafe(F.col(quoted(c)))
    return (spread.select("*", *[F.when(same[k], F.lag(value, k).over(w)).alias(a)
                                 for k, a in names.items()])
            .filter(~F.col("_halo")).drop("_pos", "_block", "_halo"))


def adjacent_gaps(values: DataFrame, rows_per_bucket: int = SMALL_ROWS) -> DataFrame:
    """`(gap, weight)` between neighbours of the sorted whole numbers in column `v`."""
    n = values.count()
    cut = with_buckets(values.withColumn("d", F.col("v").cast("double")), ["d"], n, rows_per_bucket)
    distinct = (cut.groupBy(F.col("d__bucket").alias("b"), "v").agg(F.count(F.lit(1)).alias("n")))
    inside = (distinct.withColumn("gap", F.col("v") - F.lag("v").over(
        Window.partitionBy("b").orderBy("v"))).filter("gap is not null")
        .select("gap", F.lit(1).cast("bigint").alias("weight")))
    ends = distinct.groupBy("b").agg(F.min("v").alias("a"), F.max("v").alias("z"),
                                     F.sum(F.col("n") - 1).alias("repeats"))
    between = (ends.withColumn("gap", F.col("a") - F.lag("z").over(     # one row per bucket
        Window.partitionBy(F.lit(0)).orderBy("a"))).filter("gap is not null")
        .select("gap", F.lit(1).cast("bigint").alias("weight")))
    repeats = (ends.agg(F.sum("repeats").alias("weight")).filter("weight > 0")
               .select(F.lit(0).cast("bigint").alias("gap"), "weight"))
    return (inside.unionByName(between).unionByName(repeats)
            .groupBy("gap").agg(F.sum("weight").alias("weight")))


def weighted_median(gaps: DataFrame, small_rows: int = SMALL_ROWS) -> float | None:
    """Median of `gap`, each counted `weight` times. Runs Spark jobs."""
    rows, total = gaps.agg(F.count(F.lit(1)), F.sum("weight")).first()
    if not total:
        return None
    if rows <= small_rows:
        return gaps.agg(F.percentile("gap", F.lit(0.5), F.col("weight"))).first()[0]
    middle = [(total - 1) // 2, total // 2]
    return sum(value_at_rank(gaps, F.col("gap"), r, F.col("weight")) for r in middle) / 2
