"""Deterministic draws: rows ranked by the MD5 of a unique key and a seed.

The rank needs no sort. The first 60 bits of the hash are a number, and the number at the cut-off rank of each
group is found by descending digit by digit: rows are counted by their next digit, at most 2**bits counts for each group
and pass, and only the digit that holds the cut-off is followed. It is one way for all sizes: a few passes
over key and group, and then every row is decided where it is.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions.schema import quoted
from tablescope.sources.tables import materialise

SEED = 42
HASH_BITS = 60
DIGIT_BITS = 10
_SALTS = 16


def hash_key(key: str, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.col(quoted(key)).cast("string"), F.lit(f"|{seed}")))


def flag_first_by_hash(df: DataFrame, key: str, take: Column, by: Sequence[str] = (),
                       seed: int = SEED, flag: str = "selected", digit_bits: int = DIGIT_BITS) -> DataFrame:
    """Add a boolean column: is the row among the first `take` of its group in hash order?

    `take` is an expression over `_n`, the number of rows in the group. `key` must be unique. Missing
    group keys are a group of their own. Runs Spark jobs: one for each digit that is needed.
    """
    own = [F.col(quoted(c)) for c in df.columns]
    rows = df.withColumn("_h", F.conv(F.substring(hash_key(key, seed), 1, HASH_BITS // 4), 16, 10).cast("bigint"))
    names = [f"_by{i}" for i in range(len(by))]
    plain = rows.select(*[F.col(quoted(c)).alias(n) for c, n in zip(by, names)], "_h")
    shift, known, known_shift, settled = HASH_BITS, None, HASH_BITS, []
    whole, upto = Window.partitionBy(*names, F.lit(0)), Window.partitionBy(*names, F.lit(0)).orderBy("_p")
    while True:
        shift = max(0, shift - digit_bits)
        inside = plain if known is None else _with_state(plain, known.filter("_left < _c and _left > 0"), names) \
            .filter(F.shiftright("_h", known_shift) == F.col("_prefix")).select(*names, "_h", F.col("_left").alias("_want"))
        want = [] if known is None else ["_want"]
        # at most 2 ** digit_bits rows of counts for each group
        cells = inside.groupBy(*names, *want, F.shiftright("_h", shift).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
        cells = cells.withColumn("_n", F.sum("_c").over(whole)).withColumn("_before", F.sum("_c").over(upto) - F.col("_c"))
        cells = cells.withColumn("_want", F.least(take.cast("bigint"), F.col("_n")) if known is None else F.col("_want"))
        none = F.col("_want") <= 0
        at = (F.col("_before") < F.col("_want")) & (F.col("_want") <= F.col("_before") + F.col("_c"))
        cut = cells.filter(at | (none & (F.col("_before") == 0))).select(
            *names, F.when(none, -1).otherwise(F.col("_p")).alias("_prefix"), F.greatest(F.col("_want") - F.col("_before"), F.lit(0)).alias("_left"),
            F.when(none, 0).otherwise(F.col("_c")).alias("_c"), F.lit(shift).alias("_shift"))
        known, known_shift = materialise(cut, "cut-off-digits"), shift
        settled.append(known.filter("_left = _c or _left = 0"))
        if shift == 0 or known.filter("_left < _c and _left > 0").isEmpty():
            break
    bound = F.when(F.col("_prefix") < 0, F.lit(-1)).otherwise(F.expr("shiftleft(_prefix + 1, _shift) - 1"))
    resolved = reduce(DataFrame.unionByName, settled).select(*names, bound.alias("_bound"), F.lit(0).cast("bigint").alias("_left"))
    ties = known.filter("_left < _c and _left > 0")
    state = materialise(resolved.unionByName(ties.select(*names, F.col("_prefix").alias("_bound"), "_left")), "cut-offs")
    joined = _with_state(rows.select("*", *[F.col(quoted(c)).alias(n) for c, n in zip(by, names)]), state, names)
    clear = (F.col("_left") == 0) | (F.col("_h") != F.col("_bound"))
    if shift > 0 or ties.isEmpty():
        return joined.select(*own, (F.col("_h") <= F.col("_bound")).alias(flag))
    # rows whose first 60 bits are those of the cut-off: the whole hash and the key decide
    order = Window.partitionBy(*names, F.lit(0)).orderBy(hash_key(key, seed), F.col(quoted(key)))
    close = joined.filter(~clear).withColumn("_r", F.row_number().over(order))
    return joined.filter(clear).select(*own, (F.col("_h") <= F.col("_bound")).alias(flag)) \
        .unionByName(close.select(*own, (F.col("_r") <= F.col("_left")).alias(flag)))


def _with_state(rows: DataFrame, state: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows with the state of their group: broadcast where it is small, else joined by group and salt."""
    if not names:
        return rows.crossJoin(bounded_broadcast(state))     # one row
    renamed = state.select(*[F.col(n).alias(f"{n}_") for n in names], *[c for c in state.columns if c not in names])
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}_"))
    small = bounded_broadcast(renamed)
    if small is renamed:                                    # a hot group is spread over the salts
        rows = rows.withColumn("_salt", F.pmod("_h", F.lit(_SALTS)))
        small = renamed.withColumn("_salt_", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(_SALTS - 1).cast("bigint"))))
        same = same & (F.col("_salt") == F.col("_salt_"))
    return rows.join(small, same).drop("_salt", "_salt_", *[f"{n}_" for n in names])


def bounded_broadcast(small: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """The frame marked for broadcast if it has at most `max_rows` rows, else unchanged.

    Reads `max_rows + 1` rows to the driver to find out, and reuses them.
    """
    rows = small.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return small
    return F.broadcast(small.sparkSession.createDataFrame(rows, small.schema))


def deterministic_sample(df: DataFrame, n: int, key: str, seed: int = SEED,
                         digit_bits: int = DIGIT_BITS) -> DataFrame:
    """Exactly min(n, rows) rows without replacement, the same on every run."""
    take = F.least(F.lit(n).cast("bigint"), F.col("_n"))
    flagged = flag_first_by_hash(df, key, take, seed=seed, digit_bits=digit_bits)
    return flagged.filter("selected").drop("selected")


def fraction_sample(df: DataFrame, fraction: float, seed: int = SEED) -> DataFrame:
    """Roughly `fraction` of the rows; one pass, no shuffle."""
    return df.sample(fraction=fraction, seed=seed)


def stratified_split(df: DataFrame, target: str, key: str, validation: float = 0.2,
                     seed: int = SEED, digit_bits: int = DIGIT_BITS) -> DataFrame:
    """The table with a column `split`: every class gives the same share to validation."""
    take = F.floor(F.lit(validation) * F.col("_n") + 0.5)
    flagged = flag_first_by_hash(df, key, take, by=[target], seed=seed,
                                 digit_bits=digit_bits)
    return flagged.withColumn("split", F.when(F.col("selected"), "validation")
                              .otherwise("train")).drop("selected")
