"""Per-column aggregates of a wide table as long rows.

Each chunk of columns is one aggregation over only these columns, so a columnar
scan reads every byte once in total, whatever the number of chunks. A chunk holds
few enough aggregates that the JVM still compiles the generated loop: beyond some
thirty, the loop runs interpreted and is several times slower.
"""

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
AGGREGATES = 24


def per_column(df: DataFrame, names: Sequence[str], build: Callable[[str], dict[str, Column]],
               key: str = "feature", chunk: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One row `(ordinal, <key>, *build(name))` per column name (and per group of `by`).

    `build` returns plain aggregates; they are computed with partial aggregation, so
    one short row per task is all that is shuffled. Formulas over them belong on the
    resulting rows, where they are planned once and not once per column.
    """
    if not names:
        none = df.withColumn("_none", F.lit(None).cast("double"))
        return per_column(none, ["_none"], build, key, chunk, by).filter(F.lit(False))
    # inline_outer, as a plain inline makes the optimizer infer a size filter over all aggregates.
    parts = []
    indexed = list(enumerate(names))
    chunk = chunk or max(1, AGGREGATES // len(build(names[0])))
    for at in range(0, len(indexed), chunk):
        rows = [F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias(key),
                         *[e.alias(a) for a, e in build(n).items()])
                for i, n in indexed[at:at + chunk]]
        grouped = df.groupBy(*by) if by else df
        parts.append(grouped.agg(F.array(*rows).alias("_rows")).select(*by, F.inline_outer("_rows")))
    return reduce(DataFrame.unionByName, parts)


def long_form(df: DataFrame, values: dict[str, Column], keep: Sequence[Column] = (),
              key: str = "feature") -> DataFrame:
    """Rows `(*keep, <key>, value)`, one per input row and entry of `values`."""
    items = [F.struct(F.lit(n).alias(key), e.alias("value")) for n, e in values.items()]
    return df.select(*keep, F.inline(F.array(*items)))
