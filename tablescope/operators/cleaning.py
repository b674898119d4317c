"""Automatic fixes. The order of the steps decides the result and is part of the contract."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.schema import (categorical_columns, missing, nan_to_null, num,
                                         numeric_columns, quoted, value)
from tablescope.operators.association import drop_suggestions
from tablescope.operators.duplicates import drop_duplicate_rows, duplicate_rows, repeated_digests
from tablescope.operators.inference import ID_NAMES, infer_types
from tablescope.operators.profile import constant_features, iqr_bounds
from tablescope.operators.quantiles import quantiles
from tablescope.sources.tables import materialise


@dataclass(frozen=True)
class CleanOptions:
    drop_constant: bool = True
    drop_id_cols: bool = True
    drop_redundant: bool = True
    drop_duplicates: bool = True
    impute_missing: bool = True
    cap_outliers: bool = True
    impute_target: bool = True


def drop_columns(df: DataFrame, names) -> DataFrame:
    """Without the named columns; names the table does not have are ignored."""
    return df.drop(*names)


def id_columns(df: DataFrame, target: str | None, id_names=ID_NAMES) -> list[str]:
    """Columns recognised as identifiers, the target left out. Looks at id-named columns only."""
    named = [c for c in numeric_columns(df, loose=True) if c.lower() in id_names and c != target]
    if not named:
        return []
    found = infer_types(df.select(*[F.col(quoted(c)) for c in named]), id_names)
    return [r.column for r in found.filter("inferred = 'ID Column'").collect()]


def modes(df: DataFrame, names: list[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest one on ties, None for no values.

    Values are counted by a shuffle with a partial count, then reduced to one row
    per column; no task holds the values of a column.
    """
    out = {}
    for c in names:
        counted = (df.groupBy(value(df, c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
                   .filter("v is not null"))
        best = counted.agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("v")))).first()[0]
        out[c] = None if best is None else best.v
    return out


def impute(df: DataFrame, target: str | None = None, impute_target: bool = True) -> DataFrame:
    """Numeric gaps become the exact median, others the most frequent value. Runs Spark jobs.

    A filled numeric column is double, whatever it was.
    """
    skip = set() if impute_target else {target}
    return _impute(df, skip)[0]


def _impute(df: DataFrame, skip=frozenset()) -> tuple[DataFrame, dict[str, int]]:
    names = [c for c in df.columns if c not in skip]
    gaps = df.agg(*[F.count(F.when(missing(df, c), 1)).alias(f"m{i}")
                    for i, c in enumerate(names)]).first() if names else ()
    holes = {c: gaps[i] for i, c in enumerate(names) if gaps[i]}
    numeric = [c for c in numeric_columns(df) if c in holes]
    other = [c for c in categorical_columns(df) if c in holes]
    medians = quantiles(df, numeric, [0.5])
    common = modes(df, other)
    out = []
    for f in df.schema.fields:
        c = value(df, f.name)
        if f.name in numeric:
            c = F.coalesce(num(f.name), F.lit(medians[f.name][0]).cast("double"))
        elif f.name in other:
            fill = common[f.name]
            if fill is not None:
                c = F.coalesce(c, F.lit(fill).cast(f.dataType))
            elif isinstance(f.dataType, T.StringType):
                c = F.coalesce(c, F.lit("Unknown"))
        out.append(c.alias(f.name))
    return df.select(out), {"numeric": sum(holes[c] for c in numeric),
                            "categorical": sum(holes[c] for c in other)}


def cap_outliers(df: DataFrame, target: str | None = None) -> DataFrame:
    """Numeric features clipped to 1.5 interquartile ranges. Runs Spark jobs."""
    return _cap(df, target)[0]


def _cap(df: DataFrame, target: str | None) -> tuple[DataFrame, list[str]]:
    bounds = iqr_bounds(df, numeric_columns(df, target))
    if not bounds:
        return df, []
    names = list(bounds)
    hit = df.agg(*[F.coalesce(F.max((num(c) < bounds[c][2]) | (num(c) > bounds[c][3])), F.lit(False))
                   .alias(f"h{i}") for i, c in enumerate(names)]).first()
    capped = [c for i, c in enumerate(names) if hit[i]]
    cols = [F.when(num(c).isNotNull(), F.least(F.greatest(num(c), F.lit(float(bounds[c][2]))),
                                               F.lit(float(bounds[c][3])))).alias(c)
            if c in capped else F.col(quoted(c)) for c in df.columns]
    return df.select(cols), capped


def clean(df: DataFrame, target: str, options: CleanOptions = CleanOptions(),
          id_names=ID_NAMES) -> tuple[DataFrame, DataFrame]:
    """The fixed table and a log of the steps taken: `(step, action, n, columns)`.

    Runs Spark jobs. Duplicate removal changes what later steps see, so where rows repeat its
    result is written once to the shared folder and read back column by column.
    """
    actions = []
    # Ids and redundant features are judged on the table as it came in.
    ids = id_columns(df, target, id_names) if options.drop_id_cols else []
    redundant = sorted(r.feature for r in drop_suggestions(df, target).collect()) \
        if options.drop_redundant else []
    fixed = nan_to_null(df)
    if options.drop_constant:
        found = {r.feature for r in constant_features(df, target).collect()}
        const = [c for c in fixed.columns if c in found]
        fixed = fixed.drop(*const)
        actions.append(("drop_constant", len(const), const))
    if options.drop_id_cols:
        ids = [c for c in ids if c in fixed.columns]
        fixed = fixed.drop(*ids)
        actions.append(("drop_id", len(ids), ids))
    if options.drop_redundant:
        redundant = [c for c in redundant if c in fixed.columns and c != target]
        fixed = fixed.drop(*redundant)
        actions.append(("drop_redundant", len(redundant), redundant))
    if options.drop_duplicates:
        removed, repeated = 0, repeated_digests(fixed)
        if repeated is not None:                            # nothing is written where nothing repeats
            removed = duplicate_rows(fixed).first()[0]
            fixed = materialise(drop_duplicate_rows(fixed, repeated), "deduplicated") if removed else fixed
        actions.append(("drop_duplicates", removed, []))
    if options.impute_missing:
        fixed, n = _impute(fixed, set() if options.impute_target else {target})
        actions.append(("impute_numeric", n["numeric"], []))
        actions.append(("impute_categorical", n["categorical"], []))
    if options.cap_outliers:
        fixed, capped = _cap(fixed, target)
        actions.append(("cap_outliers", len(capped), capped))
    rows = [(i + 1, a, n, ",".join(cols)) for i, (a, n, cols) in enumerate(
        [a for a in actions if a[1]] or [("already_clean", 0, [])])]
    log = df.sparkSession.createDataFrame(rows, "step int, action string, n bigint, columns string")
    return fixed, log
