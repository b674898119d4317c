"""Which columns count as numeric, categorical, text or datetime.

Schema order is kept everywhere, because ties are settled by it and an
optional `max_columns` argument takes the first features.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
            T.FloatType, T.DoubleType, T.DecimalType)
_FLOATING = (T.FloatType, T.DoubleType)
_DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


def numeric_columns(df: DataFrame, target: str | None = None, loose: bool = False) -> list[str]:
    """Numeric features without the target; `loose` lets booleans in as 0/1."""
    kinds = _NUMERIC + ((T.BooleanType,) if loose else ())
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, kinds) and f.name != target]


def categorical_columns(df: DataFrame, target: str | None = None) -> list[str]:
    """Everything that is not a numeric feature, so booleans and datetimes too."""
    return [f.name for f in df.schema.fields
            if not isinstance(f.dataType, _NUMERIC) and f.name != target]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _DATETIME)]


def is_numeric(df: DataFrame, name: str, loose: bool = True) -> bool:
    return name in numeric_columns(df, loose=loose)


def split_columns(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row per column: its position, type and the group it falls in."""
    numeric = set(numeric_columns(df))
    rows = [(i, f.name, f.dataType.simpleString(),
             "target" if f.name == target else "numeric" if f.name in numeric else "categorical")
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "ordinal int, column string, dtype string, kind string")


def resolve_target(df: DataFrame, target: str | None = None) -> str:
    """The named target, else the last column of the table."""
    if target is None:
        return df.columns[-1]
    if target not in df.columns:
        raise ValueError(f"no column named {target!r}; have {df.columns}")
    return target


def value(df: DataFrame, name: str):
    """Column `name` in its own type, with NaN read as missing."""
    if isinstance(df.schema[name].dataType, _FLOATING):
        return F.expr(f"if(isnan({quoted(name)}), null, {quoted(name)})")
    return F.col(quoted(name))


def num(name: str):
    """Numeric column `name` as double, with NaN read as missing and -0.0 as 0.0."""
    return F.expr(f"nanvl(cast({quoted(name)} as double), cast(null as double)) + 0.0D")


def missing(df: DataFrame, name: str):
    """True where the value counts as missing (NULL, or NaN in a float column)."""
    if isinstance(df.schema[name].dataType, _FLOATING):
        return F.expr(f"{quoted(name)} is null or isnan({quoted(name)})")
    return F.expr(f"{quoted(name)} is null")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every float column; other columns pass untouched."""
    if not any(isinstance(f.dataType, _FLOATING) for f in df.schema.fields):
        return df
    return df.select([value(df, c).alias(c) for c in df.columns])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
