"""What a column means: flags, ids, shares, money, dates, addresses; time series."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.schema import (datetime_columns, missing, num, numeric_columns, quoted,
                                         text_columns)
from tablescope.functions.stats import adjusted_skewness, rounded
from tablescope.functions.wide import per_column
from tablescope.operators.ordering import adjacent_gaps, instant, weighted_median

# Names, patterns, formats and limits.
ID_NAMES = ("id", "index", "row_id", "uid", "uuid", "customer_id", "user_id", "order_id")
DATE_FORMATS = {
    "yyyy-MM-dd": r"^\d{4}-\d\d-\d\d$",
    "yyyy-MM-dd HH:mm:ss": r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$",
    "yyyy-MM-dd HH:mm:ss.SSSSSS": r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{6}$",
    "yyyy-MM-dd'T'HH:mm:ss": r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$",
    "MM/dd/yyyy": r"^\d\d/\d\d/\d{4}$",
    "yyyy/MM/dd": r"^\d{4}/\d\d/\d\d$",
    "dd-MMM-yyyy": r"^\d\d-[A-Z][a-z]{2}-\d{4}$",
    "MMM d, yyyy": r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$",
}
ZIP_PATTERN = r"^\d{5}$"
SHARE = 0.5
MIN_SHARE_VALUES = 10
CURRENCY_MEAN, CURRENCY_SKEW = 1000, 1
RSI_RANGE = (0, 100)
TIME_COLUMN_SHARE = 0.9


def parse_date(c: Column) -> Column:
    """Text as timestamp under the explicit format list, NULL when none fits.

    The parser is slow on text that does not fit, so it only sees text of the right form.
    """
    parsed = None
    for fmt, form in DATE_FORMATS.items():
        parsed = (F.when if parsed is None else parsed.when)(
            c.rlike(form), F.try_to_timestamp(c, F.lit(fmt)))
    return parsed


def infer_types(df: DataFrame, id_names: Sequence[str] = ID_NAMES) -> DataFrame:
    """Meaning, flag and advice per column that has any value; first match wins.

    One pass for numeric moments, one for text shares. Distinct values are counted
    only where a rule asks for them (id names, and values between 0 and 1).
    """
    numeric = numeric_columns(df, loose=True)
    text = text_columns(df)
    empty = {"d": F.lit(None).cast("double"), "b": F.lit(None).cast("boolean")}

    def build(c: str) -> dict[str, Column]:
        known = c in df.columns
        out = {"dtype": F.lit(df.schema[c].dataType.simpleString() if known else ""),
               "n": F.count(F.when(~missing(df, c), 1)) if known else F.count(c)}
        v, s = num(c), F.col(quoted(c))
        is_num, is_text = c in numeric, c in text
        out["lowest"] = F.min(v) if is_num else empty["d"]
        out["highest"] = F.max(v) if is_num else empty["d"]
        out["mean"] = F.avg(v) if is_num else empty["d"]
        out["g1"] = F.skewness(v) if is_num else empty["d"]
        out["only_01"] = F.bool_and(v.isin(0.0, 1.0)) if is_num else empty["b"]
        out["all_dates"] = F.bool_and(F.when(s.isNotNull(), parse_date(s).isNotNull())) \
            if is_text else empty["b"]
        out["at"] = F.avg(s.contains("@").cast("double")) if is_text else empty["d"]
        out["http"] = F.avg(s.startswith("http").cast("double")) if is_text else empty["d"]
        out["zip"] = F.avg(s.rlike(ZIP_PATTERN).cast("double")) if is_text else empty["d"]
        return out
    stats = per_column(df, df.columns, build, key="column", chunk=4).filter("n > 0")
    stats = stats.withColumn("skew", adjusted_skewness(F.col("n"), F.col("g1")))
    distinct = _needed_distinct(df, numeric, id_names)
    stats = stats.join(distinct, "column", "left")          # one row per column on both sides
    is_num = F.col("column").isin(numeric) if numeric else F.lit(False)
    is_text = F.col("column").isin(text) if text else F.lit(False)
    return _verdict(stats, is_num, is_text, id_names).select(
        "ordinal", "column", "dtype", "inferred", "flag", "recommendation",
        F.col("flag").isin("Should be dropped", "Data quality issue", "Drop", "Drop or extract domain")
        .alias("warning"))


def _needed_distinct(df: DataFrame, numeric, id_names) -> DataFrame:
    items = []
    for c in numeric:
        v = num(c) if not isinstance(df.schema[c].dataType, T.LongType) else F.col(quoted(c))
        wanted = F.lit(True) if c.lower() in id_names else v.between(0, 1)
        # As text, so that whole numbers keep all their digits next to doubles.
        items.append(F.struct(F.lit(c).alias("column"),
                              F.when(wanted, v).cast("string").alias("v")))
    if not items:
        return df.sparkSession.createDataFrame([], "column string, n_distinct bigint")
    return (df.select(F.inline(F.array(*items))).filter("v is not null")
            .groupBy("column", "v").agg(F.lit(1).alias("_one"))
            .groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct")))


def _verdict(stats: DataFrame, is_num: Column, is_text: Column, id_names) -> DataFrame:
    c = F.col
    unique_id = (c("n_distinct") == c("n")) & F.lower("column").isin(*id_names)
    out_of_range = F.upper("column").endswith("RSI") & (
        (c("lowest") < RSI_RANGE[0]) | (c("highest") > RSI_RANGE[1]))
    rules = [
        (is_num & c("only_01") & (c("lowest") < c("highest")),
         "Binary Flag (0/1)", "Categorical stored as numeric", "Treat as categorical"),
        (is_num & unique_id, "ID Column", "Should be dropped", "Drop: unique per row"),
        (is_num & (c("lowest") >= 0) & (c("highest") <= 1) & (c("n_distinct") > MIN_SHARE_VALUES),
         "Percentage (0-1)", "Numeric: OK", "Multiply by 100 for readability"),
        (is_num & (c("mean") > CURRENCY_MEAN) & (c("skew") > CURRENCY_SKEW),
         "Possible Currency / Revenue", "Consider log transform", "Apply log1p"),
        (is_num & out_of_range, "RSI: Corrupted Range", "Data quality issue", "Check data source"),
        (is_text & c("all_dates"), "Date / Datetime", "Parse as datetime", "Extract date parts"),
        (is_text & (c("at") > SHARE), "Email Address", "Drop or extract domain", "Extract domain or drop"),
        (is_text & (c("http") > SHARE), "URL", "Drop", "Drop this column"),
        (is_text & (c("zip") > SHARE), "ZIP Code", "Treat as categorical", "Group into regions"),
    ]
    picked = None
    for test, *texts in rules:
        item = F.array(*map(F.lit, texts))
        picked = (F.when if picked is None else picked.when)(F.coalesce(test, F.lit(False)), item)
    picked = picked.otherwise(F.array(c("dtype"), F.lit("OK"), F.lit("No action needed")))
    stats = stats.withColumn("_p", picked)
    return (stats.withColumn("inferred", c("_p")[0]).withColumn("flag", c("_p")[1])
            .withColumn("recommendation", c("_p")[2]))


def type_warnings(df: DataFrame, id_names: Sequence[str] = ID_NAMES) -> DataFrame:
    return infer_types(df, id_names).filter("warning").select("column", "inferred")


def frequency_label(days: Column) -> Column:
    return (F.when(days == 1, "Daily").when(days == 7, "Weekly")
            .when((days >= 28) & (days <= 31), "Monthly").when(days == 0, "Sub-daily")
            .otherwise(F.concat(F.lit("~"), days.cast("string"), F.lit("-day intervals"))))


def find_time_column(df: DataFrame) -> str | None:
    """First column that is a datetime, or text that is nearly complete and all dates."""
    typed = datetime_columns(df)
    text = []
    for c in df.columns:
        if c in typed:
            break
        if c in text_columns(df):
            text.append(c)
    if text:
        row = df.agg(*[F.struct(
            F.bool_and(F.when(F.col(quoted(c)).isNotNull(), parse_date(F.col(quoted(c))).isNotNull())),
            F.avg(F.col(quoted(c)).isNotNull().cast("double"))) for c in text]).first()
        for c, (dates, share) in zip(text, row):
            if dates and share > TIME_COLUMN_SHARE:
                return c
    return typed[0] if typed else None


def frequency_guess(df: DataFrame, column: str) -> DataFrame:
    """Median gap between neighbours in time, as whole days and as a name."""
    if column in text_columns(df):
        micros = F.unix_micros(parse_date(F.col(quoted(column))).cast("timestamp"))
    else:
        micros = instant(df, column)
    gaps = adjacent_gaps(df.select(micros.alias("v")).filter("v is not null"))
    median = weighted_median(gaps)
    days = None if median is None else int(median // 86_400_000_000)
    frame = df.sparkSession.createDataFrame([(days,)], "median_days bigint")
    return frame.select(F.lit(column).alias("datetime_column"), "median_days",
                        F.when(F.col("median_days").isNotNull(),
                               frequency_label(F.col("median_days"))).alias("frequency_guess"))


def detect_timeseries(df: DataFrame) -> DataFrame:
    """One row: is there a time column, which one, and how often it ticks. Runs Spark jobs."""
    found = find_time_column(df)
    if found is None:
        return df.sparkSession.createDataFrame(
            [(False, None, None)],
            "is_timeseries boolean, datetime_column string, frequency_guess string")
    return frequency_guess(df, found).select(
        F.lit(True).alias("is_timeseries"), "datetime_column", "frequency_guess")


def datetime_text_columns(df: DataFrame) -> list[str]:
    """Text columns whose values are all dates (one job)."""
    return [r.column for r in infer_types(df).filter("inferred = 'Date / Datetime'")
            .orderBy("ordinal").collect()]
