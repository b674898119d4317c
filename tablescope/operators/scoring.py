"""Quality signals per table or segment, and the scores made from them.

`signals` does the work in Spark, one row per segment; every score is a column
expression over these rows, so a million segments are scored as one projection.
"""

from collections.abc import Sequence
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.schema import (is_numeric, missing, num, numeric_columns, quoted,
                                         text_columns, value)
from tablescope.functions.stats import adjusted_skewness, grade, rounded
from tablescope.operators.adequacy import MIN_PER_CLASS, MIN_ROWS, ROWS_PER_FEATURE
from tablescope.operators.association import LEAK_CANDIDATE, REDUNDANT
from tablescope.operators.duplicates import copies_by
from tablescope.operators.comoments import comoments, correlation_of
from tablescope.operators.inference import (CURRENCY_MEAN, CURRENCY_SKEW, ID_NAMES, RSI_RANGE, SHARE,
                                            parse_date)
from tablescope.operators.missingness import MCAR_PCT, SIGNAL_CORR
from tablescope.operators.profile import (BINARY_CLASSES, FEW_CLASSES, FEW_CLASSES_RATIO,
                                          constant_flags)

# Weights of the scores.
SECTION_IMPACT = {"Data Completeness": "HIGH", "Data Integrity": "MEDIUM", "Feature Quality": "HIGH",
                  "Leakage Safety": "CRITICAL", "Sample Adequacy": "MEDIUM", "Missing Pattern": "MEDIUM"}
PATTERN_SCORE = {"NONE": 100, "MCAR": 80, "MAR": 50, "MNAR": 30}


def _total(flags: Sequence[Column]) -> Column:
    """How many of the conditions hold (a NULL condition does not)."""
    return reduce(add, [F.coalesce(f.cast("int"), F.lit(0)) for f in flags], F.lit(0))


def _join_by(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join two frames with one row per segment; missing segment keys match each other."""
    if not by:
        return a.crossJoin(b)                               # one row each
    renamed = b.select(*[F.col(quoted(c)).alias(f"_k{i}") for i, c in enumerate(by)],
                       *[F.col(quoted(c)) for c in b.columns if c not in by])
    same = reduce(lambda x, y: x & y,
                  [F.col(quoted(c)).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)])
    return a.join(renamed, same).drop(*[f"_k{i}" for i in range(len(by))])


def signals(df: DataFrame, target: str, by: Sequence[str] = (),
            id_names: Sequence[str] = ID_NAMES) -> DataFrame:
    """One row per segment with everything the scores need (one row with `by=()`).

    The columns in `by` name the segment and are not audited themselves. One small
    job finds the columns that have gaps at all. All moments, correlations, extremes and shares
    come from one pass; classes, repeated rows and (where an id is claimed) repeated ids from
    one more each, whatever the number of columns and segments. Two values count as equal where
    their 64-bit hashes agree, read as doubles.
    """
    by = list(by)
    df = df.select(*[F.col(quoted(c)) for c in df.columns])
    names = [c for c in df.columns if c not in by]
    features = [c for c in names if c != target]
    numeric = [c for c in numeric_columns(df, target) if c in names]
    text = [c for c in text_columns(df) if c in names]
    n_cols = len(names)

    gaps = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(missing(df, c), 1)).alias(f"m{i}") for i, c in enumerate(names)]).first()
    incomplete = [c for i, c in enumerate(names) if gaps[f"m{i}"] > 0]
    listwise = [c for i, c in enumerate(names) if c in numeric and gaps[f"m{i}"] < max(gaps["n"], 1)]

    plain = [c for c in numeric_columns(df) if c in names]
    hashed = [c for c in features if not isinstance(df.schema[c].dataType, T.MapType)]
    whole = reduce(and_, [num(c).isNotNull() for c in listwise], F.lit(True))
    evidence = {k: e for c in names for k, e in _evidence(df, c, c in text, id_names).items()}
    columns = {"row": F.lit(1.0)} | {f"num {c}": num(c) for c in numeric_columns(df, loose=True) if c in names} \
        | {f"gap {c}": missing(df, c).cast("double") for c in incomplete} \
        | {f"hash {c}": F.when(value(df, c).isNotNull(), F.xxhash64(_unsigned_zero(df, c))) for c in hashed} \
        | {f"whole {c}": F.when(whole, num(c)) for c in listwise} | evidence
    related = plain + [target] * (is_numeric(df, target) and target not in plain)
    pair_names = [f"gap {c}" for c in incomplete] + [f"num {c}" for c in related]
    single_names = ["row"] + [f"gap {c}" for c in incomplete] + [f"hash {c}" for c in hashed] + list(evidence)
    moments = comoments(df, columns, [pair_names, [f"whole {c}" for c in listwise]], single_names, by)
    if not by and not gaps["n"]:                            # one row also for a table without rows
        moments = df.sparkSession.createDataFrame([([], [])], moments.schema)

    def single(c: str) -> Column:
        return F.get("singles", F.lit(single_names.index(c)))

    # Every count is a filter over the two arrays, so the expressions do not grow with the columns either.
    n_gaps, n_plain = len(incomplete), len(plain)
    of_gaps, of_hashes = F.slice("singles", 2, n_gaps), F.slice("singles", 2 + n_gaps, len(hashed))
    constant = F.filter(of_hashes, lambda s: s["low"].eqNullSafe(s["high"]))
    strong = lambda p, limit: F.abs(correlation_of(p)) > limit
    leak = F.array()
    if is_numeric(df, target):
        t = F.lit(pair_names.index(f"num {target}"))
        feature = lambda k: (k >= n_gaps) & (k < n_gaps + n_plain) & (k != t)
        leak = F.filter("pairs", lambda p: (p["list"] == 0) & (((p["i"] == t) & feature(p["j"])) | ((p["j"] == t) & feature(p["i"])))
                        & strong(p, LEAK_CANDIDATE))
    redundant = F.filter("pairs", lambda p: (p["list"] == 1) & (p["i"] < p["j"])
                         & (F.abs(F.round(correlation_of(p), 4)) >= REDUNDANT))
    # a gap is explained by another column than its own; without gaps in the segment there is no correlation
    itself = F.array(*[F.lit(n_gaps + plain.index(c) if c in plain else -1) for c in incomplete]) if incomplete else F.array(F.lit(-1))
    used = F.array_distinct(F.transform(F.filter("pairs", lambda p: (p["list"] == 0) & (p["i"] < n_gaps) & (p["j"] >= n_gaps) & (
        p["j"] < n_gaps + n_plain) & (p["j"] != F.get(itself, p["i"])) & strong(p, SIGNAL_CORR)), lambda p: p["i"]))
    claims = [c for c in names if c not in text and f"bit {c}" in evidence]
    if claims:
        moments = _join_by(moments, _most_repeated(df, claims, by), by)
    warn = [_warning(c, single, claims, evidence) for c in names]
    cells = F.aggregate(of_gaps, F.lit(0).cast("bigint"), lambda total, s: total + F.round(F.coalesce(s["mean"], F.lit(0.0)) * s["n"]).cast("bigint"))
    base = moments.select(
        *by, F.coalesce(single("row")["n"], F.lit(0).cast("bigint")).alias("rows"), cells.alias("missing_total"),
        F.size(constant).alias("n_constant"), F.size(leak).alias("n_leak"), F.size(redundant).alias("n_redundant"),
        _total(warn).alias("n_type_warnings"), F.size(used).alias("n_signals"))
    raw_pct = F.col("missing_total") / F.greatest(F.col("rows") * n_cols, F.lit(1)) * 100
    base = base.withColumn("_pct", raw_pct).withColumn("missing_pct", rounded(raw_pct, 2))

    classes = (df.groupBy(*by, value(df, target).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
               .groupBy(*by).agg(F.count("_v").alias("_unique"),
                                 F.min(F.when(F.col("_v").isNotNull(), F.col("_n"))).alias("_min_class")))
    copies = copies_by(df, by)
    joined = _join_by(_join_by(base, classes, by), copies, by)

    needed = (n_cols - 1) * ROWS_PER_FEATURE
    unique = F.col("_unique")
    is_class = (F.lit(target in text) | (unique <= BINARY_CLASSES) | (
        (unique <= FEW_CLASSES) & (unique / F.greatest("rows", F.lit(1)) < FEW_CLASSES_RATIO)))
    enough = ((F.col("rows") >= needed) & (F.col("rows") >= MIN_ROWS)
              & (~is_class | F.coalesce(F.col("_min_class") >= MIN_PER_CLASS, F.lit(False))))
    pattern = (F.when(F.col("missing_total") == 0, "NONE").when(F.col("n_signals") > 0, "MAR")
               .when(F.col("_pct") < MCAR_PCT, "MCAR").otherwise("MNAR"))
    return joined.select(
        *by, "rows", F.lit(n_cols).alias("columns"), "missing_pct", "duplicate_rows", "n_constant",
        "n_leak", "n_redundant", "n_type_warnings", enough.alias("adequate"),
        F.least(F.lit(1.0), F.col("rows") / max(needed, 1)).alias("ratio"), pattern.alias("pattern"),
        F.when(is_class, "classification").otherwise("regression").alias("task_type"))


def _unsigned_zero(df: DataFrame, c: str) -> Column:
    floating = isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))
    return value(df, c) + F.lit(0.0) if floating else value(df, c)


def _evidence(df: DataFrame, c: str, is_text: bool, id_names: Sequence[str]) -> dict[str, Column]:
    """Row by row what a type warning of a column is decided from."""
    v, s = num(c), F.col(quoted(c))
    if is_text:
        return {f"date {c}": F.when(s.isNotNull(), parse_date(s).isNotNull().cast("double")),
                f"at {c}": s.contains("@").cast("double"), f"http {c}": s.startswith("http").cast("double")}
    if c not in numeric_columns(df, loose=True):
        return {}
    if c.lower() in id_names:
        return {f"id {c}": v, f"bit {c}": F.when(v.isNotNull(), v.isin(0.0, 1.0).cast("double"))}
    return {f"rsi {c}": v} if c.upper().endswith("RSI") else {}


def _most_repeated(df: DataFrame, claims: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Per segment and column that claims to be an id: how often its most frequent value occurs."""
    items = F.array(*[F.struct(F.lit(i).alias("_i"), value(df, c).cast("string").alias("_v")) for i, c in enumerate(claims)])
    counts = df.select(*[F.col(quoted(c)) for c in by], F.inline(items)).groupBy(*[quoted(c) for c in by], "_i", "_v").agg(
        F.count("_v").alias("_n"))
    return counts.groupBy(*[quoted(c) for c in by]).agg(*[F.max(F.when(F.col("_i") == i, F.col("_n"))).alias(f"_most {c}") for i, c in enumerate(claims)])


def _warning(c: str, single, claims: Sequence[str], evidence: dict[str, Column]) -> Column:
    """Whether a column gets a type warning, from the moments of its evidence."""
    if f"date {c}" in evidence:
        dates = F.coalesce(single(f"date {c}")["low"] == 1, F.lit(False))
        return ~dates & ((single(f"at {c}")["mean"] > SHARE) | (single(f"http {c}")["mean"] > SHARE))
    if c in claims:
        flag01 = (single(f"bit {c}")["low"] == 1) & (single(f"id {c}")["low"] < single(f"id {c}")["high"])
        return ~flag01 & (F.col(quoted(f"_most {c}")) == 1) & (single(f"id {c}")["n"] > 0)
    if f"rsi {c}" in evidence:
        m = single(f"rsi {c}")
        skew = F.sqrt(m["n"].cast("double")) * m["m3"] / F.nullif(F.pow(m["m2"], F.lit(1.5)), F.lit(0.0))
        money = F.coalesce((m["mean"] > CURRENCY_MEAN) & (adjusted_skewness(m["n"], skew) > CURRENCY_SKEW), F.lit(False))
        return ~money & ((m["low"] < RSI_RANGE[0]) | (m["high"] > RSI_RANGE[1]))
    return F.lit(False)


def health_score(of: DataFrame) -> DataFrame:
    """Five scores of 0 to 20, their total and grade, per row of `signals`."""
    c = F.col
    zero = F.lit(0).cast("bigint")
    repeated = c("duplicate_rows") / F.greatest(c("rows"), F.lit(1))
    scores = {
        "completeness": 20 - F.floor(c("missing_pct") * 0.6),
        "integrity": 20 - F.floor(repeated * 20) - F.least(c("n_constant") * 4, F.lit(10)),
        "leakage_safety": 20 - c("n_leak") * 10,
        "feature_quality": 20 - c("n_redundant") * 3 - c("n_type_warnings") * 2,
        "sample_adequacy": F.when(c("adequate"), F.lit(20)).otherwise(F.floor(c("ratio") * 20)),
    }
    scored = of.select("*", *[F.greatest(zero, e.cast("bigint")).alias(a) for a, e in scores.items()])
    scored = scored.withColumn("total", reduce(add, [c(a) for a in scores]))
    return scored.withColumn("grade", grade(c("total")))


def _sections(of: DataFrame) -> DataFrame:
    """`signals` with an array of (section, score as stored, grade, impact)."""
    c = F.col
    repeated = c("duplicate_rows") / F.greatest(c("rows"), F.lit(1)) * 100
    pattern = reduce(lambda acc, p: acc.when(c("pattern") == p, PATTERN_SCORE[p]),
                     PATTERN_SCORE, F.when(F.lit(False), 0))
    exact = {
        "Data Completeness": 100 - F.floor(c("missing_pct") * 2),
        "Data Integrity": 100 - repeated - c("n_constant") * 10,
        "Feature Quality": 100 - c("n_redundant") * 5 - c("n_type_warnings") * 10,
        "Leakage Safety": 100 - c("n_leak") * 25,
        "Sample Adequacy": F.when(c("adequate"), 100).otherwise(F.floor(c("ratio") * 100)),
        "Missing Pattern": pattern,
    }
    rows = []
    for name, score in exact.items():
        score = F.greatest(F.lit(0.0), score.cast("double"))
        rows.append(F.struct(F.lit(name).alias("section"), F.bround(score, 0).cast("bigint").alias("score"),
                             grade(score).alias("grade"), F.lit(SECTION_IMPACT[name]).alias("impact")))
    return of.withColumn("_sections", F.array(*rows))


def scorecard(of: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Six section rows per row of `signals`."""
    return _sections(of).select(*by, F.inline("_sections"))


def overall_grade(of: DataFrame) -> DataFrame:
    """`signals` with the mean section score, its grade and the displayed percentile."""
    total = F.aggregate("_sections", F.lit(0).cast("bigint"), lambda acc, s: acc + s["score"])
    scored = _sections(of).withColumn("overall_score", F.floor(total / 6)).drop("_sections")
    return (scored.withColumn("overall_grade", grade(F.col("overall_score")))
            .withColumn("percentile_text", F.least(F.lit(99), F.greatest(F.lit(1), F.col("overall_score")))))


def audit_flags(of: DataFrame, by: Sequence[str] = (), time_series: bool = False) -> DataFrame:
    """The alerts of each row of `signals`, one per row, with the number behind them."""
    c = F.col
    alerts = [("leakage", c("n_leak") > 0, c("n_leak")),
              ("time_series", F.lit(time_series), F.lit(1)),
              ("missing", c("missing_pct") > 10, c("missing_pct")),
              ("duplicates", c("duplicate_rows") > 0, c("duplicate_rows")),
              ("insufficient_samples", ~c("adequate"), c("ratio")),
              ("redundant_pairs", c("n_redundant") > 0, c("n_redundant"))]
    items = [F.when(on, F.struct(F.lit(name).alias("flag"), rounded(v.cast("double"), 4).alias("value")))
             for name, on, v in alerts]
    return of.select(*by, F.inline(F.filter(F.array(*items), lambda x: x.isNotNull())))
