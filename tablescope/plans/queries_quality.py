"""Checked queries: signals, scores, cleaning, outliers, findings."""

from pyspark.sql import functions as F

from tablescope.operators import cleaning, outliers, scoring
from tablescope.plans import audit
from tablescope.plans.fixtures import view
from tablescope.plans.oracle import corr, d, grade, rnd, union, with_views
from tablescope.plans.queries import query, table
from tablescope.plans.queries_association import MAR, pattern_sql
from tablescope.sources import tables

# --- signals and scores ----------------------------------------------------------------------

_SEG_FEATURES = ["l_quantity", "l_tax", "const_col", "l_discount", "l_copy"]
_SEG_OTHERS = ["l_quantity", "l_tax", "l_extendedprice", "const_col", "l_copy"]


def _flags(tests) -> str:
    return " + ".join(f"(case when {t} then 1 else 0 end)" for t in tests)


def _signals(by: str | None) -> str:
    """CTEs ending in `sig`: one row per segment of fx_seg (or one row)."""
    whole = {c: f"(case when l_discount is not null then {d(c)} end)" for c in _SEG_FEATURES}
    pairs = [f"abs(round({corr(whole[a], whole[b])}, 4)) >= 0.85"
             for i, a in enumerate(_SEG_FEATURES) for b in _SEG_FEATURES[i + 1:]]
    if by is None:                                          # the flag is a feature of the whole table
        constant = _SEG_FEATURES + ["l_returnflag"]
        columns, needed = 7, 60
    else:
        constant, columns, needed = _SEG_FEATURES, 6, 50
    key = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    join = f"join dup using ({by})" if by else ", dup"
    return f"""
base as (select {key}count(*) as rows, count(*) - count(l_discount) as miss,
    {_flags(f'count(distinct {c}) <= 1' for c in constant)} as n_constant,
    {_flags(f"abs({corr(c, 'l_extendedprice')}) > 0.95" for c in _SEG_FEATURES)} as n_leak,
    {_flags(pairs)} as n_redundant,
    {_flags(f"abs({corr('(case when l_discount is null then 1.0 else 0.0 end)', c)}) > 0.2"
            for c in _SEG_OTHERS)} as hits, count(distinct l_extendedprice) as n_unique
    from fx_seg {group}),
dup as (select {key}cast(sum(n - 1) as bigint) as duplicate_rows
        from (select *, count(*) as n from fx_seg group by all) {group}),
sig as (select {key}rows, {columns} as columns,
    {rnd(f'miss * 1.0::double / (rows * {columns}) * 100', 2)} as missing_pct, duplicate_rows, n_constant, n_leak,
    n_redundant, 0 as n_type_warnings, rows >= {needed} and rows >= 100 as adequate,
    least(1.0::double, rows * 1.0::double / {needed}) as ratio,
    case when miss = 0 then 'NONE' when hits > 0 then 'MAR'
         when miss * 1.0::double / (rows * {columns}) * 100 < 5 then 'MCAR' else 'MNAR' end as pattern,
    'regression' as task_type from base {join})"""


_SIG = with_views("fx_seg", extra=[_signals("l_returnflag")])
_SIG_ALL = with_views("fx_seg", extra=[_signals(None)])


@query("signals_by_segment", _SIG + "select * from sig")
def _(spark, sf):
    return scoring.signals(view(spark, sf, "fx_seg"), "l_extendedprice", by=["l_returnflag"])


@query("signals", _SIG_ALL + "select * from sig")
def _(spark, sf):
    return scoring.signals(view(spark, sf, "fx_seg"), "l_extendedprice")


_HEALTH = """
health as (select *, completeness + integrity + leakage_safety + feature_quality + sample_adequacy as total
  from (select *,
    greatest(0, cast(20 - floor(missing_pct * 0.6::double) as bigint)) as completeness,
    greatest(0, cast(20 - floor(duplicate_rows * 1.0::double / rows * 20) - least(n_constant * 4, 10) as bigint))
        as integrity,
    cast(greatest(0, 20 - n_leak * 10) as bigint) as leakage_safety,
    cast(greatest(0, 20 - n_redundant * 3 - n_type_warnings * 2) as bigint) as feature_quality,
    cast(case when adequate then 20 else greatest(0, floor(ratio * 20)) end as bigint) as sample_adequacy
    from sig))"""


@query("health_score", _SIG + "," + _HEALTH + f"select *, {grade('total')} as grade from health")
def _(spark, sf):
    return scoring.health_score(
        scoring.signals(view(spark, sf, "fx_seg"), "l_extendedprice", by=["l_returnflag"]))


_SECTIONS = """
sec as (select * from (
    select l_returnflag, 'Data Completeness' as section, greatest(0.0, 100 - floor(missing_pct * 2)) as s,
           'HIGH' as impact from sig
    union all select l_returnflag, 'Data Integrity',
           greatest(0.0, 100 - duplicate_rows * 1.0::double / rows * 100 - n_constant * 10), 'MEDIUM' from sig
    union all select l_returnflag, 'Feature Quality',
           greatest(0.0, 100 - n_redundant * 5 - n_type_warnings * 10), 'HIGH' from sig
    union all select l_returnflag, 'Leakage Safety', greatest(0.0, 100 - n_leak * 25), 'CRITICAL' from sig
    union all select l_returnflag, 'Sample Adequacy',
           case when adequate then 100.0 else floor(ratio * 100) end, 'MEDIUM' from sig
    union all select l_returnflag, 'Missing Pattern', case pattern when 'NONE' then 100.0 when 'MCAR' then 80.0
           when 'MAR' then 50.0 else 30.0 end, 'MEDIUM' from sig))"""


@query("scorecard", _SIG + "," + _SECTIONS + f"""
    select l_returnflag, section, cast(round_even(s, 0) as bigint) as score, {grade('s')} as grade, impact from sec""")
def _(spark, sf):
    return scoring.scorecard(
        scoring.signals(view(spark, sf, "fx_seg"), "l_extendedprice", by=["l_returnflag"]), ["l_returnflag"])


@query("overall_grade", _SIG + "," + _SECTIONS + f"""
    select l_returnflag, overall_score, {grade('overall_score')} as overall_grade,
           least(99, greatest(1, overall_score)) as percentile_text
    from (select l_returnflag, cast(floor(sum(cast(round_even(s, 0) as bigint)) / 6.0) as bigint) as overall_score
          from sec group by 1)""")
def _(spark, sf):
    signals = scoring.signals(view(spark, sf, "fx_seg"), "l_extendedprice", by=["l_returnflag"])
    return scoring.overall_grade(signals).select("l_returnflag", "overall_score", "overall_grade",
                                                 "percentile_text")


@query("audit_flags", _SIG + """
    select l_returnflag, flag, round(v, 4) + 0.0 as value from (
        select l_returnflag, 'leakage' as flag, n_leak > 0 as f, cast(n_leak as double) as v from sig
        union all select l_returnflag, 'missing', missing_pct > 10, missing_pct from sig
        union all select l_returnflag, 'duplicates', duplicate_rows > 0, cast(duplicate_rows as double) from sig
        union all select l_returnflag, 'insufficient_samples', not adequate, ratio from sig
        union all select l_returnflag, 'redundant_pairs', n_redundant > 0, cast(n_redundant as double) from sig)
    where f""")
def _(spark, sf):
    signals = scoring.signals(view(spark, sf, "fx_seg"), "l_extendedprice", by=["l_returnflag"])
    return scoring.audit_flags(signals, ["l_returnflag"])


# --- cleaning --------------------------------------------------------------------------------

@query("drop_columns", "select * exclude (l_shipdate) from lineitem")
def _(spark, sf):
    return cleaning.drop_columns(table(spark, sf, "lineitem"), ["l_shipdate", "no_such"])


@query("drop_duplicate_rows", with_views("fx_dups") + "select distinct * from fx_dups")
def _(spark, sf):
    return cleaning.drop_duplicate_rows(view(spark, sf, "fx_dups"))


def _mode(source: str, c: str) -> str:
    return (f"(select {c} from (select {c}, count(*) as n from {source} where {c} is not null group by 1) "
            f"order by n desc, {c} limit 1)")


@query("impute", with_views("fx_nulls") + f"""
    select l_orderkey, l_linenumber, l_partkey,
           coalesce(l_quantity, (select median(l_quantity) from fx_nulls)) as l_quantity,
           coalesce(l_discount, (select median(l_discount) from fx_nulls)) as l_discount,
           coalesce(l_returnflag, {_mode('fx_nulls', 'l_returnflag')}) as l_returnflag from fx_nulls""")
def _(spark, sf):
    return cleaning.impute(view(spark, sf, "fx_nulls").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_returnflag"))


def _cap(source: str, c: str) -> str:
    q1, q3 = (f"(select quantile_cont({d(c)}, {p}) from {source})" for p in (0.25, 0.75))
    return (f"least(greatest({d(c)}, {q1} - 1.5 * ({q3} - {q1})), {q3} + 1.5 * ({q3} - {q1}))")


@query("cap_outliers", f"select doc_id, {_cap('documents', 'n_chars')} as n_chars from documents")
def _(spark, sf):
    return cleaning.cap_outliers(table(spark, sf, "documents").select("doc_id", "n_chars"))


@query("modes", union([f"select '{c}' as feature, {_mode('lineitem', c)} as mode"
                       for c in ("l_returnflag", "l_linestatus")]))
def _(spark, sf):
    found = cleaning.modes(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])
    return spark.createDataFrame(list(found.items()), "feature string, mode string")


# fx_dirty: 'same' is constant, customer_id repeats so it stays, both c_triple columns follow c_acctbal.
_KEPT = "customer_id, c_nationkey, c_mktsegment, c_acctbal, segment2, c_spiky"
_CLEAN = with_views("fx_dirty") + f""", kept as (select distinct {_KEPT} from fx_dirty),
    filled as (select customer_id, c_nationkey, c_mktsegment,
        coalesce(c_acctbal, (select median(c_acctbal) from kept)) as c_acctbal,
        coalesce(segment2, {_mode('kept', 'segment2')}) as segment2, c_spiky from kept)
"""


@query("clean", _CLEAN + f"""
    select customer_id, c_nationkey, c_mktsegment, c_acctbal, segment2, {_cap('filled', 'c_spiky')} as c_spiky
    from filled""")
def _(spark, sf):
    return cleaning.clean(view(spark, sf, "fx_dirty"), "c_nationkey")[0]


@query("clean_actions", _CLEAN + """
    select 1 as step, 'drop_constant' as action, cast(1 as bigint) as n, 'same' as columns
    union all select 2, 'drop_redundant', 2, 'c_triple,c_triple2'
    union all select 3, 'drop_duplicates', (select count(*) from fx_dirty) - (select count(*) from kept), ''
    union all select 4, 'impute_numeric', (select count(*) from kept where c_acctbal is null), ''
    union all select 5, 'impute_categorical', (select count(*) from kept where segment2 is null), ''
    union all select 6, 'cap_outliers', 1, 'c_spiky'""")
def _(spark, sf):
    return cleaning.clean(view(spark, sf, "fx_dirty"), "c_nationkey")[1]


# --- outliers --------------------------------------------------------------------------------

# Closed form for two features.
_TWO = """m as (select avg(cast(n_chars as double)) as ma, avg(cast(doc_id as double)) as mb,
        var_samp(cast(n_chars as double)) as va, var_samp(cast(doc_id as double)) as vb,
        covar_samp(cast(n_chars as double), cast(doc_id as double)) as cab from documents),
    sc as (select cast(doc_id as double) as doc_id, cast(n_chars as double) as n_chars,
        (vb * (n_chars - ma) * (n_chars - ma) - 2 * cab * (n_chars - ma) * (doc_id - mb)
         + va * (doc_id - mb) * (doc_id - mb)) / (va * vb - cab * cab) as d2 from documents, m),
    fl as (select *, d2 > (select quantile_cont(d2, 0.95) from sc) as is_outlier from sc)"""
_DR = union([f"select '{c}' as feature, avg(case when is_outlier then {c} end) as o, "
             f"avg(case when not is_outlier then {c} end) as n from fl" for c in ("doc_id", "n_chars")])


@query("mahalanobis_scores", f"with {_TWO} select doc_id, n_chars, {rnd('d2', 6)} as d2 from sc")
def _(spark, sf):
    scores = outliers.mahalanobis_scores(table(spark, sf, "documents"), robust=False)
    return scores.withColumn("d2", F.round("d2", 6) + F.lit(0.0))


@query("outlier_rows", f"with {_TWO} select doc_id, n_chars, is_outlier from fl")
def _(spark, sf):
    return outliers.outlier_rows(table(spark, sf, "documents"), robust=False).drop("d2")


@query("outlier_drivers", f"""with {_TWO} select feature, {rnd('o', 4)} as outlier_mean, {rnd('n', 4)} as normal_mean,
    {rnd('abs(o - n) / (abs(n) + 0.00000001::double) * 100', 1)} as shift_pct,
    abs(o - n) / (abs(n) + 0.00000001::double) * 100 > 50 as major_driver from ({_DR})""")
def _(spark, sf):
    return outliers.outlier_drivers(outliers.outlier_rows(table(spark, sf, "documents"), robust=False))


@query("top_scores", f"with {_TWO} select {rnd('d2', 4)} as d2 from sc order by sc.d2 desc limit 20")
def _(spark, sf):
    return outliers.top_scores(outliers.mahalanobis_scores(table(spark, sf, "documents"), robust=False))


# Closed form for three features: the adjugate of the covariance.
_KEYS, _THREE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_quantity", "l_extendedprice", "l_discount"]


@query("outliers_by_key", f"""
    with m as (select avg(l_quantity) as ma, avg(l_extendedprice) as mb, avg(l_discount) as mc,
        var_samp(l_quantity) as aa, var_samp(l_extendedprice) as bb, var_samp(l_discount) as cc,
        covar_samp(l_quantity, l_extendedprice) as ab, covar_samp(l_quantity, l_discount) as ac,
        covar_samp(l_extendedprice, l_discount) as bc from lineitem),
    z as (select {', '.join(_KEYS)}, l_quantity - ma as a, l_extendedprice - mb as b, l_discount - mc as c, m.* from lineitem, m),
    sc as (select {', '.join(_KEYS)}, (a * a * (bb * cc - bc * bc) + b * b * (aa * cc - ac * ac) + c * c * (aa * bb - ab * ab)
        + 2 * a * b * (ac * bc - ab * cc) + 2 * a * c * (ab * bc - ac * bb) + 2 * b * c * (ab * ac - aa * bc))
        / (aa * (bb * cc - bc * bc) - ab * (ab * cc - ac * bc) + ac * (ab * bc - ac * bb)) as d2 from z)
    select {', '.join(_KEYS)}, {rnd('d2', 6)} as d2 from sc where sc.d2 > (select quantile_cont(d2, 0.95) from sc)""")
def _(spark, sf):
    flagged = outliers.outlier_rows(table(spark, sf, "lineitem"), robust=False, features=_THREE, keep=_KEYS)
    return flagged.filter("is_outlier").select(*_KEYS, (F.round("d2", 6) + F.lit(0.0)).alias("d2"))


@query("outlier_summary", f"""with {_TWO}, dr as (select feature,
        abs(o - n) / (abs(n) + 0.00000001::double) * 100 as s from ({_DR})),
    iq as (select quantile_cont(n_chars, 0.25) as a, quantile_cont(n_chars, 0.75) as b from documents)
    select (select count(*) filter (where is_outlier) from fl) as n_outliers, pct as pct_outliers,
           coalesce((select string_agg(feature, ',' order by s desc) from dr where s > 50), '') as top_drivers,
           (select count(distinct 1) from documents, iq where n_chars < a - 1.5 * (b - a)
            or n_chars > b + 1.5 * (b - a)) as n_iqr_columns,
           case when pct < 3 then 'clean' when pct < 8 then 'moderate' else 'significant' end as verdict
    from (select {rnd('count(*) filter (where is_outlier) * 1.0::double / count(*) * 100', 1)} as pct from fl)""")
def _(spark, sf):
    return outliers.outlier_summary(table(spark, sf, "documents"), robust=False)


@query("outlier_rows_robust")
def _(spark, sf):
    flagged = outliers.outlier_rows(view(spark, sf, "fx_nulls").select(
        "l_quantity", "l_discount", "l_extendedprice", "l_tax"), robust=True)
    return flagged.groupBy("is_outlier").agg(F.count(F.lit(1)).alias("n"), F.max("d2").alias("max_d2"))


@query("outlier_rows_chi_square")
def _(spark, sf):
    flagged = outliers.outlier_rows(table(spark, sf, "events").select("user_id", "value"),
                                    robust=True, contamination=None)
    return flagged.groupBy("is_outlier").agg(F.count(F.lit(1)).alias("n"), F.max("d2").alias("max_d2"))


# --- findings --------------------------------------------------------------------------------

_PATTERN = pattern_sql("fx_mar", ["event_id", "user_id", "value", "v_mar"], MAR)


@query("findings_written", with_views("fx_mar") + f"""
    with_p as (select count(*) as n, count(*) - count(v_mar) as m from fx_mar)
    select * from (
        select 'profile' as section, 'table' as subject, 'INFO' as severity, metric, v as value_num,
               null::varchar as value_str
        from (select unnest(['rows', 'columns', 'numeric_features', 'categorical_features', 'missing_total',
                             'missing_pct', 'duplicate_rows']) as metric,
                     unnest([n, 4, 3, 0, m, {rnd('m * 1.0::double / (n * 4) * 100', 2)}, 0]) as v from with_p)
        union all
        select 'missing', 'v_mar', case when p > 30 then 'Critical' when p > 10 then 'Moderate' else 'Minor' end,
               unnest(['n_missing', 'pct']), unnest([m, p]), null
        from (select m, {rnd('m * 1.0::double / n * 100', 2)} as p from with_p)
        union all
        select 'sample', 'rows per feature', 'PASS', unnest(['needed', 'have']), unnest([30, n]), null from with_p
        union all
        select 'sample', 'absolute minimum', 'PASS', unnest(['needed', 'have']), unnest([100, n]), null from with_p
        union all
        select 'pattern', 'table', 'INFO', unnest(['total_missing_pct', 'pattern']),
               unnest([{rnd('m * 1.0::double / (n * 4) * 100', 2)}, null]), unnest([null, (select pattern from ({_PATTERN}))]) from with_p)
""".replace("with_p as", ", with_p as", 1))
def _(spark, sf):
    made = audit.findings(view(spark, sf, "fx_mar"), "value",
                          sections=["profile", "missing", "pattern", "sample"])
    path = tables.write_findings(made, tables.shared_path(spark, "findings"))
    names = ["section", "subject", "severity", "metric", "value_num", "value_str"]
    return spark.read.parquet(path).select(names)


@query("findings")
def _(spark, sf):
    return audit.findings(view(spark, sf, "fx_leak"), "l_extendedprice")


@query("audit_summary")
def _(spark, sf):
    return audit.audit_summary(view(spark, sf, "fx_drift"), "value", ["event_id"])
